"""Substring deduplication with compressed FM-indexes.

A word is removed if a window of 20 words that covers it also starts earlier: in a document of a
smaller id, or earlier in the same one.

No document is compared with all others. Each window has an anchor, the least hash of the runs of
ANCHOR words in it; equal windows have equal anchors, and neighbouring windows mostly share theirs
and form a segment. Four passes:

1. Anchors are counted, and each bucket of documents hears which of its anchors occur twice or more.
   The few anchors that a share of all documents has are found beforehand and told to all.
2. Documents meet those answers; segments with repeated anchors go to the anchor's shard, equal
   segments of a bucket once. Segments of very frequent anchors go window by window to the shard
   of the window's own hash, so no anchor makes a shard large.
3. A shard keeps each segment once, in order of where it stands first, builds an FM-index (BWT in a
   wavelet matrix) over them and streams them through it: backward search gives matching
   statistics, and of the windows that match elsewhere all but the earliest are reported.
4. Documents meet the reports, and covered words go.

What moves between tasks is packed in rows of binary data. Words are compared by 48 bits of their
hash, so a wrong report takes two windows that differ only where those bits agree. A bucket holds
BUCKET_BYTES of text, a shard about SHARD_WORDS words; their numbers grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, gram_hashes, mix, parts_for, remove, shuffle_parts, word_hashes, written
from .fmindex import repeated_windows
from .packed import PACKED, TOTALS, bucketed, by_part, dealt, met, packed, rows, shard, split, unpacked, with_answers

WINDOW, ANCHOR = 20, 6
#: Windows in a segment at most, and segments of an anchor that is not yet very frequent.
SEGMENT_WINDOWS, FREQUENT = 60, 4096
#: Words in a shard, about, if a segment has SEGMENT_WORDS and one that goes window by window WINDOWS_WORDS.
SHARD_WORDS, SEGMENT_WORDS, WINDOWS_WORDS = 1_000_000, 27, 160
#: Anchors, and segments, that a task holds before it hands them on.
FLUSH_ANCHORS, FLUSH_SEGMENTS = 1_000_000, 60_000
#: Of one document in so many, anchors are counted to find heavy ones: those with at least HEAVY_LEAST
#: and a share of 1/HEAVY of the count. So there are HEAVY of them at most. HEAVY and FREQUENT only decide
#: how segments travel: every window of a segment reaches a shard together with all its equals either way,
#: because equal windows have equal anchors, and an anchor goes one way in all documents.
SAMPLE, HEAVY, HEAVY_LEAST = 64, 4096, 16


def segments(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, whether the anchor stands in it twice) of each segment of a text with word hashes h."""
    grams = g = gram_hashes(h, anchor)
    span, have = window - anchor + 1, 1
    if len(g) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    while have < span:
        step = min(have, span - have)
        g, have = np.minimum(g[: len(g) - step], g[step:]), have + step
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    n = np.diff(np.append(cut, len(g)))
    if n.max() > SEGMENT_WINDOWS:
        more = -(-n // SEGMENT_WINDOWS)
        part = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        cut, n = np.repeat(cut, more) + part * SEGMENT_WINDOWS, np.minimum(np.repeat(n, more) - part * SEGMENT_WINDOWS, SEGMENT_WINDOWS)
    twice, in_order = np.zeros(len(cut), bool), np.sort(grams)
    if (in_order[1:] == in_order[:-1]).any():
        for i, (s, k) in enumerate(zip(cut.tolist(), n.tolist())):
            twice[i] = np.count_nonzero(grams[s : s + k + span - 1] == g[s]) > 1
    return cut, n, g[cut], twice


def _shard_of(anchors: np.ndarray, shards: int) -> np.ndarray:
    """Anchors are least hashes, so they are small; another hash deals them evenly."""
    return shard(mix(anchors), shards)


def _anchor_rows(anchors: list[np.ndarray], buckets: list[np.ndarray], shards: int) -> pa.RecordBatch:
    a, b = np.concatenate(anchors), np.concatenate(buckets)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    n = np.minimum(np.diff(np.append(new, len(a))), 65535).astype(np.uint16)
    a, b = a[new], b[new]
    return rows([(k, packed(*x)) for k, x in split(_shard_of(a, shards), a, b, n)])


def _heavy(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(anchors of a share of all segments, at most HEAVY, ascending; about how many segments they have).
    They need no counting and would crowd a shard."""

    def each(batches):
        found: list[np.ndarray] = []
        for batch in batches:
            found += [segments(word_hashes(text.split()))[2] for text in batch.column(0).to_pylist() if text]
        if found:
            once, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(n)], ["anchor", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(each, "anchor long, n long")
    counted = written(sample.groupBy("anchor").agg(F.sum("n").alias("n")), "substring-heavy")
    total = counted.agg(F.sum("n")).first()[0] or 0
    top = counted.filter((F.col("n") >= HEAVY_LEAST) & (F.col("n") * HEAVY >= total)).collect()
    remove(docs.sparkSession, counted)
    return np.sort(np.array([r.anchor for r in top], np.int64).view(np.uint64)), SAMPLE * sum(r.n for r in top)


def _member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _repeated(docs: DataFrame, shards: int, heavy: np.ndarray) -> DataFrame:
    """Pass 1: rows (part: bucket, data: its repeated anchors, and which are very frequent). Heavy anchors
    are left out: all know them. Rows of part TOTALS count segments: usual ones, and very frequent ones."""

    def emit(batches):
        anchors, of, held = [], [], 0
        for batch in batches:
            for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                _, _, a, twice = segments(word_hashes(text.split()))
                if len(a):
                    a = np.concatenate([a, a[twice]])
                    a = a[~_member(heavy, a)]
                    anchors.append(a)
                    of.append(np.full(len(a), bucket, np.uint32))
                    held += len(a)
                if held >= FLUSH_ANCHORS:
                    yield _anchor_rows(anchors, of, shards)
                    anchors, of, held = [], [], 0
        if held:
            yield _anchor_rows(anchors, of, shards)

    def count(batches):
        for _, data in by_part(batches):
            a, b, n = (np.concatenate(x) for x in zip(*(unpacked(d, np.uint64, np.uint32, np.uint16) for d in data)))
            once, of = np.unique(a, return_inverse=True)
            total = np.bincount(of, n.astype(np.float64), len(once))[of]
            a, b, n, often = a[total > 1], b[total > 1], n[total > 1], total[total > 1] > FREQUENT
            yield rows([(TOTALS, packed(np.array([n[~often].sum(), n[often].sum()], np.int64)))])
            for bucket, (x, f) in split(b.astype(np.int64), a, often):
                once, first = np.unique(x, return_index=True)
                yield rows([(bucket, packed(once, f[first].astype(np.uint8)))])

    return dealt(docs.select("part", "text").mapInArrow(emit, PACKED), shards).mapInArrow(count, PACKED)


class _Segments:
    """Segments on their way to shards: equal ones once, with the places where they stand."""

    def __init__(self, shards: int):
        self.shards, self.number, self.shard = shards, {}, []
        self.of, self.place, self.doc, self.start = [], [], [], []

    def add(self, words: bytes, shard: int, place: int, doc: int, start: int) -> None:
        k = self.number.get(words)
        if k is None:
            k = self.number[words] = len(self.number)
            self.shard.append(shard)
        self.of.append(k)
        self.place.append(place)
        self.doc.append(doc)
        self.start.append(start)

    def batches(self, bucket: int) -> Iterator[pa.RecordBatch]:
        shard, of = np.array(self.shard, np.int64), np.array(self.of, np.int64)
        place, doc, start = np.array(self.place, np.uint32), np.array(self.doc, np.int64), np.array(self.start, np.uint32)
        words = list(self.number)
        local = np.zeros(len(words), np.int64)
        own: dict[int, np.ndarray] = {}
        for k, (x,) in split(shard, np.arange(len(words))):
            own[k] = x
            local[x] = np.arange(len(x))
        for k, (o, p, d, s) in split(shard[of], of, place, doc, start):
            texts = [words[i] for i in own[k].tolist()]
            sizes = np.array([len(t) // 6 for t in texts], np.uint8)
            yield rows([(k, packed(sizes, np.frombuffer(b"".join(texts), np.uint8), local[o].astype(np.uint32), p, d, s, np.array([bucket], np.uint32)))])
        self.__init__(self.shards)


#: Stands for a null id, before all others.
_NULL = -(1 << 63)


def _emit_segments(batches, shards: int, heavy: np.ndarray):
    out, last, heard = _Segments(shards), None, None
    for bucket, place, doc_id, _, text, answers in met(batches, (np.uint64, np.uint8)):
        if heard is not answers:
            heard, order = answers, np.argsort(answers[0], kind="stable")
            anchors, often = answers[0][order], answers[1][order]
        if last is not None and last != bucket and out.of:
            yield from out.batches(last)
        last = bucket
        if not text:
            continue
        h = word_hashes(text.split())
        first, n, a, _ = segments(h)
        known = _member(heavy, a)
        hit = known | _member(anchors, a)
        if not hit.any():
            continue
        frequent = known.copy()
        if len(anchors):
            frequent |= _member(anchors, a) & (often[np.minimum(np.searchsorted(anchors, a), len(anchors) - 1)] > 0)
        words = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        raw, doc = np.ascontiguousarray(words).tobytes(), _NULL if doc_id is None else doc_id
        own_shard = _shard_of(a, shards)
        for i in np.flatnonzero(hit).tolist():
            s, k = int(first[i]), int(n[i])
            if frequent[i]:
                own = shard(gram_hashes(h[s : s + k + WINDOW - 1], WINDOW), shards)
                for j in range(k):
                    out.add(raw[6 * (s + j) : 6 * (s + j + WINDOW)], int(own[j]), place, doc, s + j)
            else:
                out.add(raw[6 * s : 6 * (s + k + WINDOW - 1)], int(own_shard[i]), place, doc, s)
        if len(out.of) >= FLUSH_SEGMENTS:
            yield from out.batches(bucket)
    if out.of:
        yield from out.batches(last)


def _search_shards(batches):
    """Pass 3: rows (part: bucket, data: places of documents in it, first windows, and masks of the windows that also start earlier)."""
    for _, data in by_part(batches):
        yield from _search(data)


def _search(data: list[bytes]):
    number: dict[bytes, int] = {}
    parts: list[list[np.ndarray]] = []
    for d in data:
        sizes, words, o, *where, b = unpacked(d, np.uint8, np.uint8, np.uint32, np.uint32, np.int64, np.uint32, np.uint32)
        raw, ends = words.tobytes(), np.cumsum(sizes.astype(np.int64)) * 6
        ids = np.fromiter((number.setdefault(raw[i:j], len(number)) for i, j in zip((ends - sizes.astype(np.int64) * 6).tolist(), ends.tolist())), np.int64, len(sizes))
        parts.append([ids[o], *where, np.full(len(o), b[0], np.int64)])
    of, place, doc, start, bucket = (np.concatenate(x) for x in zip(*parts))
    # The first place of each segment.
    order = np.lexsort((start, doc, of))
    lead = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
    sizes = np.fromiter(map(len, number), np.int64, len(number)) // 6
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(number), np.uint8).reshape(-1, 6)
    del number, parts
    once, symbols = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    del wide
    same = repeated_windows((symbols + 1).astype(np.int32), sizes, len(once) + 1, WINDOW)
    del once, symbols
    # Of equal windows those stay that start first; a word is removed where its window starts later.
    head = np.cumsum(sizes) - sizes
    at = np.flatnonzero(same >= 0)
    of_segment = np.repeat(np.arange(len(sizes)), sizes)[at]
    inside = at - head[of_segment]
    d, s, same = doc[lead][of_segment], start[lead][of_segment].astype(np.int64) + inside, same[at]
    order = np.lexsort((s, d, same))
    new = np.concatenate([[True], same[order][1:] != same[order][:-1]])[: len(order)]
    least = order[new][np.cumsum(new) - 1]
    later = np.zeros(len(at), bool)
    later[order] = (d[order] != d[least]) | (s[order] != s[least])
    bits = np.zeros(int(sizes.sum()), np.uint64)
    bits[at[later]] = np.uint64(1) << inside[later].astype(np.uint64)
    at_first = np.bitwise_or.reduceat(bits, head)
    every = (np.uint64(1) << (sizes - WINDOW + 1).astype(np.uint64)) - np.uint64(1)
    first = (doc == doc[lead][of]) & (start == start[lead][of])
    mask = np.where(first, at_first[of], every[of])
    some = mask > 0
    for k, arrays in split(bucket[some], place[some], start[some], mask[some]):
        yield rows([(k, packed(*arrays))])


def covered(n: int, starts: np.ndarray, masks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words the windows cover: bit i of a mask is the window at start + i."""
    step = np.zeros(n + 1, np.int64)
    for s, m in zip(starts.tolist(), masks.tolist()):
        while m:
            low = (m & -m).bit_length() - 1
            step[s + low] += 1
            step[s + low + window] -= 1
            m &= m - 1
    return np.cumsum(step[:n]) > 0


def deduplicated(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, row, n_words, n_removed, kept per row of docs (doc_id, text); kept has the kept words joined by a
    space. row is the column of docs that is named so, to tell rows apart by, or 0.

    Null and empty texts have no words. A null doc_id comes before all others. Rows with the same
    doc_id count as the same document: words at the same place of it do not remove each other.
    Texts of fewer than 20 words lose nothing. No rows give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own, buckets = bucketed(docs, row)
    heavy, heavy_segments = _heavy(own)
    repeated = written(_repeated(own, buckets, heavy), "substring-anchors")
    # Two numbers from each shard of anchors.
    counted = repeated.filter(F.col("part") == TOTALS).select("data").toLocalIterator()
    usual, frequent = np.sum([np.zeros(2, np.int64), *(unpacked(bytes(r.data), np.int64)[0] for r in counted)], 0).tolist()
    words = SEGMENT_WORDS * usual + WINDOWS_WORDS * (frequent + heavy_segments)
    shards = max(shuffle_parts(spark), parts_for(words, SHARD_WORDS))
    sent = with_answers(own, [repeated], buckets).mapInArrow(lambda b: _emit_segments(b, shards, heavy), PACKED)
    reports = written(dealt(sent, shards).mapInArrow(_search_shards, PACKED), "substring-reports")
    remove(spark, repeated)

    def cut(batches):
        held, size = [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
        now, order, of = None, None, None
        for _, place, doc_id, row, text, (places, start, mask) in met(batches, (np.uint32, np.uint32, np.uint64)):
            if now is not places:
                now, order = places, np.argsort(places, kind="stable")
                of = places[order]
            words, gone = (text or b"").split(), 0
            i, j = np.searchsorted(of, place), np.searchsorted(of, place, "right")
            n = len(words)
            if j > i:
                drop = covered(n, start[order[i:j]], mask[order[i:j]])
                gone = int(drop.sum())
                words = [w for w, d in zip(words, drop.tolist()) if not d]
            held.append((doc_id, row, n, gone, b" ".join(words)))
            size += len(text or b"")
            if size >= 8 << 20 or len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    kept = with_answers(own, [reports], buckets).mapInArrow(cut, "doc_id long, row long, n_words long, n_removed long, kept binary")
    return kept.withColumn("kept", F.col("kept").cast("string"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM d, range(1, len(w) - 18) r(p)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS again FROM s),
c AS (SELECT doc_id, list(DISTINCT p + k) AS gone FROM f, range(0, 20) r(k) WHERE again GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS removed,
  list_transform(list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: w[i]) AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
