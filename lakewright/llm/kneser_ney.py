"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, mapped into memory for scoring.

Words and n-grams go by hashes. Documents lie in buckets, as numbers of words in one row each,
and hashes in shards by their high bits, so that a shard's load does not depend on how frequent a word
is. Nothing but the shards' and buckets' number grows with the corpus.

Training goes down the orders. For the highest, each bucket sends its distinct n-grams with their
training counts to the shards; a shard sums them, and of the buckets that have an n-gram one owns it.
For a lower order, each bucket adds up what the n-grams that it owns say of their first words as
context (the total, and how many continuations are seen once, twice and more often) and of their last
words as continuation (how many words they follow); shards sum these likewise. Each shard's sums are
stored in the shared folder as a sorted hash array with its counts.

Scoring asks for all n-grams of all documents, but for those of the highest order whose counts a
bucket was told in training: a shard's worker maps its stored arrays into memory, finds the asked
hashes by binary search, and answers each bucket in the order of its question; a bucket with all answers
scores its documents. An order is asked for as soon as it is stored, so that one order's arrays are kept at a time. So the model is never in one place: a task
holds one shard of it or the answers to one bucket. The discounts come from counts of counts, a few
numbers from each shard.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bound_batches, crc_mod, exists, mix, new_path, remove, word_hashes, written, written_parts
from .packed import PACKED, TOTALS, by_part, dealt, packed, rows, shard, unpacked

ORDER = 3
#: Text bytes in a bucket, about.
BUCKET_BYTES = 8 << 20
#: No words: they have white space.
START, END = np.uint64(xxh64_intdigest(b" start ")), np.uint64(xxh64_intdigest(b" end "))
PSEUDO = 0.1
#: Bits of an n-gram's hash that are used, 56; words have all 64. Of N n-grams, one in 2**56 / N unseen ones is taken for a seen one.
_KEPT = np.uint64(0xFFFFFFFFFFFFFF00)
#: Shards' arrays are rows of part MODEL less the shard's number.
MODEL = -2
#: What is known of an n-gram below the highest order, as context: continuations seen once, twice, more often, and the
#: total of the last; and the words it follows. Words have their occurrences beside that.
STATS = 5


def token_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the text's words, A-Z lower-cased, and of one end."""
    return np.append(word_hashes((text or b"").lower().split()), END)


def deltas(h: np.ndarray) -> np.ndarray:
    """Ascending hashes as steps, byte plane by byte plane: the high planes are nearly all zero and pack well."""
    return np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def ascending(planes: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def small(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts, few of them large, as bytes, and those of 255 and more beside them."""
    return np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.uint64)


def large(low: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[low == 255] = more
    return out


#: Made once for a worker: a message is small beside what making them costs.
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def sealed(*arrays: np.ndarray) -> bytes:
    """The arrays packed and compressed: most of what tasks tell each other are zeros and ones."""
    return _ZIP.compress(packed(*arrays))


def opened(data: bytes, *kinds) -> list[np.ndarray]:
    return unpacked(_UNZIP.decompress(data), *kinds)


def _counts(arrays: list[np.ndarray]) -> list[np.ndarray]:
    return [large(*arrays[i : i + 2]) for i in range(0, len(arrays), 2)]


def in_memory_map(array: np.ndarray) -> np.ndarray:
    """The array in a file mapped into memory, whose pages the system may drop; the file has no name any more, so nothing is left behind."""
    if not len(array):
        return array
    fd, path = tempfile.mkstemp(prefix="kn-")
    os.close(fd)
    try:
        array.tofile(path)
        return np.memmap(path, array.dtype, "r", shape=array.shape)
    finally:
        os.unlink(path)


def _first(ranked: np.ndarray) -> np.ndarray:
    """Where each value of an ascending array begins."""
    out = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=out[1:])
    return out


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each key, equal for equal ones and ascending with them; a place of each)."""
    order = np.argsort(keys)
    new = _first(keys[order])
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return of, order[new]


# Documents in buckets


def bucketed(docs: DataFrame, training) -> tuple[DataFrame, int]:
    """(rows (part, data) of the buckets, written; how many there are), of docs (doc_id, text).

    A bucket is a run of documents of one input partition, about BUCKET_BYTES of text: nothing is
    shuffled, and ids are no keys, so they may be null or repeat.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"), F.coalesce(training, F.lit(False)).alias("trains"))

    def bucket(batches):
        number, held, size = TaskContext.get().partitionId(), [], 0

        def row():
            ids, trains, tokens = zip(*held)
            h = np.concatenate([x for t in tokens for x in (np.array([START]), t)])
            of, first = groups(h)
            # Frequent words get small numbers, whose high bytes are zero.
            rank = np.argsort(-np.bincount(of), kind="stable")
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank))
            numbers = np.ascontiguousarray(place[of].astype("<u4").view(np.uint8).reshape(-1, 4).T)
            return packed(
                np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array(trains, np.uint8),
                np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens)), h[first][rank], np.frombuffer(zstandard.compress(numbers.tobytes(), 1), np.uint8),
            )

        for b in batches:
            for doc_id, text, trains in zip(*(c.to_pylist() for c in b.columns)):
                held.append((doc_id, trains, token_hashes(text)))
                size += len(text or b"") + 8
                if size >= BUCKET_BYTES:
                    yield rows([(number, row())])
                    number, held, size = number + (1 << 20), [], 0  # a partition's next bucket
        if held:
            yield rows([(number, row())])

    out = written(own.mapInArrow(bucket, PACKED), "kn-buckets")
    return out, max(1, out.count())


class Bucket:
    """Documents one after the other; each begins with a position for START, which stands for all that is before it."""

    def __init__(self, data: bytes):
        self.ids, null, trains, self.sizes, self.vocabulary, numbers = unpacked(data, np.int64, np.uint8, np.uint8, np.int64, np.uint64, np.uint8)
        self.null = null.astype(bool)
        raw = np.frombuffer(zstandard.decompress(numbers.tobytes()), np.uint8).reshape(4, -1)
        self.words = np.ascontiguousarray(raw.T).view("<u4").ravel()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.token = np.ones(len(self.words), bool)  # and not a START
        self.token[self.starts] = False
        self.training = np.repeat(trains.astype(bool), self.sizes) & self.token
        self._hashes = [self.vocabulary[self.words]]

    def hashes(self, order: int) -> np.ndarray:
        """The hash of the n-gram of this order that ends at each position."""
        while len(self._hashes) < order:
            below = self._hashes[-1]
            before = np.roll(below, 1)
            before[self.starts] = below[self.starts]
            with np.errstate(over="ignore"):
                self._hashes.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(self.vocabulary)[self.words]) & _KEPT)
        return self._hashes[order - 1]

    def numbered(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(the number of the n-gram at each position, ascending with its hash; the hash of each number)."""
        if order == 1:
            by = np.argsort(self.vocabulary)
            place = np.empty(len(by), np.int32)
            place[by] = np.arange(len(by), dtype=np.int32)
            return place[self.words], self.vocabulary[by]
        h = self.hashes(order)
        of, at = groups(h)
        return of, h[at]


def _by_shard(h: np.ndarray, shards: int, *values: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(shard, hashes, their values) of ascending hashes, whose order shards follow."""
    of = shard(h, shards)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(h) else []
    for i, j in zip(cuts, [*cuts[1:], len(h)]):
        yield int(of[i]), h[i:j], [v[i:j] for v in values]


def _joined(answers: list[list[np.ndarray]], arrays: int) -> list[np.ndarray]:
    """What the shards' answers (number, arrays) to ascending hashes say, in their order."""
    answers = sorted(answers, key=lambda a: int(a[0][0]))
    return [np.concatenate([a[1 + k] for a in answers]) if answers else np.zeros(0, np.int64) for k in range(arrays)]


def _with_answers(buckets: DataFrame, answers: list[DataFrame], n: int) -> DataFrame:
    """Rows (part, kind, data): a bucket's answers, their kind being their place in the list, then the bucket."""
    every = buckets.select("part", F.lit(len(answers)).alias("kind"), "data")
    for kind, a in enumerate(answers):
        every = every.unionAll(a.filter("part >= 0").select("part", F.lit(kind).alias("kind"), "data"))
    return dealt(every, n, "kind")


def _met(batches, kinds: int) -> Iterator[tuple[int, Bucket, list[list[bytes]]]]:
    now, got = None, [[] for _ in range(kinds)]
    for batch in batches:
        for part, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                now, got = part, [[] for _ in range(kinds)]
            if kind < kinds:
                got[kind].append(data)
            else:
                yield part, Bucket(data), got


# Training


def _count_of_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)


#: The kinds of arrays in an answer of a training shard: its number, counts, and which n-grams the bucket owns.
_OWN = (np.uint32, np.uint8, np.uint64, np.uint8)


def _owned(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, which are owned) of what a bucket told, in ascending order of the hashes."""
    each = [opened(d, *_OWN) for d in answers]
    # The last of an answer is packed bits, unpacked shard by shard.
    count, own = _joined([[a[0], large(a[1], a[2]), np.unpackbits(a[3])[: len(a[1])]] for a in each], 2)
    return count, own > 0


def _told(bucket: Bucket, order: int, down_to: int, answers: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes of the n-grams of order down_to that the bucket has something to say of; what it
    says), from the answers to what it told of the orders above."""
    at = np.flatnonzero(bucket.training)
    h = bucket.hashes(order)[at]
    if not answers:
        h.sort()
        new = np.flatnonzero(_first(h))
        return h[new], np.diff(np.append(new, len(h)))[None]
    by = np.argsort(h)
    h = h[by]
    new = np.flatnonzero(_first(h))
    said, h, place = np.diff(np.append(new, len(h)))[None], h[new], at[by[new]]
    for below, got in zip(range(order - 1, down_to - 1, -1), answers):
        count, own = _owned(got)
        count, place = count[own], place[own]
        hashes, n = bucket.hashes(below), len(place)
        places = [place - 1, place]
        if below == 1:
            words, uses = np.unique(bucket.words[bucket.training], return_counts=True)
            first = np.empty(len(bucket.vocabulary), np.int64)
            first[bucket.words] = np.arange(len(bucket.words))
            places.append(first[words])
        places = np.concatenate(places)
        of, at = groups(hashes[places])
        context, kinds = of[:n], len(at)
        said = [np.bincount(context[those], minlength=kinds) for those in (count == 1, count == 2, count > 2)]
        said.append(np.bincount(context[count > 2], count[count > 2].astype(np.float64), kinds).astype(np.int64))
        said.append(np.bincount(of[n : 2 * n], minlength=kinds))
        if below == 1:
            said.append(np.bincount(of[2 * n :], uses, kinds).astype(np.int64))
        said, place = np.array(said), places[at]
        h = hashes[place]
    return h, said


def _tell(order: int, at: int, shards: int):
    def each(batches):
        for part, bucket, answers in _met(batches, order - at):
            h, said = _told(bucket, order, at, answers)
            for k, h, values in _by_shard(h, shards, *said):
                yield rows([(k, sealed(np.array([part], np.uint32), deltas(h), *(x for v in values for x in small(v))))])

    return each


def _sum(width: int, owners: bool):
    """Shards: sums of what buckets say (width arrays), stored and answered. The last of STATS, or the only array, is the count
    whose counts of counts give discounts, and by which an n-gram takes part in the order below."""
    which = 0 if width == 1 else 4

    def each(batches):
        for number, data in by_part(batches):
            told = [opened(d, np.uint32, np.uint8, *[np.uint8, np.uint64] * width) for d in data]
            told.sort(key=lambda t: int(t[0][0]))
            hashes = [ascending(t[1]) for t in told]
            every = np.concatenate(hashes)
            of, at = groups(every)
            model = every[at]
            sums = [np.bincount(of, np.concatenate([large(*t[2 + 2 * i : 4 + 2 * i]) for t in told]).astype(np.float64), len(model)).astype(np.int64) for i in range(width)]
            extra = [np.array([np.count_nonzero(sums[5]), sums[5].sum()], np.int64)] if width > STATS else []
            extra = [np.array([sums[which].sum(), np.count_nonzero(sums[which])], np.int64), *extra]
            yield rows([(TOTALS, sealed(_count_of_counts(sums[which]), np.concatenate(extra)))])
            yield rows([(MODEL - number, sealed(deltas(model), *(x for s in sums for x in small(s))))])
            if owners:
                owner = np.full(len(model), len(every), np.int64)
                np.minimum.at(owner, of, np.arange(len(every)))
                own = np.zeros(len(every), bool)
                own[owner[sums[which] > 0]] = True
                start = 0
                for t, h in zip(told, hashes):
                    s = slice(start, start + len(h))
                    start += len(h)
                    yield rows([(int(t[0][0]), sealed(np.array([number], np.uint32), *small(sums[which][of[s]]), np.packbits(own[s])))])

    return each


@dataclass
class Discounts:
    """For counts of one, two, and three or more, from the counts of counts n1 to n4."""

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n) -> Discounts:
        n1, n2, n3, n4 = (int(x) for x in n)
        if not (n1 and n2 and n3):
            return cls(0.5, 0.75, 1.0)  # too little text for estimates
        y = n1 / (n1 + 2 * n2)
        return cls(*(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))))

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.array([0.0, self.one, self.two, self.more])[np.minimum(count, 3)]


@dataclass
class Model:
    """The numbers of a trained model that all scores share."""

    order: int
    discounts: list[Discounts]  # of the orders, the highest first
    known: int  # distinct training tokens
    tokens: int
    types: int  # distinct training bigrams, which end in words
    back_off: float  # probability that words leave to the uniform distribution

    def log10(self, bucket: Bucket, counts: list[list[np.ndarray]], of: list[np.ndarray]) -> np.ndarray:
        """log10 of P(token | context) for each position that is a token's; counts: those of each order's numbered
        n-grams, words first; of: the numbers at the positions."""
        at = np.flatnonzero(bucket.token)
        contexts = counts[0][4]
        p = np.full(len(contexts), self.back_off / (self.known + 1))
        if self.types:
            p += np.maximum(contexts - self.discounts[-1](contexts), 0) / self.types
        p = p[of[0][at]]
        for order in range(2, self.order + 1):
            d = self.discounts[self.order - order]
            once, twice, often, rest = counts[order - 2][:4]
            before = of[order - 2][at - 1]
            total = (once + 2 * twice + rest)[before]
            left = (d.one * once + d.two * twice + d.more * often)[before]
            count = counts[order - 1][0 if order == self.order else 4]
            kept = np.maximum(count - d(count), 0)[of[order - 1][at]]
            p = np.where(total > 0, (kept + left * p) / np.maximum(total, 1), p)
        return np.log10(p)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + PSEUDO) / (self.tokens + PSEUDO * (self.known + 1)))


def width(order: int, highest: int) -> int:
    """Arrays of counts that a shard has for each n-gram of an order."""
    return 1 if order == highest else STATS + (order == 1)


def trained(buckets: DataFrame, n: int, order: int, use: Callable[[int, DataFrame], None]) -> tuple[Model, list[DataFrame]]:
    """(the model of the training documents of n buckets, what its shards answered to the buckets, the highest order first).

    use is called with each order and the table of its shards' arrays as it is stored. No training
    documents: every token has probability 1.
    """
    spark = buckets.sparkSession
    answered, discounts = [], []
    for at in range(order, 0, -1):
        met = _with_answers(buckets, answered, n) if answered else buckets.select("part", F.lit(0).alias("kind"), "data")
        told = met.mapInArrow(_tell(order, at, n), PACKED)
        out = dealt(told, n).mapInArrow(_sum(width(at, order), at > 1), PACKED)
        path = new_path(spark, f"kn-model-{at}")
        written_parts(out.withColumn("kind", F.when(F.col("part") >= 0, "answer").otherwise("stored")), path, "kind")
        kept = lambda kind: spark.read.schema(PACKED).parquet(f"{path}/kind={kind}") if exists(spark, f"{path}/kind={kind}") else spark.createDataFrame([], PACKED)  # noqa: B023, E731
        stored = kept("stored")
        answered.append(kept("answer"))
        # Some numbers from each shard.
        got = [opened(bytes(r.data), np.int64, np.int64) for r in stored.filter(F.col("part") == TOTALS).select("data").toLocalIterator()]
        counts = sum((c for c, _ in got), np.zeros(4, np.int64))
        totals = sum((t for _, t in got), np.zeros(4 if at == 1 else 2, np.int64))
        discounts.append(Discounts.of(counts))
        use(at, stored)
    types, distinct, known, tokens = (int(x) for x in totals)
    d, n1, n2 = discounts[-1], int(counts[0]), int(counts[1])
    left = d.one * n1 + d.two * n2 + d.more * (distinct - n1 - n2)
    return Model(order, discounts, known, tokens, types, left / types if types else 1.0), answered[: order - 1]


# Scoring


def _ask(order: int, highest: int, shards: int):
    """Of the highest order, a bucket has been told the counts of what it trained on."""

    def each(batches):
        for part, data in by_part(batches):
            for d in data:
                bucket = Bucket(d)
                if order == 1:
                    h = np.sort(bucket.vocabulary)
                else:
                    # The lowest bit, which hashes do not use, puts training places first.
                    h = bucket.hashes(order) | (~bucket.training).view(np.uint8) if order == highest else bucket.hashes(order)
                    h = np.sort(h)
                    new = _first(h & _KEPT)
                    h = h[new & (h & np.uint64(1) > 0)] & _KEPT if order == highest else h[new]
                for k, own, _ in _by_shard(h, shards):
                    yield rows([(k, sealed(np.array([part], np.uint32), deltas(own)))])

    return each


def _look_up(width: int):
    """Shards: kind 0 is the stored arrays, which are mapped into memory, kind 1 a bucket's question."""

    def each(batches):
        now = model = None
        counts: list[np.ndarray] = []
        for batch in batches:
            for part, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    now, model, counts = part, np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * width
                if kind == 0:
                    planes, *own = opened(data, np.uint8, *[np.uint8, np.uint64] * width)
                    model, counts = in_memory_map(ascending(planes)), [in_memory_map(c) for c in _counts(own)]
                    continue
                bucket, planes = opened(data, np.uint32, np.uint8)
                h = ascending(planes)
                place = np.searchsorted(model, h)
                inside = np.flatnonzero(place < len(model))
                hit = inside[model[place[inside]] == h[inside]]
                out = []
                for c in counts:
                    found = np.zeros(len(h), np.int64)
                    found[hit] = c[place[hit]]
                    out += small(found)
                yield rows([(int(bucket[0]), sealed(np.array([part], np.uint32), *out))])

    return each


def answers(buckets: DataFrame, n: int, order: int, highest: int, table: DataFrame) -> DataFrame:
    """What the shards of a stored order say of its n-grams in the n buckets, written."""
    stored = table.filter(F.col("part") <= MODEL).select((MODEL - F.col("part")).alias("part"), F.lit(0).alias("kind"), "data")
    asked = buckets.mapInArrow(_ask(order, highest, n), PACKED).select("part", F.lit(1).alias("kind"), "data")
    return written(dealt(stored.unionAll(asked), n, "kind").mapInArrow(_look_up(width(order, highest)), PACKED), f"kn-answers-{order}")


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, training, order: int = ORDER) -> DataFrame:
    """SCORES per row of docs (doc_id, text), from a model of the rows that the Column training marks.

    Tokens are the text's words and one end. score is the text's log10 probability, base_score that
    of additive smoothing without context. Null and empty texts are an end alone; repeated rows
    count as often as they stand; rows with a null id take part. Without training rows every token
    has probability 1. No rows give no rows. A bucket's tokens are in memory together.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    buckets, n = bucketed(docs, training)
    said: dict[int, DataFrame] = {}

    def use(at: int, table: DataFrame) -> None:
        said[at] = answers(buckets, n, at, order, table)
        remove(spark, table)

    model, answered = trained(buckets, n, order, use)
    for a in answered[1:]:
        remove(spark, a)
    widths = [width(k, order) for k in range(1, order + 1)]

    def score(batches):
        for _, bucket, got in _met(batches, order + 1):
            of, counts = [], []
            for k, (arrays, data) in enumerate(zip(widths, got), 1):
                each = [opened(d, np.uint32, *[np.uint8, np.uint64] * arrays) for d in data]
                numbers, h = bucket.numbered(k)
                found = _joined([[a[0], *_counts(a[1:])] for a in each], arrays)
                if k == order:
                    trained_on = np.bincount(numbers[bucket.training], minlength=len(h)) > 0
                    count = np.zeros(len(h), np.int64)
                    count[~trained_on], count[trained_on] = found[0], _owned(got[order])[0]
                    found = [count]
                of.append(numbers)
                counts.append(found)
            log = model.log10(bucket, counts, of)
            count = counts[0][5][of[0][bucket.token]]
            sizes = bucket.sizes - 1
            starts = np.cumsum(sizes) - sizes
            each_of = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.ids, pa.int64(), mask=bucket.null), pa.array(sizes), pa.array(each_of((count > 0).astype(np.int64))), pa.array(np.full(len(sizes), model.tokens)), pa.array(each_of(model.base(count))), pa.array(each_of(log))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return _with_answers(buckets, [*(said[k] for k in range(1, order + 1)), answered[0]], n).mapInArrow(score, SCORES)


def held_out(mod: int = 10, at: int = 0):
    return crc_mod("doc_id", mod) == at


def perplexity(total_log10: float, tokens: int) -> float:
    return math.pow(10, -total_log10 / max(1, tokens))
