"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its distinct words (A-Z lower-cased, punctuation at the ends taken off) and the
first four and five letters of longer ones, hashed. The machine has a weight and a latent vector
for each term, so it learns pairs, such as an insult with the mention of a group, that additive
weights cannot express. Terms have a row of the machine if they tell the classes apart alone or
as a member of a pair; the others are noise. Whole texts are scored where they are; the model's size
does not depend on the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import binaries, bound_batches, crc_mod

#: Labelled documents that the model is fitted on at most: those with the smallest hash of the id.
MOST_TRAINING = 16_000
BUCKETS = 1 << 20
#: z values from which a term counts, alone, and a pair of terms, which must also be this much beyond either term's.
ALONE_Z, PAIR_Z, BEYOND = 2.0, 6.0, 2.0
#: Documents that a term needs to have a z value, and terms, the most frequent ones, of which pairs are counted.
LEAST_DOCS, PAIRED = 4, 2048
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 25, 256, 0.08, 2e-4
THRESHOLD = 0.3
_ENDS = b".,;:!?\"'()[]{}<>|*_-"
_CACHE = 300_000


def _strings(word: bytes) -> list[bytes]:
    word = word.strip(_ENDS)
    if not word:
        return []
    out = [word]
    if len(word) > 4:
        letters = word.decode("utf-8", "replace")
        out += [b"^" + letters[:n].encode() for n in (4, 5) if len(letters) > n]
    return out


def buckets(word: bytes) -> tuple[int, ...]:
    return tuple(xxh64_intdigest(s) % BUCKETS for s in _strings(word))


def terms(text: bytes, cache: dict) -> set[int]:
    """The buckets of a whole text's terms."""
    out: set[int] = set()
    for w in set(text.lower().split()):
        got = cache.get(w)
        if got is None:
            if len(cache) >= _CACHE:
                cache.clear()
            got = cache[w] = buckets(w)
        out.update(got)
    return out


@dataclass
class Machine:
    """row: bucket -> row of w and v, -1 for terms that are not kept."""

    row: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """rows: the documents' terms one after the other; starts: where each document's begin."""
        if not len(rows):
            return np.full(len(starts), self.bias)
        ends = np.append(starts[1:], len(rows))
        pad = np.minimum(starts, len(rows) - 1)
        v = self.v[rows]
        each = self.w[rows] - 0.5 * (v * v).sum(1)
        total = np.where(ends > starts, np.add.reduceat(each, pad), 0.0)
        sums = np.where((ends > starts)[:, None], np.add.reduceat(v, pad, axis=0), 0.0)
        return self.bias + total + 0.5 * (sums * sums).sum(1)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        rows = np.concatenate(docs) if len(docs) else np.zeros(0, np.int64)
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, np.cumsum(sizes) - sizes), -30, 30)))


def _z(n: np.ndarray, positive: np.ndarray, base: float) -> np.ndarray:
    """How far the positive ones of n documents are from the rate, in deviations."""
    return np.where(n >= LEAST_DOCS, np.abs(positive - n * base) / np.sqrt(np.maximum(n * base * (1 - base), 1e-9) + 1), 0.0)


def select(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets of the terms whose rates in the two classes differ, alone or together with another term."""
    if not docs:
        return np.zeros(0, np.int64)
    base, some = y.mean(), 1024
    n, hits = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for i in range(0, len(docs), some):
        flat = np.concatenate(docs[i : i + some])
        n += np.bincount(flat, minlength=BUCKETS)
        hits += np.bincount(flat, np.repeat(y[i : i + some], [len(d) for d in docs[i : i + some]]), BUCKETS)
    z = _z(n, hits, base)
    frequent = np.argsort(-n, kind="stable")[:PAIRED]
    frequent = frequent[n[frequent] >= LEAST_DOCS]
    column = np.full(BUCKETS, -1, np.int32)
    column[frequent] = np.arange(len(frequent))
    both, positive = (np.zeros((len(frequent),) * 2, np.float32) for _ in range(2))
    for i in range(0, len(docs), some):
        x = np.zeros((len(docs[i : i + some]), len(frequent)), np.float32)
        for k, d in enumerate(docs[i : i + some]):
            at = column[d]
            x[k, at[at >= 0]] = 1
        both += x.T @ x
        x = x[y[i : i + some] > 0]
        positive += x.T @ x
    alone = z[frequent].astype(np.float32)
    pair = _z(both, positive, float(base))
    np.fill_diagonal(pair, 0)
    found = (pair > PAIR_Z) & (pair > np.maximum.outer(alone, alone) + BEYOND)
    return np.union1d(np.flatnonzero(z > ALONE_Z), frequent[found.any(1)])


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Machine:
    """Logistic loss, AdaGrad, mini-batches in a fixed order. One class or no rows: the rate alone."""
    row = np.full(BUCKETS, -1, np.int32)
    rate = float(y.mean()) if len(y) else 0.0
    kept = select(docs, y) if 0 < rate < 1 else np.zeros(0, np.int64)
    bias = float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    row[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    m = Machine(row, bias, np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS)))
    if not len(kept):
        return m
    docs = [(r := row[d])[r >= 0].astype(np.int64) for d in docs]
    gw, gv, gb = np.full(len(kept), 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), BATCH):
            of = order[i : i + BATCH]
            own = [docs[j] for j in of]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            rows = np.concatenate(own)
            g = 1 / (1 + np.exp(-np.clip(m.logits(rows, np.cumsum(sizes) - sizes), -30, 30))) - y[of]
            g /= len(of) ** 0.5
            gb += (d := g.sum()) ** 2
            m.bias -= RATE * d / gb**0.5
            if not len(rows):
                continue
            doc = np.repeat(np.arange(len(own)), sizes)
            v, at = m.v[rows], g[doc]
            sums = np.stack([np.bincount(doc, v[:, f], len(own)) for f in range(FACTORS)], 1)
            dw = np.bincount(rows, at, len(kept)) + DECAY * m.w
            dv = np.stack([np.bincount(rows, at * (sums[doc, f] - v[:, f]), len(kept)) for f in range(FACTORS)], 1) + DECAY * m.v
            gw += dw * dw
            gv += dv * dv
            m.w -= RATE * dw / np.sqrt(gw)
            m.v -= RATE * dv / np.sqrt(gv)
    return m


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, held_out: int = 2) -> Machine:
    """Fitted on documents whose crc32(doc_id) mod 4 is not held_out and that labels (doc_id, toxic) mark.

    Of several labels of a document the largest counts; null ids and null labels do not.
    """
    bound_batches(docs.sparkSession)
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != held_out))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def each(batches):
        cache: dict = {}
        for b in batches:
            packed = [np.fromiter(sorted(terms(t or b"", cache)), np.int32).tobytes() for t in binaries(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "toxic", "terms"])

    # At most `most` rows of two numbers: a bounded broadcast, so that texts stay where they are.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sample.select("doc_id", "toxic", "text").mapInArrow(each, "doc_id long, toxic int, terms binary").toArrow()
    rows = sorted(zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), rows["terms"].to_pylist()))
    return fit([np.frombuffer(t, np.int32) for _, _, t in rows], np.array([float(y > 0) for _, y, _ in rows]))


class Scorer:
    """Scores of texts; the rows of words already seen are kept, up to _CACHE of them."""

    def __init__(self, machine: Machine):
        self.machine, self.cache = machine, {}

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        row, none, rows = self.machine.row, np.zeros(0, np.int64), []
        for text in texts:
            found: set[int] = set()
            for w in set(text.lower().split()) if text else ():
                got = self.cache.get(w)
                if got is None:
                    if len(self.cache) >= _CACHE:
                        self.cache.clear()
                    got = self.cache[w] = tuple(r for x in buckets(w) if (r := int(row[x])) >= 0)
                if got:
                    found.update(got)
            rows.append(np.fromiter(sorted(found), np.int64) if found else none)
        return self.machine.scores(rows)


def scored(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted per row of docs (doc_id, text). Null and empty texts get the score of no terms."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    def each(batches):
        score_of = Scorer(shared.value)
        for b in batches:
            score = score_of(binaries(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, whose text scores below threshold; they are filtered where they are."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared, at = spark.sparkContext.broadcast(machine), docs.columns.index("text")

    def each(batches):
        score_of = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(score_of(binaries(b.column(at))) < threshold))

    return docs.mapInArrow(each, docs.schema)
