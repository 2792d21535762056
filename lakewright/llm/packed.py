"""Arrays that move between tasks packed in rows of binary data, and documents that meet such answers in buckets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, shuffle_parts

PACKED = "part int, data binary"
#: Text bytes in a bucket of documents.
BUCKET_BYTES = 12 << 20
#: Buckets or shards that a task takes, one after the other, and partitions of an exchange at most, beyond which it takes more.
PARTS_A_TASK, MOST_PARTS = 4, 20_000
#: The part of rows that count something over a whole pass.
TOTALS = -1


def shard(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, by its high bits: shards follow the hashes' order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<Q", a.nbytes) + a.tobytes() for a in arrays)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        (n,) = struct.unpack_from("<Q", data, at)
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "data"])


def split(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' elements by part, in their order."""
    order = np.argsort(part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for i, j in zip(cuts, [*cuts[1:], len(part)]):
        yield int(part[i]), [a[i:j] for a in arrays]


def dealt(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """df dealt by its column part, which counts up to parts; each part's rows stand together, in the given order."""
    busy = 2 * df.sparkSession.sparkContext.defaultParallelism
    n = min(parts, max(parts // PARTS_A_TASK, busy), MOST_PARTS)
    return df.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part", *order)


def by_part(batches) -> Iterator[tuple[int, list[bytes]]]:
    """(part, its data) of rows (part, data) that are dealt."""
    now, got = None, []
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part != now:
                if got:
                    yield now, got
                now, got = part, []
            got.append(data)
    if got:
        yield now, got


def bucketed(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, int]:
    """(part, key, doc_id, row, text as bytes) of docs (doc_id, text), and the number of buckets that part
    counts: rows go to buckets by a hash of id and text, about BUCKET_BYTES of text to each. So only
    rows that are equal in both are bound to lie together. row is a column of docs, or 0."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_parts(docs.sparkSession), parts_for(total, BUCKET_BYTES))
    key = F.xxhash64("doc_id", "text")
    carried = (F.col(row) if row else F.lit(0)).cast("long").alias("row")
    own = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), carried, F.encode("text", "UTF-8").alias("text"))
    return own.select(F.pmod("key", F.lit(n)).cast("int").alias("part"), "key", "doc_id", "row", "text"), n


def with_answers(docs: DataFrame, answers: list[DataFrame], buckets: int) -> DataFrame:
    """Rows (part, kind, doc_id, row, data) of each bucket: its answers (kind: their place in the list), then
    its documents (a later kind), in an order that follows from what they hold."""
    every = docs.select("part", F.lit(len(answers)).alias("kind"), "key", "doc_id", "row", F.col("text").alias("data"))
    for kind, a in enumerate(answers):
        every = every.unionAll(a.filter("part >= 0").select("part", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), "data"))
    return dealt(every, buckets, "kind", "key", "doc_id", "data", "row").drop("key")


def met(batches, kinds) -> Iterator[tuple[int, int, int | None, int, bytes | None, list[np.ndarray]]]:
    """(bucket, place in the bucket, doc_id, row, text, the bucket's answers joined) of each document of ``with_answers``."""
    now, place, got, joined = None, 0, [], None
    for batch in batches:
        for part, kind, doc_id, row, data in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                now, place, got, joined = part, 0, [], None
            if kind == 0:
                got.append(unpacked(data, *kinds))
            else:
                if joined is None:
                    joined = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, k) for i, k in enumerate(kinds)]
                    got = []
                yield part, place, doc_id, row, data, joined
                place += 1
