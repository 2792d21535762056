"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at 3 or fewer differing bits. Half of that radius is one and a half bits: every
distinct fingerprint emits, for each of its four 16-bit blocks, the 48 bits outside the block and
all their variants at one flipped bit. The wildcard block takes the odd third bit: of two linked
fingerprints, one has a block that holds exactly one of three differing bits (or all of them), and
outside it the two meet in the middle. 196 variants do the work of the 2081 that whole balls of
radius two would need.

Variants are shuffled, and a group of colliding fingerprints is linked without comparing all of
its pairs. Members that agree in the block differ in two bits at most, so a star joins them; block
values one bit apart differ in three at most, so one member of each value joins the stars. Three
differing bits in one block meet at the unflipped variant, where block values within three bits
are looked up. A group has at most 49 x 65536 members, whatever the data. Each task writes a
spanning forest of the links it found and verified.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import binaries, bound_batches, join_counted, parts_for, remove, shuffle_parts, written
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS, WIDTH = 4, 16
VARIANTS = BLOCKS * (1 + 64 - WIDTH)
#: Variants that a task links: 16 bytes each.
TASK_VARIANTS = 3_000_000
_REST = (1 << 48) - 1
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_hash = partial(xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's n-word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
    h = np.fromiter(map(_hash, shingles), np.uint64)
    ones, at = np.zeros(64, np.int64), np.arange(8) * 256
    for i in range(0, len(h), 1 << 16):
        block = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += (np.bincount((block + at).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row of docs (doc_id, text); fp is the fingerprint as a signed long. Null is as empty: 0."""

    def each(batches):
        for b in batches:
            fps = np.fromiter(map(fingerprint, binaries(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def _rotated(fp: np.ndarray, block: np.ndarray) -> np.ndarray:
    left = (block * np.uint64(WIDTH)).astype(np.uint64)
    return np.where(left > 0, (fp << left) | (fp >> ((np.uint64(64) - left) & np.uint64(63))), fp)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes other than the least, of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def group_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal key that connect all linked members (both uint64)."""
    none = np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    same = key[1:] == key[:-1]
    member = np.zeros(len(key), bool)
    member[1:] |= same
    member[:-1] |= same
    key, fp = key[member], fp[member]
    if not len(key):
        return none, none
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64)
    whole = _rotated(fp, key >> np.uint64(48))
    value, rest = (whole >> np.uint64(48)).astype(np.int64), whole & np.uint64(_REST)
    at = group * 65536 + value
    order = np.argsort(at, kind="stable")
    at, fp, center = at[order], fp[order], (rest == (key & np.uint64(_REST)))[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    a, b = [fp[head[~first]]], [fp[~first]]

    def near(at, fp, masks):
        for m in masks:
            other = at ^ m
            up = other > at
            i = np.searchsorted(at, other[up])
            found = np.flatnonzero(up)[at[np.minimum(i, len(at) - 1)] == other[up]]
            a.append(fp[found])
            b.append(fp[np.searchsorted(at, at[found] ^ m)])

    near(at[first], fp[first], [1 << i for i in range(WIDTH)])
    c_at, c_fp = at[center], fp[center]
    c_group = c_at >> 16
    alone = np.ones(len(c_at), bool)
    alone[1:] &= c_group[1:] != c_group[:-1]
    alone[:-1] &= c_group[1:] != c_group[:-1]
    if (~alone).any():
        near(c_at[~alone], c_fp[~alone], [sum(1 << i for i in bits) for n in (2, 3) for bits in combinations(range(WIDTH), n)])
    a, b = np.concatenate(a), np.concatenate(b)
    verified = np.bitwise_count(a ^ b) <= RADIUS
    return a[verified], b[verified]


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): every variant of every row's fingerprint. A key's high 16 bits number the wildcard block."""
    left = lambda n: F.shiftleft("fp", n).bitwiseOR(F.shiftrightunsigned("fp", 64 - n)) if n else F.col("fp")
    bases = [left(WIDTH * j).bitwiseAND(F.lit(_REST)).bitwiseOR(F.lit(j << 48)) for j in range(BLOCKS)]
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(64 - WIDTH)])
    each = fps.select("fp", F.explode(F.array(*bases)).alias("base"))
    return each.select("fp", "base", F.explode(flips).alias("flip")).select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def links(fps: DataFrame, n_fps: int) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of fps (fp) within RADIUS bits."""

    def link(batches):
        keys, fps = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy().view(np.uint64))
            fps.append(batch.column(1).to_numpy().view(np.uint64))
        if keys:
            a, b = group_links(np.concatenate(keys), np.concatenate(fps))
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    parts = max(shuffle_parts(fps.sparkSession), parts_for(n_fps * VARIANTS, TASK_VARIANTS))
    # Few fingerprints make many variants: they are dealt before they are made.
    return variants(fps.repartition(parts)).repartition(parts, "key").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id per row of docs (doc_id, text): component_id is the least doc_id that
    is reachable over links.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null doc_id take
    part; a component of them alone has a null id. Repeated rows repeat. No rows give no rows.
    Copies meet as one fingerprint before any variant is made.
    """
    spark = docs.sparkSession
    each = written(fingerprints(docs), "simhash-fp")
    distinct = written(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    total, fps = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = written(links(distinct.select("fp"), fps), "simhash-links")
    roots = components(found, "simhash-cc")
    labelled = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    remove(spark, found)
    remove(spark, distinct)
    remove(spark, roots)
    ids = written(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-ids")
    named = written(join_counted(labelled.withColumnRenamed("n", "copies"), ids, ["root"], fps).select("fp", "component_id", F.col("copies").alias("n")), "simhash-named")
    remove(spark, labelled)
    remove(spark, ids)
    return join_counted(each, named, ["fp"], total).select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
