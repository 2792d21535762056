"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item counts as contained in a document if the document has at least ``threshold`` of the
item's distinct shingles of five words (letters A-Z lower-cased). An item of fewer words is one
shingle, the whole sequence, and looked for among the document's runs of as many words; an item
without words is contained in nothing.

Items are partitioned by size (powers of two of their shingle count). An item's sketch is a
bottom-k MinHash: its k smallest shingle hashes, where k is one more than the shingles that a
containing document may miss. By the pigeonhole principle every such document has one of them, so
the search loses nothing, however long the document is: a fixed signature of a long document would
hold none of a short item's hashes. A document probes with all its shingle hashes the partitions
whose items are small enough for it. Colliding pairs are verified by exact containment of the
shingles' bytes.

The items are the stated query set: they are read in blocks of bounded size, each block is
broadcast, and the documents are scanned where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, bound_batches, gram_hashes, word_hashes

SHINGLE = 5
THRESHOLD = "0.8"
#: Shingles of items in one broadcast block.
BLOCK_SHINGLES = 500_000
SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_common long, containment double"


def shingles(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    """The distinct runs of n words."""
    return set(map(b" ".join, zip(*(words[i:] for i in range(n)))))


class Block:
    """A block of items: sketches by shingle length and size partition, and the shingles for the verification."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, threshold: Fraction):
        self.threshold, self.items = threshold, []
        sketches: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in items:
            words = text.lower().split()
            if not words:
                continue
            length = min(n, len(words))
            exact = shingles(words, length)
            q = len(exact)
            most_missed = q - int(-(-q * threshold // 1))
            hashes = np.unique(gram_hashes(word_hashes(words), length))[: most_missed + 1]
            sketches.setdefault(length, {}).setdefault(q.bit_length(), []).extend((int(h), len(self.items)) for h in hashes)
            self.items.append((item_id, length, exact))
        #: By shingle length: low bits of all sketches, and the size partitions.
        self.sketches: dict[int, tuple[np.ndarray, list]] = {}
        for length, by_size in sketches.items():
            low, partitions = np.zeros(1 << 20, bool), []
            for pairs in by_size.values():
                pairs.sort()
                least = min(len(self.items[i][2]) for _, i in pairs)
                partitions.append((-(-least * threshold // 1), np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs])))
                low[(partitions[-1][1] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.sketches[length] = low, partitions

    def candidates(self, words: list[bytes]) -> set[int]:
        hashes, found = word_hashes(words), set()
        for length, (low, partitions) in self.sketches.items():
            h = gram_hashes(hashes, length)
            h = h[low[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            if not len(h):
                continue
            for least, sketch, item in partitions:
                if len(words) >= least:  # a document has no more shingles than words
                    lo, hi = np.searchsorted(sketch, h, "left"), np.searchsorted(sketch, h, "right")
                    for a, b in zip(lo[hi > lo], hi[hi > lo]):
                        found.update(item[a:b].tolist())
        return found

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item_id, shingles of the item, of which in the text) of each contained item."""
        words = text.lower().split()
        if not (found := self.candidates(words)):
            return []
        own: dict[int, set[bytes]] = {}
        out = []
        for i in sorted(found):
            item_id, length, exact = self.items[i]
            if length not in own:
                own[length] = shingles(words, length)
            common = len(exact & own[length])
            if common >= self.threshold * len(exact):
                out.append((item_id, len(exact), common))
        return out


def item_blocks(items: DataFrame, n: int, threshold: Fraction) -> Iterator[Block]:
    block, held = [], 0
    for item_id, text in items.select("item_id", F.encode("text", "UTF-8")).toLocalIterator():
        text = bytes(text or b"")
        block.append((item_id, text))
        held += max(1, text.count(b" "))
        if held >= BLOCK_SHINGLES:
            yield Block(block, n, threshold)
            block, held = [], 0
    if block:
        yield Block(block, n, threshold)


def contained_items(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: str = THRESHOLD) -> DataFrame:
    """A row per document row and item row with containment of at least threshold (SCHEMA).

    docs (doc_id, text), items (item_id, text). Null and empty texts contain nothing and are
    contained in nothing; repeated rows give repeated pairs; a null id stays null; no documents or
    no items give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    schema, out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_shingles", pa.int64()), ("n_common", pa.int64()), ("containment", pa.float64())]), None
    for block in item_blocks(items, n, Fraction(threshold)):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            block = shared.value
            for batch in batches:
                rows = [(doc_id, *m, m[2] / m[1]) for doc_id, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))) if text for m in block.matches(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def without_contained(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: str = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that contain no item; they are filtered where they are."""
    spark = docs.sparkSession
    bound_batches(spark)
    at = docs.columns.index("text")
    for block in item_blocks(items, n, Fraction(threshold)):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            block = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not (text and block.matches(text)) for text in binaries(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g FROM iw, range(1, greatest(len(w) - 3, 2)) r(p) WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM dw, (SELECT DISTINCT k FROM i) l(k), range(1, len(w) - k + 2) r(p)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN i USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_common, c::DOUBLE / n AS containment FROM c JOIN n USING (item_id) WHERE c * 10 >= n * 8
"""
