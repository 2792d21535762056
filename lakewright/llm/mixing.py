"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's target over its
size. Within a source the documents stand in order of size (then of a hash of their id), the
expected copies are summed along that order, one pseudo-random offset is added, and a document is
emitted once for each integer that its stretch of the sum crosses. As neighbours have like sizes,
the words taken differ from the target by less than about one longest document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, prefix_sums, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
NO_SOURCE = "~"  # after every "=" + source


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """Adds weight and target to a table (skey, source_size), one row per source: its windows take the sources into one task.

    Sources by code point take the weights in turn and share the sum of all sizes by weight; a
    target stops at cap times its source's size, and the excess is reshared by weight until none
    is above. In order of size over weight the capped sources come first, so one pass finds the
    share per weight: the first source whose share stays within its cap ends the capped ones.
    """
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    every = Window.partitionBy(F.lit(1))
    filled = (
        weighted.withColumn("rank", F.row_number().over(fill))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(every) - F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("weight"))
        .withColumn("share", (F.col("total") - F.col("capped")).cast("double") / F.col("left"))
        .withColumn("fits", F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("rank", "share")))
        .withColumn("per_weight", F.min("fits").over(every)["share"])
    )
    target = F.least(F.coalesce(F.col("per_weight"), F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double"))
    return filled.select("skey", "source_size", "weight", target.alias("target"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MOST_COPIES, seed: str = SEED, key: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of docs (doc_id, text, source).

    size: words of the text (null or empty: 0). A null source is a source of its own, after all
    others. Sources without words get target 0 and no copies. Rows with equal doc_id are separate
    documents, interchangeable in the order; a null doc_id orders as the text "null". No rows give
    no rows. Offsets come from a hash of seed and source, so reruns agree. Columns of docs in key,
    without nulls, order rows with equal doc_id and stay beside the others.
    """
    slim = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *key)
    slim = slim.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(NO_SOURCE)))
    slim = slim.withColumn("one", F.lit(1).cast("long")).withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = written(slim, "mix-sizes")  # texts are read once
    ranked = prefix_sums(slim, ["skey"], ["size", "tie", *key], {"before": "one"}, "mix")
    targets = source_targets(slim.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "skey")), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", offset)
    crossed = lambda n: F.floor(F.col("offset") + F.col("rate") * n)
    return (
        ranked.join(targets, "skey")
        .withColumn("copies", crossed(F.col("before") + 1) - crossed(F.col("before")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *key)
    )


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: docs' rows, each as often as ``mixed`` says, with a column copy (from 0).

    Rows with equal or null doc_id are documents of their own: each has a number here. A column of
    docs with the name copy is replaced.
    """
    docs = keyed(docs.drop("copy"), "__row", "mix-rows")
    chosen = mixed(docs, **options, key=["__row"]).filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))
    return docs.join(chosen, "__row").drop("__row")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '{NO_SOURCE}') AS skey,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS rank,
    (sum(source_size) OVER ())::BIGINT - (coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remains,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS wleft
  FROM w WINDOW o AS (ORDER BY source_size / weight, skey)),
g AS (SELECT *, remains::DOUBLE / wleft AS share FROM f),
p AS (SELECT min_by(share, rank) AS per_weight FROM g WHERE share * weight <= cap),
t AS (SELECT skey, source_size, least(coalesce(per_weight, 0.0::DOUBLE) * weight, cap::DOUBLE) AS target,
    ('0x' || substr(md5('{SEED}' || skey), 1, 5))::INT / 1048576.0::DOUBLE AS off FROM g, p),
r AS (SELECT doc_id, size, skey, row_number() OVER (PARTITION BY skey ORDER BY size, md5(doc_id::VARCHAR)) AS n FROM d)
SELECT doc_id, size, source_size, target,
  ((floor(off + rate * n) - floor(off + rate * (n - 1))) * size)::BIGINT AS taken
FROM (SELECT r.*, source_size, target, off, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM r JOIN t USING (skey))
"""
