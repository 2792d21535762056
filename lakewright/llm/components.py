"""Connected components of a distributed graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written

#: Neighbours of one node are spread over so many keys to meet the node's minimum.
SALTS = 16


def _with_minimum(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the smallest v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least.hint("shuffle_merge"), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for each node of edges (a, b), both long and not null; root is the component's least node.

    Loops and repeated edges do no harm; no edges give no rows. Each round is written to the shared
    folder; rounds grow with the logarithm of the longest path. A hub's neighbours are spread over
    SALTS keys, and minima are taken before rows meet.
    """
    spark = edges.sparkSession
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    state = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_minimum(large.distinct())
        star = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        last, now = now, written(star, label)
        remove(spark, last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
