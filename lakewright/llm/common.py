"""Pieces that the training-data operators share.

Words are maximal runs of bytes other than ASCII space and 0x09-0x0D, which is what
``bytes.split()`` and ``WORD`` give alike.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..shipping import ship

#: The word pattern, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one machine
    may use its own folder; a cluster has none that all share, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Lowers Spark's rows in an Arrow batch to BATCH_ROWS, if it is higher, and sees that workers find this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Folders that this process made, without the scheme of local paths: nothing else is ever deleted.
_MADE: set[str] = set()


def _plain(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    _MADE.add(_plain(path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage ends here and lost executors
    cost nothing. Shuffle files go when the write ends (a setting of the session, on from here)."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_parts(df: DataFrame, path: str, column: str) -> None:
    """Writes df under path, a folder for each value of the column; see ``written``."""
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.partitionBy(column).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def numbered(df: DataFrame, name: str, order: Column, label: str) -> DataFrame:
    """df, written, with a column name: each row's own number, ascending in the given order.

    Rows equal in it stand by a hash of all columns, so numbers follow from what rows hold; rows
    equal in all columns are interchangeable.
    """
    by = [order, F.col("__hash")]
    ranged = df.withColumn("__hash", F.xxhash64(*df.columns)).repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ranged.drop("__hash").withColumn(name, F.monotonically_increasing_id()), label)


def _is_scan(df: DataFrame) -> bool:
    """Whether df's rows are rows of files, each once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and bool(df.inputFiles())


def keyed(df: DataFrame, name: str, label: str) -> DataFrame:
    """df with a column name: each row's own number. Rows read from files go by file and place in it, which
    no retry changes, and nothing is copied; other rows are numbered as they are written."""
    if not _is_scan(df):
        return numbered(df, name, F.xxhash64(*df.columns), label)
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    # The files' names are what the driver plans the scan with.
    files = sorted(r[0] for r in placed.select("__file").distinct().collect())
    ordinals = df.sparkSession.createDataFrame(list(enumerate(files)), "__ordinal long, __file string")
    placed = placed.join(F.broadcast(ordinals), "__file")
    return placed.withColumn(name, F.shiftleft("__ordinal", 40).bitwiseOR(F.col("__place"))).select(*df.columns, name)


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with table, which has one row for each key and in n how many of the total rows have it.

    Keys of a thousandth of the rows or more, a thousand at most, are broadcast, and their rows stay where
    they are; only the rows of other keys are shuffled. So no key is a task of its own.
    """
    hot = F.col("n") * 1000 >= total
    heavy, light = table.filter(hot).drop("n"), table.filter(~hot).drop("n")
    cold = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(cold.join(light, on))


def remove(spark: SparkSession, df_or_path) -> None:
    """Deletes what ``written`` made, when no later read needs it; of other tables it deletes nothing."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {p.rpartition("/")[0] for p in df_or_path.inputFiles()}
    for path in paths:
        if _plain(path) in _MADE or _plain(path).rpartition("/")[0] in _MADE:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(amount: float, per_part: float, least: int = 1) -> int:
    return max(least, int(-(-amount // per_part)))


def crc_mod(col: str | Column, mod: int) -> Column:
    """crc32 of the id written as decimal text, modulo mod (null ids: 0)."""
    return F.coalesce(F.crc32(F.encode(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), "UTF-8")) % mod, F.lit(0))


def binaries(column: pa.Array) -> list:
    """A string column's values as bytes, nulls as None."""
    return column.cast(pa.binary()).to_pylist()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash are usable."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, from the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return mix(out)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str], label: str) -> DataFrame:
    """Adds the columns that ``sums`` names: each is the sum of its value column over the earlier rows
    of the same group, in the given order.

    No group is gathered in one task: rows are ranged over (group, order), each range sums its own
    rows, and the ranges' sums (one row per range and group) give the offsets. The ranged rows are
    written once, so that a lost executor cannot see other range bounds than the rest did.
    Group and order columns hold no nulls; rows equal in all of them are interchangeable.
    """
    ranged = written(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), label)
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__range", *group).agg(*[F.sum(v).alias(f"__of_{k}") for k, v in sums.items()])
    offsets = offsets.select("__range", *group, *[F.coalesce(F.sum(f"__of_{k}").over(before), F.lit(0)).alias(f"__of_{k}") for k in sums])
    summed = ranged.withColumns({f"__in_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    joined = summed.join(offsets, ["__range", *group]).withColumns({k: F.col(f"__of_{k}") + F.col(f"__in_{k}") for k in sums})
    return joined.drop("__range", *[f"__{x}_{k}" for k in sums for x in ("of", "in")])
