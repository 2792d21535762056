import os

from pyspark.sql import functions as F

from lakewright.llm import chat, common, simhash


def test_hot_keys_are_broadcast_and_joined_like_others(spark):
    rows = spark.range(30000).select(F.when(F.col("id") < 10000, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = common.join_counted(rows, table, ["k"], 30000)
    want = rows.join(table.drop("n"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert common.join_counted(rows.limit(0), table.limit(0), ["k"], 0).count() == 0


def test_rows_of_files_are_keyed_where_they_are(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 3 AS doc_id", "'same' AS text")
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    keyed = common.keyed(read.filter("doc_id < 2").select("doc_id", "text"), "row", "test-rows")
    keys = [r.row for r in keyed.collect()]
    assert len(set(keys)) == len(keys) == 667 and "Exchange hash" not in keyed._jdf.queryExecution().toString()
    assert {r.row for r in keyed.select("row").collect()} == set(keys)
    other = common.keyed(read.unionAll(read), "row", "test-rows")
    keys = [r.row for r in other.collect()]
    assert len(set(keys)) == len(keys) == 2000
    common.remove(spark, read)  # not ours
    assert os.path.isdir(tmp_path / "t")
    common.remove(spark, other)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in other.inputFiles())


def test_a_third_of_the_rows_on_one_fingerprint(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, concat('words of document number ', id, ' and ', id * 7, ' or ', id * 13)) AS text")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(rows) == 3000 and {rows[i].component_id for i in range(0, 3000, 3)} == {0} and rows[0].fp == 0


def test_a_third_of_the_turns_in_one_conversation(spark):
    said = "IF(id < 1000, IF(id = 0, 'system', IF(id % 2 = 0, 'assistant', 'user')), IF(id % 2 = 0, 'user', 'assistant'))"
    turns = spark.range(3000).selectExpr("IF(id < 1000, -7, id div 4) AS conv_id", "id AS turn", f"{said} AS role", "concat('turn ', id, repeat(' word', 30)) AS text")
    windows = chat.formatted(turns)
    long = windows.filter("conv_id = -7").collect()
    assert len(long) > 50 and all("<|system|>" in r.text and r.tokens <= chat.BUDGET for r in long)
    digest = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert digest[-7].n_turns == 1000 and len(digest) == 501
