from pyspark.sql import functions as F

from lakewright.llm import mixing


def test_targets_fill_by_weight_below_the_cap(spark):
    sizes = {"=a": 10, "=b": 1000, "=c": 5, "~": 400, "=d": 0}
    df = spark.createDataFrame(list(sizes.items()), "skey string, source_size long")
    got = {r.skey: r.target for r in mixing.source_targets(df).collect()}
    weight = dict(zip(sorted(sizes), (5, 2, 1, 5, 2)))
    want, total, capped = {}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[k] for k in capped)
        share = left / sum(w for k, w in weight.items() if k not in capped)
        want = {k: 3 * sizes[k] if k in capped else share * w for k, w in weight.items()}
        over = {k for k in sizes if k not in capped and want[k] > 3 * sizes[k]}
        if not over:
            break
        capped |= over
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_of_odd_rows(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 5}" if i % 7 else None) for i in range(1000)]
    rows += [(None, None, None), (5, "twice x", "s0"), (5, "twice x", "s0"), (2000, "long " * 50000, "s1"), (2001, "", "only empty")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and {r.copies for r in got} <= {0, 1, 2, 3}
    longest = {}
    for r in got:
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    for r in mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 2 * longest[r.source]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs).collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_emitted_rows(spark):
    docs = spark.createDataFrame([(i, "a b c", "x" if i % 3 else "y") for i in range(100)], "doc_id long, text string, source string")
    chosen = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    got = {}
    for r in mixing.emitted(docs).collect():
        got.setdefault(r.doc_id, []).append(r.copy)
    assert {i: len(c) for i, c in got.items()} == {i: c for i, c in chosen.items() if c}
    assert all(sorted(c) == list(range(len(c))) for c in got.values())
