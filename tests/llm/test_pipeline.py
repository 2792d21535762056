from pyspark.sql import functions as F

import corpus_pipeline
from lakewright.llm import decontaminate, simhash, toxicity
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_simhash import roots, slow_fingerprint
from tests.llm.test_substrings import brute as brute_words


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, "long words " * 20000, "en", None, 5)]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema)).withColumn("extra", F.lit("x"))
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    clean = stage["toxicity"](spark, docs, sf_dir)
    machine = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.scored(docs, machine).collect()}
    assert set(rows(clean)) == {i for i, p in scores.items() if not p} and clean.columns == corpus_pipeline.COLUMNS

    own = rows(clean)
    fps = {i: slow_fingerprint((r.text or "").encode()) for i, r in own.items()}
    root, least = roots(sorted(set(fps.values()))), {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    distinct = stage["near duplicates"](spark, clean, sf_dir)
    assert set(rows(distinct)) == set(least.values())

    own = rows(distinct)
    cut = stage["substring dedup"](spark, distinct, sf_dir)
    got = rows(cut)
    want = {i: (removed, kept) for i, _, removed, kept in brute_words([(i, r.text) for i, r in own.items()])}
    assert set(got) == set(want)
    for i, (removed, kept) in want.items():
        assert got[i].text == (kept if removed else own[i].text) and got[i].source == own[i].source

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, *_ in brute_items([(i, r.text) for i, r in got.items()], items)}
    left = stage["decontamination"](spark, cut, sf_dir)
    assert set(rows(left)) == set(got) - bad

    final = stage["mixing"](spark, left, sf_dir)
    assert final.columns == [*corpus_pipeline.COLUMNS, "copy"]
    texts = {i: r.text for i, r in rows(left).items()}
    assert all(r.text == texts[r.doc_id] for r in final.collect())


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_clashing_columns_and_null_ids(spark, sf_dir):
    docs = spark.createDataFrame([(None, "w " * 40, "en", "s", 80, "k"), (1, "some words here " * 9, "en", "s", 5, "k")], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name in ("cut_id", "kept_id", "copy", "fp", "part", "size"):
        docs = docs.withColumn(name, F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == 2
    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, sf_dir).collect()} == {None, 1}


def test_run_twice_gives_the_same(spark, sf_dir):
    first, second = (sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert first == second and first


def test_rows_that_share_an_id_stay_apart(spark, sf_dir):
    text = lambda k, n=60: " ".join(f"t{k}w{j}" for j in range(n))
    shared = " ".join(f"s{j}" for j in range(30))
    texts = [(None, text(0)), (None, text(1)), (None, text(2) + " " + shared), (7, text(3)), (7, text(4)), (7, text(5) + " " + shared), (8, text(3)), (None, text(4)), (9, text(6)), (9, text(6))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    distinct = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    want = [*texts[:6], texts[8]]  # the least id of each group of copies, and every text without one
    assert pairs(distinct) == sorted(want, key=str)
    cut = corpus_pipeline.substring_dedup(spark, docs.limit(6), sf_dir)
    assert pairs(cut) == sorted([*texts[:5], (7, text(5))], key=str)
    left = corpus_pipeline.decontamination(spark, cut, sf_dir)
    mixed = corpus_pipeline.mix(spark, left, sf_dir).collect()
    assert len({(r.doc_id, r.text, r.copy) for r in mixed}) == len(mixed) and {(r.doc_id, r.text) for r in mixed} <= set(pairs(left))
    size = {r.text: 0 for r in mixed}
    for r in mixed:
        size[r.text] += 1
    assert max(size.values()) <= 3 and sum(r.doc_id is None for r in mixed)
