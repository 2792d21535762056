import numpy as np

from lakewright.llm import toxicity


def machine(docs, y):
    return toxicity.fit([np.array(sorted(d)) for d in docs], np.array(y, float))


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(3000):
        d = set(rng.integers(100, 140, 5).tolist())
        a, b = rng.random(2) < 0.5
        d |= {1} if a else set()
        d |= {2} if b else set()
        docs.append(d)
        y.append(a and b)
    m = machine(docs, y)
    score = lambda d: m.scores([(r := m.row[np.array(sorted(d))])[r >= 0].astype(int)])[0]
    assert score({1, 2, 100}) > 0.7 and max(score({1, 100}), score({2, 100}), score({100})) < 0.3


def test_pairs_of_neutral_terms_are_learned():
    """Each of two terms is as frequent in toxic as in other texts; only both or neither together are toxic."""
    rng = np.random.default_rng(1)

    def drawn(n):
        docs, y = [], []
        for _ in range(n):
            a, b = rng.random(2) < 0.5
            docs.append(set(rng.integers(100, 140, 5).tolist()) | ({1} if a else set()) | ({2} if b else set()))
            y.append(a == b)
        return docs, np.array(y)

    docs, y = drawn(4000)
    for term in (1, 2):
        assert abs(y[[term in d for d in docs]].mean() - y.mean()) < 0.05
    m = machine(docs, y)
    fresh, want = drawn(1000)
    score = m.scores([(r := m.row[np.array(sorted(d))])[r >= 0].astype(int) for d in fresh])
    assert ((score > 0.5) == want).mean() > 0.99


def test_logits_are_the_plain_formula():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.arange(10), 0.3, rng.normal(size=10), rng.normal(size=(10, 3)))
    docs = [np.array([1, 4, 7]), np.zeros(0, int), np.array([2]), np.zeros(0, int)]
    want = [0.3 + m.w[d].sum() + sum(m.v[i] @ m.v[j] for i in d for j in d if i < j) for d in docs]
    sizes = np.array([len(d) for d in docs])
    assert np.allclose(m.logits(np.concatenate(docs), np.cumsum(sizes) - sizes), want)


def test_odd_rows_and_no_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.trained(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "Idiot idiot scum", 1), (1, None, 1), (3, "x " * 100000, 1)], "doc_id long, text string, score int")
    rows = toxicity.scored(odd, m).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert rows[0].score == rows[1].score == rows[3].score
    assert toxicity.scored(odd.limit(0), m).count() == 0
    none = toxicity.trained(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.scored(odd, none).collect()} == {0}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.trained(docs, labels)
    held = toxicity.scored(docs, m).join(labels.filter(toxicity.crc_mod("doc_id", 4) == 2), "doc_id").toPandas()
    hit = held[held.toxic == 1].predicted.mean()
    false = held[held.toxic == 0].predicted.mean()
    assert hit >= 0.8 and false <= 0.02
