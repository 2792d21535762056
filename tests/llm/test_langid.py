import math

import numpy as np

from lakewright.llm import langid


def segmentations(word, ids, longest):
    if not word:
        yield []
        return
    for j in range(1, min(len(word), longest) + 1):
        piece = ids.get(word[:j], 0 if j == 1 else None)
        if piece is not None:
            for rest in segmentations(word[j:], ids, longest):
                yield [piece, *rest]


IDS = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "ba": 6, "aba": 7}


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    p = rng.random((8, 3))
    words = ["", "a", "ab", "abab", "bax", "aabbaba", "zz"]
    order, scores = langid.word_scores(words, IDS, 3, p)
    for w, row in zip(order, scores):
        for k in range(3):
            want = sum(math.prod(p[i, k] for i in s) for s in segmentations("▁" + w, IDS, 3))
            assert math.isclose(row[k], math.log(want), rel_tol=1e-9)


def test_long_words_do_not_underflow():
    p = np.full((8, 2), 1e-4)
    p[:, 1] = 1e-5
    order, scores = langid.word_scores(["ab" * 3000], IDS, 3, p)
    assert np.isfinite(scores).all() and scores[0, 0] > scores[0, 1]


def test_expected_counts():
    rng = np.random.default_rng(1)
    p = rng.random(8)
    words, n = ["abab", "ba"], np.array([3.0, 2.0])
    want = np.zeros(8)
    for w, k in zip(words, n):
        all_ = list(segmentations("▁" + w, IDS, 3))
        weight = [math.prod(p[i] for i in s) for s in all_]
        for s, x in zip(all_, weight):
            for i in s:
                want[i] += k * x / sum(weight)
    assert np.allclose(langid.expected_counts(words, n, IDS, 3, p), want)


def test_held_out_accuracy_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.trained(docs)
    want = {r.doc_id: r.lang for r in docs.filter(langid.crc_mod("doc_id", 4) == 2).collect()}
    got = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    right = [got[i].lang_pred == lang for i, lang in want.items()]
    assert sum(right) >= 0.95 * len(right)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 345 .", "x"), (None, "und der die", "x"), (4, "und" * 2000, "x"), (4, "the of and", "x")], "doc_id long, text string, score string")
    rows = langid.predicted(odd, model).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0.0] * 3
    assert all(r.lang_pred in model.langs and 0 <= r.score <= 1 for r in rows[3:])
    assert langid.predicted(odd.limit(0), model).count() == 0
    nothing = langid.trained(docs.filter("doc_id < 0"))
    assert {r.lang_pred for r in langid.predicted(odd, nothing).collect()} == {"und"}


def test_counts_in_logs_are_the_counts():
    rng = np.random.default_rng(2)
    p = rng.random(8)
    words, n = ["abab", "ba", "aabbaba", "z"], np.array([3.0, 2.0, 1.0, 4.0])
    plain = langid.expected_counts(words, n, IDS, 3, p)
    assert np.allclose(langid.expected_counts_in_logs(words, n, IDS, 3, p), plain)
    every = langid.all_expected_counts([*words, "ab" * 4000], np.append(n, 2.0), IDS, 3, p)
    assert np.isfinite(every).all() and every.sum() > plain.sum() + 2 * 8000 / 3
    # Each character is in one piece of every segmentation.
    size = np.array([1, 1, 1, 1, 2, 2, 2, 3])
    assert math.isclose(every @ size, plain @ size + 2 * 8001)


def test_smallest_hashes_of_each_language(spark):
    df = spark.range(60000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', IF(id % 30000 = 1, 'rare', 'b')) AS lang")
    got = {r.doc_id for r in langid._smallest(df, 100).collect()}
    rows = df.selectExpr("doc_id", "lang", "shiftrightunsigned(xxhash64(doc_id), 11) AS h").collect()
    want = set()
    for lang in ("a", "b", "rare"):
        want |= {r.doc_id for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (r.h, r.doc_id))[:100]}
    assert got == want


def test_words_without_spaces_are_fitted(spark):
    docs = spark.createDataFrame([(i, ("ab" if i % 2 else "xy") * 60, "one" if i % 2 else "two") for i in range(60)], "doc_id long, text string, lang string")
    model = langid.trained(docs)
    assert model.langs == ["one", "two"]
    assert {(r.doc_id % 2, r.lang_pred) for r in langid.predicted(docs, model).collect()} == {(1, "one"), (0, "two")}
