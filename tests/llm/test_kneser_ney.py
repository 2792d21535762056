import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import kneser_ney as kn


class Plain:
    """The model by the book, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.c = order, {k: Counter() for k in range(1, order + 1)}
        self.uni = Counter()
        for t in texts:
            tokens = [*t.encode().lower().split(), None]
            self.uni.update(tokens)
            padded = ["start"] * (order - 1) + tokens
            self.c[order].update(tuple(padded[i : i + order]) for i in range(len(tokens)))
        for k in range(order - 1, 0, -1):
            self.c[k].update(g[1:] for g in self.c[k + 1])
        self.d = {k: self.discounts(c.values()) for k, c in self.c.items()}
        self.total, self.kinds = Counter(), defaultdict(Counter)
        for c in self.c.values():
            for g, n in c.items():
                self.total[g[:-1]] += n
                self.kinds[g[:-1]][min(n, 3)] += 1

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        if not (n[1] and n[2] and n[3]):
            return {0: 0, 1: 0.5, 2: 0.75, 3: 1.0}
        y = n[1] / (n[1] + 2 * n[2])
        d = {0: 0}
        for k in (1, 2, 3):
            d[k] = min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05)
        return d

    def p(self, gram):
        """P(the last | the others)."""
        if not gram:
            return 1 / (len(self.uni) + 1)
        k, context = len(gram), gram[:-1]
        if not self.total[context]:
            return self.p(gram[1:])
        n, d = self.c[k][gram], self.d[k]
        left = sum(d[x] * m for x, m in self.kinds[context].items())
        return (max(n - d[min(n, 3)], 0) + left * self.p(gram[1:])) / self.total[context]

    def score(self, text):
        padded = ["start"] * (self.order - 1) + [*text.encode().lower().split(), None]
        return sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(padded) - self.order + 1))

    def base(self, text):
        n, v = sum(self.uni.values()), len(self.uni)
        return sum(math.log10((self.uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*text.encode().lower().split(), None])


def texts():
    rng = random.Random(2)
    out = [" ".join(rng.choices(["The", "the", "a", "cat", "dog", "sat", "on", "mat", f"x{i % 9}"], weights=[9, 9, 5, 3, 3, 2, 2, 1, 1], k=rng.randrange(0, 60))) for i in range(80)]
    return out + ["", "never seen words", "the " * 30000]


@pytest.mark.parametrize("order,bucket", [(3, 1 << 20), (3, 2000), (2, 2000), (4, 5000)])
def test_scores_are_the_plain_model(spark, monkeypatch, order, bucket):
    monkeypatch.setattr(kn, "BUCKET_BYTES", bucket)
    own = texts()
    docs = [(i, t) for i, t in enumerate(own)] + [(None, "the cat"), (500, None), (3, own[3]), (3, own[5]), (None, own[7])]
    df = spark.createDataFrame([(*d, k, 1) for k, d in enumerate(docs)], "doc_id long, text string, row long, kind int")
    trains = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    plain = Plain([t or "" for i, t in docs if trains(i)], order)
    for context in (("start",) * (order - 1), ("the",) * (order - 1), ("cat",) * (order - 1)):
        assert abs(sum(plain.p((*context, w)) for w in plain.uni) + plain.p((*context, "new")) - 1) < 1e-9
    got = kn.scored(df, ~kn.held_out(), order).collect()
    want = []
    for i, t in docs:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((i, len(tokens), sum(plain.uni[w] > 0 for w in tokens), sum(plain.uni.values()), plain.base(t or ""), plain.score(t or "")))
    key = lambda r: tuple((-1 if x is None else x) for x in r[:3]) + (round(r[4], 6),)
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:4] == w[:4] and math.isclose(r[4], w[4], rel_tol=1e-9) and math.isclose(r[5], w[5], rel_tol=1e-9)


def test_no_rows_and_no_training(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert kn.scored(df.limit(0), F.lit(True)).count() == 0
    (r,) = kn.scored(df, F.lit(False)).collect()
    assert r.score == 0 and r.base_score == 0 and r.n_known == 0


def test_planes_and_maps():
    h = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (kn.ascending(kn.deltas(h).ravel()) == h).all()
    assert (kn.in_memory_map(h) == h).all()


def test_held_out_text_is_likelier_than_without_context(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    held = kn.scored(docs, ~kn.held_out()).filter(kn.held_out()).toPandas()
    assert kn.perplexity(held.score.sum(), held.n_tokens.sum()) < kn.perplexity(held.base_score.sum(), held.n_tokens.sum())
    assert pytest.approx(held.train_tokens.iloc[0]) == held.train_tokens.max()
