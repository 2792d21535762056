import random
from collections import Counter

import numpy as np
import pytest

from lakewright.llm import substrings
from lakewright.llm.fmindex import FMIndex, WaveletMatrix, repeated_windows, suffix_array


def brute_windows(seq, sizes, window):
    """The windows at each position, None where there is none or it stands only once."""
    out, at = [None] * len(seq), 0
    for n in sizes:
        for i in range(n - window + 1):
            out[at + i] = tuple(seq[at + i : at + i + window])
        at += n
    n = Counter(out)
    return [w if n[w] > 1 else None for w in out]


def brute(docs, window=20):
    first, out = {}, []
    words = {k: (t or "").encode().split() for k, t in enumerate(t for _, t in docs)}
    place = [(-1 if i is None else i) for i, _ in docs]
    for k, w in words.items():
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, (1 << 60, 0)), (place[k], p))
    for k, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (place[k], p):
                gone |= set(range(p, p + window))
        out.append((docs[k][0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(0)
    s = np.append(rng.integers(1, 4, 200), 0)
    sa, rank = suffix_array(s, 4)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    first = [tuple(s[i : i + 4]) for i in range(len(s))]
    assert all((rank[i] == rank[j]) == (first[i] == first[j]) for i in range(0, 200, 3) for j in range(200))
    m = WaveletMatrix(s, 2)
    for c in range(4):
        start = m.mapped(np.array([0]), np.array([c]))
        for i in (0, 1, 63, 64, 65, 128, 201):
            assert m.mapped(np.array([i]), np.array([c]))[0] - start[0] == np.count_nonzero(s[:i] == c)


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(1)
    s = np.append(rng.integers(1, 5, 300), 0)
    index = FMIndex(s.astype(np.int32), 5, 4)
    for n in (1, 2, 4):
        for i in range(0, 290, 13):
            lo, hi = np.array([0]), np.array([len(s)])
            for c in s[i : i + n][::-1]:
                lo, hi = index.extend(lo, hi, np.array([c]))
            places = [j for j in range(len(s) - n + 1) if (s[j : j + n] == s[i : i + n]).all()]
            assert hi[0] - lo[0] == len(places)
            if n == 4:
                longer = index.extend(lo, hi, np.array([s[i - 1]])) if i else (lo, hi)
                k, low, high = index.cut(longer[0])
                same = [j for j in range(len(s) - n + 1) if (s[j : j + n] == s[max(i - 1, 0) : max(i - 1, 0) + n]).all()]
                assert high[0] - low[0] == len(same) and (k[0] >= 0) == (len(same) > 1)


def test_windows():
    rng = random.Random(4)
    for _ in range(60):
        letters, window = rng.choice([2, 3, 30]), rng.choice([2, 5, 20])
        base = [rng.randrange(1, letters + 1) for _ in range(80)]
        seqs = []
        for _ in range(rng.randrange(1, 10)):
            a = rng.randrange(50)
            s = base[a : a + rng.randrange(window, 31) if window < 30 else a + 30]
            s[rng.randrange(len(s))] = rng.randrange(1, letters + 1)
            seqs.append(s)
        sizes = np.array([len(s) for s in seqs])
        seq = np.concatenate(seqs)
        got, windows = repeated_windows(seq, sizes, letters + 1, window).tolist(), brute_windows(seq.tolist(), sizes, window)
        assert [k >= 0 for k in got] == [w is not None for w in windows]
        assert len(set(got)) == len(set(windows)) == len(set(zip(got, windows)))


def documents():
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 60]))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        docs.append((i * 3, "\n ".join(w)))
    docs += [(1, docs[9][1]), (500, docs[9][1]), (None, docs[7][1]), (501, None), (502, ""), (503, "short text"), (504, "again and " * 5000), (505, "a b c d e " * 30)]
    docs += [(docs[4][0], docs[4][1])]
    # Other texts under one id, or none; the second has at the same place what the first has.
    docs += [(30, "x y " + docs[5][1]), (600, docs[12][1]), (600, docs[13][1]), (600, "z " + docs[13][1]), (None, docs[14][1]), (None, "q r " + docs[14][1]), (None, docs[3][1])]
    return docs


@pytest.mark.parametrize("frequent,heavy", [(4096, 16), (2, 16), (4096, 1)])
def test_against_brute_force(spark, monkeypatch, frequent, heavy):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "HEAVY_LEAST", heavy)
    monkeypatch.setattr(substrings, "SAMPLE", 64 // heavy if heavy > 1 else 1)
    docs = documents()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicated(df).collect()), key=str)
    assert got == brute(docs)


def test_no_rows(spark):
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
