import random

import numpy as np
from xxhash import xxh64_intdigest

from lakewright.llm import simhash


def slow_fingerprint(text):
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def planted():
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for n in (1, 2, 3, 3, 3, 4):
            x = base
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            fps.add(x)
        block = 16 * rng.randrange(4)
        x = base
        for b in rng.sample(range(block, block + 16), 3):
            x ^= 1 << b
        fps.add(x)
    return sorted(fps)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_plain_definition():
    for text in (None, b"", b" \n", b"one", b"One two", b"a b c", b"A b c a b c a b c", "ü ñ ß x".encode() * 50):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_links_connect_what_all_pairs_connect(spark):
    fps = planted()
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, len(fps)).collect()]
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    want = roots(fps)
    assert {f: top(f) for f in fps} == want


def test_a_dense_ball_is_one_component():
    base = 0x0123456789ABCDEF
    fps = np.array([base] + [base ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(0, 64, 7) for j in range(1, 64, 9) for k in range(2, 64, 11)], np.uint64)
    fps = np.unique(fps)
    keys, rows = [], []
    for j in range(4):
        whole = simhash._rotated(fps, np.full(len(fps), j, np.uint64)) & np.uint64((1 << 48) - 1)
        for flip in [0] + [1 << i for i in range(48)]:
            keys.append((whole | np.uint64(j << 48)) ^ np.uint64(flip))
            rows.append(fps)
    a, b = simhash.group_links(np.concatenate(keys), np.concatenate(rows))
    want = roots([int(x) for x in fps])
    got = dict(zip(*(x.tolist() for x in simhash.forest(a, b))))
    assert {int(f): got.get(int(f), int(f)) for f in fps} == want


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "x"), (3, text, "y"), (9, None, "z"), (7, "", "z"), (None, text, "n"), (5, text, "x"), (11, "Alone here", None), (12, text * 40, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got[:5] == [(False, 3, 3), (False, 5, 3), (False, 5, 3), (False, 7, 7), (False, 9, 7)]
    assert (True, None, 3) in got and (False, 11, 11) in got and len(got) == 8
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_agrees_with_brute_force(spark, sf_dir):
    from lakewright.llm.queries import op2_simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = {r.doc_id: slow_fingerprint((r.text or "").encode()) for r in docs}
    root = roots(sorted(set(fps.values())))
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(root[f], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}
