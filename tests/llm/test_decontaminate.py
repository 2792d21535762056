import random

from lakewright.llm import decontaminate as d


def brute(docs, items):
    out = []
    runs = lambda w, n: {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
    for i, t in docs:
        words = (t or "").lower().split()
        own = {n: runs(words, n) for n in range(1, 6)}
        for k, x in items:
            item = (x or "").lower().split()
            n = min(5, len(item))
            want, own_ = (runs(item, n), own[n]) if n else (set(), set())
            if want and len(want & own_) * 10 >= len(want) * 8:
                out.append((i, k, len(want), len(want & own_)))
    return sorted(out, key=str)


def test_all_contained_items_are_found(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 9, 30, 60, 200])))) for k in range(40)]
    items += [(100, None), (101, ""), (102, "One two"), (None, "null id item with seven words here"), (103, items[3][1])]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([4, 50, 3000])))) for i in range(60)]
    for i in range(60):
        k, text = items[i % 40]
        t = text.upper().split() if i % 2 else text.split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(len(t))] = "changed"
        j = rng.randrange(len(docs))
        docs.append((1000 + i, docs[j][1] + " " + " \n".join(t) + " " + docs[j][1]))
        half = len(t) // 2  # in two places far apart
        docs.append((2000 + i, " ".join(t[: half + 4]) + " " + docs[j][1] + " " + " ".join(t[half:])))
    docs += [(None, items[5][1]), (7, None), (8, ""), (9, "ONE TWO"), (10, "x one two"), (11, "one more two"), (1, docs[1][1])]
    got = d.contained_items(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    assert (10, 102, 1, 1) in brute(docs, items) and (11, 102, 1, 1) not in brute(docs, items)
    assert sorted(((r.doc_id, r.item_id, r.n_item_shingles, r.n_common) for r in got.collect()), key=str) == brute(docs, items)
    few = spark.createDataFrame(items, "item_id long, text string")
    assert d.contained_items(spark.createDataFrame(docs, "doc_id long, text string").limit(0), few).count() == 0
    assert d.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), few.limit(0)).count() == 0


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    items = [(k, f"a b c d e f g h i j k{k} l m n o p") for k in range(30)]
    docs = [(i, f"z z a b c d e f g h i j k{i} l m n o p z") for i in range(30)]
    dd, di = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(d.contained_items(dd, di).collect())
    monkeypatch.setattr(d, "BLOCK_SHINGLES", 64)
    assert sorted(d.contained_items(dd, di).collect()) == whole and len(whole) == 30
