import hashlib
import random

from lakewright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window int"


def rows():
    rng = random.Random(3)
    out = [(1, 0, "system", "be <|kind|> & brief", 0), (1, 1, "user", None, 0), (1, 2, "assistant", "<|end|>\n</s>", 0)]
    for i in range(60):
        out.append((2, i, ("user", "assistant")[i % 2], " ".join(rng.choices(["a", "<b", "c&lt;", "d\n"], k=rng.choice([1, 20, 90, 700]))), 0))
    out += [(2, 30, "system", "late system", 0), (None, None, None, None, 0), (None, 3, "assistant", "x", 0), (None, 3, "assistant", "x", 0)]
    out += [(3, i, "assistant", "", 0) for i in range(300)]
    return out


def test_windows(spark):
    turns = spark.createDataFrame(rows(), SCHEMA)
    windows = chat.read_turns(chat.formatted(turns)).collect()
    by = {}
    for w in sorted(windows, key=lambda w: w.window):
        by.setdefault(w.conv_id, []).append(w)
    want = {}
    for r in rows():
        want.setdefault(r[0], []).append((-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    for conv, own in by.items():
        expected = [t[1:] for t in sorted(want[conv])]
        assert [(t.role, t.text) for w in own for t in w.turns] == expected
        assert [x for w in own for x in w.targets] == [t for role, t in expected if role == "assistant"]
        for w in own:
            assert w.tokens <= chat.BUDGET or w.n_turns - w.n_repeated == 1
            assert w.text.count("<|end|>\n") == w.n_turns
    assert len(by[2]) > 5 and any(w.n_repeated for w in by[2])
    late = [w for w in by[2] if "late system" in w.text]
    assert all(w.text.startswith("<|system|>\nlate system") for w in late[1:]) and len(late) > 1


def test_digests_and_empty(spark):
    turns = spark.createDataFrame(rows(), SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("system\nbe <|kind|> & brief\nuser\n\nassistant\n<|end|>\n</s>\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"<|end|>\n</s>").hexdigest() and got[1].loss_chars == 12
    assert got[3].n_turns == 300 and got[3].loss_chars == 0 and got[None].n_turns == 3
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    turns = spark.createDataFrame(rows(), SCHEMA)
    plan = chat.digests(chat.formatted(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
