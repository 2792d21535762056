"""Chat formatting in budgeted windows, by DataFrame functions only.

A turn is written as ``<|role|>``, a line feed, its text and ``<|end|>`` with a line feed. In roles
and texts ``&``, ``<`` and ``>`` are written as entities, so no text can hold a control string and
reading is exact.

A conversation is cut into windows between turns. Running sums of turn tokens place the turns in
blocks of the budget that is left beside the system turn and the history: turns inside a block are
a window, and a turn that lies across a block's end joins that window if it still fits and is a
window of its own if not. Later windows repeat the system turn and the last turns before them, up
to HISTORY_TURNS and HISTORY_TOKENS; what is repeated is masked, so that each assistant text is a
target once. Running sums are taken over ranges of turns, and history comes from joins on the
turn's number; the system turn of a long conversation is broadcast to its turns. So a conversation of
a third of all rows is spread like any other rows. Only ``digests`` needs a conversation in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_counted, prefix_sums, written

BUDGET, HISTORY_TOKENS, HISTORY_TURNS, LEAST_SPAN = 512, 128, 4, 64
#: Tokens of a turn's marks; words are the tokens of its text.
MARKS = 4
END = "<|end|>\n"
CONV = ["no_id", "id"]


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with index (from 0), before and after (tokens), in order of turn, then role, then text."""
    rows = turns.select(
        F.col("conv_id").isNull().cast("int").alias("no_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumns({"tokens": F.regexp_count("text", F.lit(WORD)).cast("long") + MARKS, "one": F.lit(1).cast("long")})
    rows = prefix_sums(rows, CONV, ["turn", "role", "text"], {"index": "one", "before": "tokens"}, "chat-turns")
    return written(rows.select(*CONV, "index", "role", "text", "tokens", "before", (F.col("before") + F.col("tokens")).alias("after")), "chat-numbered")


def formatted(turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """conv_id, window, n_repeated, text, n_turns, tokens, loss: a row per window.

    turns (conv_id, turn, role, text). text begins with n_repeated repeated turns; loss is an array
    of (start from 0, length) in code points, one span for each assistant turn that is not
    repeated. A window has at most ``budget`` tokens unless a single turn (or system turn) alone
    is too large: no text is cut. Nulls: a null text or role is empty, a null turn comes first,
    null conversations are one. The first system turn is the one that is kept. Equal turn numbers
    go by role and text; repeated rows are turns of their own. No rows give no rows.
    """
    rows = _numbered(turns)
    spoken = F.when(F.col("role") == "system", F.struct("index", "tokens", "text"))
    system = rows.groupBy(*CONV).agg(F.min(spoken).alias("system"), F.count("*").alias("n"))
    total = rows.count()
    rows = join_counted(rows, system, CONV, total)
    span = F.greatest(F.lit(budget) - F.coalesce("system.tokens", F.lit(0)) - F.lit(history_tokens), F.lit(LEAST_SPAN))
    block, last = F.floor(F.col("before") / span), F.floor((F.col("after") - 1) / span)
    rows = rows.withColumns({"span": span, "slot": 2 * block + (block != last).cast("int")})
    slots = rows.groupBy(*CONV, "slot", "span").agg(F.min("before").alias("start"), F.max("after").alias("stop"))
    inner = slots.filter("slot % 2 = 0").select(*CONV, (F.col("slot") + 1).alias("slot"), "start")
    across = slots.filter("slot % 2 = 1").drop("start").join(inner, [*CONV, "slot"]).filter(F.col("stop") - F.col("start") <= F.col("span"))
    rows = rows.join(across.select(*CONV, "slot", F.lit(True).alias("fits")), [*CONV, "slot"], "left")
    rows = rows.withColumn("window", F.when(F.col("fits"), F.col("slot") - 1).otherwise(F.col("slot")))
    rows = written(rows.select(*CONV, "window", "index", "role", "text", "tokens", "before", "system"), "chat-windows")
    first = rows.groupBy(*CONV, "window").agg(F.min("index").alias("first"), F.min("before").alias("start"), F.min(F.when(F.col("system").isNotNull(), F.col("system.index"))).alias("system_index"))
    wanted = first.select("*", F.explode(F.sequence(F.lit(1), F.lit(history_turns))).alias("back")).filter("first >= back").withColumn("index", F.col("first") - F.col("back"))
    history = wanted.join(rows.select(*CONV, "index", "role", "text", "tokens", "before"), [*CONV, "index"])
    history = history.filter((F.col("start") - F.col("before") <= history_tokens) & ~F.coalesce(F.col("index") == F.col("system_index"), F.lit(False)))
    kept = join_counted(first, system.filter("system IS NOT NULL"), CONV, total).filter(F.col("first") > F.col("system.index"))
    piece = lambda role, text, tokens, order, repeated: [*CONV, "window", order.alias("order"), repeated.alias("repeated"), role.alias("role"), text.alias("text"), tokens.alias("tokens")]
    pieces = (
        rows.select(*piece(F.col("role"), F.col("text"), F.col("tokens"), F.col("index"), F.lit(False)))
        .unionAll(history.select(*piece(F.col("role"), F.col("text"), F.col("tokens"), F.col("index"), F.lit(True))))
        .unionAll(kept.select(*piece(F.lit("system"), F.col("system.text"), F.col("system.tokens"), F.lit(-1).cast("long"), F.lit(True))))
    )
    mark, body = F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n")), escaped(F.col("text"))
    pieces = pieces.select(
        *CONV, "window", "order", "repeated", "tokens", F.concat(mark, body, F.lit(END)).alias("piece"),
        F.char_length(mark).alias("at"), F.char_length(body).alias("n"), ((F.col("role") == "assistant") & ~F.col("repeated")).alias("target"),
    )
    # A window's turns: bounded by the budget, as every turn has MARKS tokens at least.
    windows = pieces.groupBy(*CONV, "window").agg(F.sort_array(F.collect_list(F.struct("order", "repeated", "tokens", "piece", "at", "n", "target"))).alias("p"))
    loss = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("pos"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["pos"] + F.char_length(x["piece"])).alias("pos"),
            F.when(x["target"], F.concat(acc["spans"], F.array(F.struct((acc["pos"] + x["at"]).alias("start"), x["n"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return windows.select(
        F.when(F.col("no_id") == 0, F.col("id")).alias("conv_id"),
        "window",
        F.size(F.filter("p", lambda x: x["repeated"])).alias("n_repeated"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"),
        F.size("p").alias("n_turns"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
        loss.alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """windows with turns (array of role, text, not repeated) and targets (array of texts), read from text, n_repeated and loss."""
    pieces = F.slice(F.split("text", r"<\|end\|>\n"), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, F.lit("|>\n")) + 3)).alias("text"),
    ))
    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    return windows.withColumns({"turns": turns, "targets": targets})


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what is read back from its windows. A digest is of all turns in order, so here a conversation meets in one row."""
    each = read_turns(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), F.char_length("text").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("target"),
    )
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "said", "target"))).alias("w"))
    text = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(text("said"), 256).alias("turns_sha256"), F.char_length(text("target")).cast("long").alias("loss_chars"),
        F.sha2(text("target"), 256).alias("loss_sha256"), "formatted_chars",
    )


ADDED_TEXT = "</s>[INST] ok [/INST]"
_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{ADDED_TEXT}'), (-1, 1, 'assistant', '{ADDED_TEXT}'))),
n AS (SELECT *, len(regexp_extract_all(text, '{WORD}')) + {MARKS} AS tokens, row_number() OVER o - 1 AS i FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT conv_id, min(i) AS si, min_by(tokens, i) AS stok, min_by(text, i) AS stext FROM n WHERE role = 'system' GROUP BY 1),
b AS (SELECT n.*, si, stok, stext, greatest({BUDGET} - coalesce(stok, 0) - {HISTORY_TOKENS}, {LEAST_SPAN}) AS span,
  sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS after, len('<|' || {_ESC.format('role')} || '|>_' || {_ESC.format('text')} || '<|end|>_') AS chars FROM n LEFT JOIN s USING (conv_id)),
w AS (SELECT *, after - tokens AS before, 2 * ((after - tokens) // span) + CASE WHEN (after - tokens) // span <> (after - 1) // span THEN 1 ELSE 0 END AS slot FROM b),
g AS (SELECT conv_id, slot, span, min(before) AS start, max(after) AS stop FROM w GROUP BY ALL),
m AS (SELECT x.conv_id, x.slot FROM g x JOIN g y ON x.conv_id = y.conv_id AND x.slot % 2 = 1 AND y.slot = x.slot - 1 WHERE x.stop - y.start <= x.span),
v AS (SELECT w.*, CASE WHEN m.slot IS NULL THEN w.slot ELSE w.slot - 1 END AS win FROM w LEFT JOIN m ON w.conv_id = m.conv_id AND w.slot = m.slot),
f AS (SELECT conv_id, win, min(i) AS first, min(before) AS start, any_value(si) AS si, any_value(stext) AS stext FROM v GROUP BY ALL),
h AS (SELECT f.conv_id, sum(v.chars) AS chars FROM f JOIN v ON v.conv_id = f.conv_id AND v.i BETWEEN f.first - {HISTORY_TURNS} AND f.first - 1
  AND f.start - v.before <= {HISTORY_TOKENS} AND (f.si IS NULL OR f.si <> v.i) GROUP BY ALL),
k AS (SELECT conv_id, sum(len('<|system|>_' || {_ESC.format('stext')} || '<|end|>_')) AS chars FROM f WHERE first > si GROUP BY ALL),
a AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
  coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS target FROM v GROUP BY ALL)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, len(target)::BIGINT AS loss_chars, sha256(target) AS loss_sha256,
  (a.chars + coalesce(h.chars, 0) + coalesce(k.chars, 0))::BIGINT AS formatted_chars
FROM a LEFT JOIN h USING (conv_id) LEFT JOIN k USING (conv_id)
"""
