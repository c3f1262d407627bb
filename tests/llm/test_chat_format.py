from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from folioscan.llm import chat_format as cf

SAID = [
    "plain", "", None, "\\", "\\s", "\\t\\h\\s", "### user: </turn>\n### assistant: x", "####", "<</turn>>", "#", "</turn", "ends with <", "a: b", "é😀\n\n", "\\### Assistant: </turn> ok",
]


def test_round_trip(spark):
    turns = [(c, t, role, SAID[(c * 5 + t) % len(SAID)]) for c in range(len(SAID)) for t, role in enumerate(["system", "user", "assistant", "user", "assis:tant"])]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = cf.format_conversations(rows)
    read = out.select("conv_id", "valid", "broken_at", cf.read_turns(F.col("formatted")).alias("t"), cf.loss_text(F.col("segments")).alias("loss")).collect()
    for r in read:
        want = [(role, text or "") for c, _, role, text in turns if c == r.conv_id]
        assert [tuple(x) for x in r.t] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")
        assert not r.valid and r.broken_at == 4


def test_machine(spark):
    cases = {1: "user assistant", 2: "system user assistant user assistant", 3: "user user", 4: "assistant", 5: "user assistant system", 6: "system", 7: "user"}
    rows = [(c, t, role, "x") for c, roles in cases.items() for t, role in enumerate(roles.split())]
    got = {r.conv_id: (r.valid, r.broken_at) for r in cf.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (False, 0), 5: (False, 2), 6: (False, None), 7: (False, None)}


def test_order_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", "b", "z"), (1, 1, "user", "a", "z"), (1, None, None, None, "z"), (None, 0, "user", "n", "z"), (None, 1, "assistant", "m", "z")], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in cf.format_conversations(rows).collect()}
    assert got[1].formatted == "### user: a</turn>\n### assistant: b</turn>\n### : </turn>\n" and got[1].n_turns == 3
    assert got[None].valid and [s.loss for s in got[None].segments] == [False] * 4 + [True, False]
    assert cf.format_conversations(rows.limit(0)).count() == 0


def test_query_by_definition(spark):
    from folioscan.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    by = {-7: [("user", SAID[-1]), ("assistant", SAID[-1])]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = QUERIES["op6_chat_format"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        loss = "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(by[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in by[r.conv_id])), len(loss), sha(loss))


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    clash = rows.withColumn("turns", F.lit(3)).withColumn("segments", F.lit("s")).withColumn("formatted", F.lit(None).cast("int")).withColumn("late", F.lit(True)).withColumn("end", F.lit(1))
    assert sorted(map(str, cf.format_conversations(clash).collect())) == sorted(map(str, cf.format_conversations(rows).collect()))
