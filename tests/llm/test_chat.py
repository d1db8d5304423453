import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.llm import bpe, chat

HARD = st.text(alphabet='\\<>/turn ="role\nab', max_size=40)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_template_is_reversible(pairs):
    text = "".join(chat.turn(r, t)[0] for r, t in pairs)
    assert [(r, t) for r, t, _ in chat.turns(text)] == pairs
    for r, t in pairs:
        formatted, start, stop = chat.turn(r, t)
        assert chat.unescaped(formatted[start:stop]) == t


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    *[(1, i, r, f"{r} says <turn role=x> \\</turn> {'word ' * (i * 7)}") for i, r in enumerate(["system", *["user", "assistant"] * 20])],
    (2, 0, "user", None), (2, 1, "assistant", ""), (3, None, None, "late"), (3, 5, "assistant", "early"), (3, 5, "assistant", "early"),
    (None, 0, "assistant", "no id"), (4, 0, "assistant", "long " * 5000), (4, 1, "user", "x"), (5, 0, "system", "s " * 3000), (5, 1, "assistant", "y"),
]


@pytest.mark.parametrize("budget,history", [(1024, 4), (40, 2), (120, 0), (10**9, 4)])
def test_every_turn_once_and_every_target_once(spark, budget, history):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, budget=budget, history_turns=history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(made).collect()}
    assert got == brute(ROWS)
    encode = bpe.encoding(open(f"{bpe.FOLDER}/{bpe.RANKS}", "rb").read()).encode_ordinary
    for w in made.collect():
        turns = chat.turns(w["text"])
        sizes = [len(encode(chat.turn(r, t)[0])) for r, t, _ in turns]
        assert w["tokens"] == sum(sizes)
        new = [i for i, t in enumerate(turns) if t[2] >= w["new_from"]]
        assert sum(sizes) <= budget or len(new) == 1
        assert sum(sizes) <= budget or turns[0][0] == "system" or len(turns) == 1
        if w["conv_id"] == "1" and w["window"]:
            assert turns[0][0] == "system" and len(turns) - len(new) <= 1 + history


def test_empty_table_has_only_the_extra_conversation(spark, write):
    folder = write(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    (row,) = chat.query(spark, folder).collect()
    said = "\\### Assistant: </turn> ok"
    assert (row["conv_id"], row["n_turns"], row["loss_chars"]) == (-7, 2, len(said))
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.EXTRA_TEXT), (-7, 1, "assistant", chat.EXTRA_TEXT)]
    out = chat.query(spark, folder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "parquet" in plan  # what is digested comes from written windows
    found = out.collect()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found}
    assert got == brute(rows)
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chars = {r["conv_id"]: r["n"] for r in chat.windows(data).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert {str(r["conv_id"]): r["formatted_chars"] for r in found} == chars


def test_windows_are_read_in_any_order(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    mixed = chat.windows(df, budget=40).repartition(7).orderBy(F.rand(3))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.read_back(mixed)).collect()}
    assert got == brute(ROWS)
