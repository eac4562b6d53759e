"""Chat formatting: exact round trips, the automaton against a plain loop, odd input."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from txnlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra int"
NASTY = ["", "\\", "</turn>", "<\\/turn>", "### Assistant:", "\\### Assistant: </turn> ok", "#### User: x", "</turn>\n",
         "### @", "a\nb", "é</turn", "<</turn>>", "\\\\</turn>\\", "$1 \\1"]


def _expected(turns):
    template = chat.Template()
    state, bad = "start", -1
    for k, (role, _) in enumerate(turns):
        if bad < 0:
            state = template.moves[state].get(role)
            if state is None:
                bad, state = k, "start"
    return bad, bad < 0 and turns[-1][0] == "assistant"


def test_round_trip_and_verdicts(spark):
    rng = random.Random(3)
    told = {}
    for c in range(60):
        n = rng.choice([1, 2, 3, 5, 8, 200])
        roles = ["user", "assistant"] * n if c % 3 == 0 else rng.choices(["system", "user", "assistant", "tool", "critic:\n", ""], k=n)
        told[c] = [(r, "".join(rng.choices(NASTY, k=rng.randint(0, 4)))) for r in roles]
    rows = [(c, t * 7, r, x, 1) for c, turns in told.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    chats = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = chats.select(
        "conv_id", "bad_turn", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert len(got) == len(told)
    for r in got:
        turns = told[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == "".join(x for role, x in turns if role == "assistant")
        assert (r["bad_turn"], r["valid"]) == _expected(turns)
        for mark in chat.Template().controls[:1]:
            assert r["formatted"].count(mark) == len(turns)


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, "user", None, 1), (1, 0, None, "b", 1), (1, 0, None, "a", 1), (None, 2, "assistant", "x", 1),
            (None, 2, "assistant", "x", 1)]
    chats = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", ""), ("", "a"), ("", "b")], None: [("assistant", "x")] * 2}
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_are_checked():
    for bad in ({"close": "aa"}, {"close": "x\\y"}, {"titles": {"user": "@x"}}, {"titles": {"user": "A", "tool": "A"}}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_query_digests(spark, folder):
    from txnlens.llm.queries import QUERIES

    row = QUERIES["op1_chat_format"](spark, folder).where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["valid"]) == (2, len(text), True)
