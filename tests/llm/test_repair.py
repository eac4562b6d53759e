"""Conversation repair: whole results against a plain backward DP, matrices, edge cases."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from tests.llm.plain_repair import plain
from txnlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"audit": F.lit(1), "_k": F.lit("x"), "mult": F.lit(2)})
    return {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, **kw).collect()}


def test_real_conversations_match_plain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df).collect()}
    assert got == plain(rows)


def test_edge_cases_match_plain(spark):
    long_conv = [(9, t, "user" if t % 2 else "assistant", f"turn {t % 7} text" + ("." if t % 3 else ""))
                 for t in range(700)]
    rows = [
        (1, 0, None, None), (1, 1, "user", "hi."), (1, 1, "user", "hi."), (1, 5, "assistant", "ok"),
        (2, None, "system", "be nice."), (2, None, "user", "q?"), (2, 3, "tool", "  \t"),
        (None, 1, "user", "no id."), (None, 2, "assistant", "fine!"),
        (3, 0, "", "empty role."), (3, 1, "Assistant", "Capital."),
        (4, 10**12, "user", "far."),
        *long_conv,
    ]
    got = run(spark, rows)
    want = plain(rows)
    assert got == want
    assert len(got) == 6


def test_rules_are_shared_and_do_not_change_results(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same text." if t % 4 else "other")
            for c in range(40) for t in range(12)]
    with_rules = run(spark, rows)
    without = run(spark, rows, rounds=0)
    assert with_rules == without == plain(rows)


def test_empty_table_and_all_dropped(spark):
    assert run(spark, []) == {}
    # Find a (conv_id, turn) whose damage drops the row.
    import zlib
    turn = next(t for t in itertools.count() if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = run(spark, [(5, turn, "user", "x.")])
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_matrix_products_are_exact():
    g = repair.Grammar([])
    for seq in ["", "uaua", "MsuAx", "aaaa", "SUuM"]:
        m = g.evaluate(seq)
        rows = list(seq)
        # One step at a time equals the balanced fold.
        step = repair.identity()
        for s in rows:
            step = repair.product(step, repair.terminal(s))
        assert step == m


@pytest.mark.parametrize("seq", ["uaua", "uuaa", "sxMua", "UAUA"])
def test_grammar_compression_keeps_matrices(seq):
    plain_g = repair.Grammar([])
    rules = [("", "ua"), ("", "")]
    assert repair.Grammar(rules).evaluate(seq) == plain_g.evaluate(seq)
