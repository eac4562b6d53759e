"""Header rules, row checks and the upload reader."""

import pytest
from pyspark.sql import functions as F

from txnlens import schema
from txnlens.functions import text
from txnlens.operators import headers as hd
from txnlens.operators import uploads as up
from txnlens.sources import results as log
from txnlens.sources.tables import load_transactions
from txnlens.sources.uploads import read_upload

NAMES = ["TransactionID", *schema.SCORED_FIELDS]
GOOD = ["TX900001", "AC00128", "D000380", "San Diego", "2023-12-01 10:15:00", "120.00", "8000.00",
        "45", "90", "1", "Debit", "ATM", "Engineer"]


def _judge(spark, *changes, header=None, **kwargs):
    rows = []
    for i, change in enumerate(changes):
        cells = dict(zip(NAMES, GOOD), TransactionID=f"TX90000{i}")
        cells.update(change)
        rows.append((i + 2, *[cells[c] for c in NAMES]))
    df = spark.createDataFrame(rows, "line long, " + ", ".join(f"{c} string" for c in NAMES))
    found = up.judge_rows(df, header or hd.Header(NAMES), **kwargs).orderBy("line").collect()
    return [r["rejection"]["reason"] if r["rejection"] else None for r in found]


def test_reasons(spark):
    cases = [
        ({}, None),
        ({"TransactionAmount": " n/A "}, "TransactionAmount is empty"),
        ({"Location": None}, "Location is empty"),
        ({"AccountBalance": "12,5"}, "AccountBalance is not a number: '12,5'"),
        ({"TransactionAmount": "1d"}, "TransactionAmount is not a number: '1d'"),
        ({"TransactionAmount": "-3.50"}, "TransactionAmount must be positive, got -3.5"),
        ({"AccountBalance": "0"}, "AccountBalance must be positive, got 0"),
        ({"CustomerAge": "17"}, "CustomerAge 17 is outside 18-120"),
        ({"TransactionDuration": "1234567"}, "TransactionDuration 1.23457e+06 is outside 0-86400 seconds"),
        ({"LoginAttempts": "101"}, "LoginAttempts 101 is outside 0-100"),
        ({"Channel": "Kiosk"}, "Channel 'Kiosk' is not one of ATM, Branch, Online"),
        ({"TransactionID": "T1"}, "TransactionID is too short at 2 characters (minimum 4)"),
        ({"AccountID": "A C"}, "AccountID contains whitespace: 'A C'"),
        ({"DeviceID": "D" * 65}, "DeviceID is too long at 65 characters (maximum 64)"),
        ({"TransactionDate": "soon"}, "TransactionDate is not a timestamp: 'soon'"),
        ({"TransactionAmount": "9000", "LoginAttempts": "99", "CustomerAge": "120", "Location": "Nowhere"}, None),
        ({"TransactionAmount": "inf"}, None),
    ]
    assert _judge(spark, *[c for c, _ in cases]) == [r for _, r in cases]


def test_an_identifier_is_used_up_by_its_first_good_row(spark):
    same = {"TransactionID": "TX000077"}
    reasons = _judge(spark, {**same, "CustomerAge": "x"}, {**same, "TransactionDate": "soon"}, same)
    assert reasons[1].startswith("TransactionDate") and reasons[2] == "duplicate TransactionID 'TX000077'"


def test_missing_identity_is_synthesised(spark):
    header = hd.Header([c for c in NAMES if c not in ("AccountID", "DeviceID")])
    df = spark.createDataFrame([(7, *GOOD)], "line long, " + ", ".join(f"{c} string" for c in NAMES))
    row = up.judge_rows(df.drop("AccountID", "DeviceID"), header).first()
    assert (row["AccountID"], row["DeviceID"]) == ("CSV-A7", "CSV-D7") and len(row["warnings"]) == 2


def test_header_resolution(spark):
    header = hd.read_header(spark, ["Amount USD", "amount", "Session Length (Minutes)", "Notes", "Age"])
    assert header.columns == ["TransactionAmount", "amount", "TransactionDuration", "Notes", "CustomerAge"]
    assert header.scales == {"TransactionDuration": 60.0}
    assert header.notes[0] == "'Amount USD' read as TransactionAmount" and "(x60)" in header.notes[1]
    canonical = hd.read_header(spark, ["amount", "TransactionAmount"])
    assert canonical.columns == ["amount", "TransactionAmount"]


def test_gates():
    with pytest.raises(hd.HeaderRefused, match="at least one"):
        hd.Header(["Name", "Colour"]).check(may_fill=True)
    with pytest.raises(hd.HeaderRefused, match="CustomerAge"):
        hd.Header(["TransactionAmount"]).check(may_fill=False)
    assert hd.Header(["TransactionAmount"]).check(may_fill=True).missing


def test_alias_table_has_no_shadows():
    keys = {"".join(ch for ch in c.lower() if ch.isalnum()) for c in schema.CANONICAL_COLUMNS}
    table = schema.aliases()
    assert not keys & set(table) and {c for c, _ in table.values()} <= set(schema.CANONICAL_COLUMNS)


def _file(tmp_path, content):
    path = tmp_path / "upload.csv"
    path.write_bytes(content.encode())
    return str(path)


def test_upload_reader_keeps_lines_and_widths(spark, tmp_path):
    path = _file(tmp_path, '﻿Amount , City\r\n1,"a, ""b"""\r\n\r\n2\r\n3,c\r\n,\r\n\r\n')
    header, rows = read_upload(spark, path)
    assert header.columns == ["TransactionAmount", "Location"]
    got = [tuple(r) for r in rows.orderBy("line").collect()]
    assert [(r[0], r[1]) for r in got] == [(2, 2), (3, 1), (4, 1), (5, 2)]
    assert got[0][2:] == ("1", 'a, "b"') and got[3][2:] == ("3", "c")


@pytest.mark.parametrize("content, message", [("", "empty"), ("\n \n", "empty"), ("Amount,City\n", "no rows")])
def test_unusable_files(spark, tmp_path, content, message):
    with pytest.raises(ValueError, match=message):
        read_upload(spark, _file(tmp_path, content))


def test_quoted_newlines(spark, tmp_path):
    _, rows = read_upload(spark, _file(tmp_path, 'Amount,City\n1,"a\nb"\n2,c\n'), quoted_newlines=True)
    assert [r["Location"] for r in rows.orderBy("line").collect()] == ["a\nb", "c"]


def test_small_text_functions(spark):
    numbers = [(150.0, "150"), (0.0, "0"), (1234567.0, "1.23457e+06"), (0.00001, "1e-05"), (-2.50, "-2.5"), (86401.0, "86401")]
    df = spark.createDataFrame([(v,) for v, _ in numbers], "v double").coalesce(1)
    assert [r[0] for r in df.select(text.short_number(F.col("v"))).collect()] == [s for _, s in numbers]
    ranks = [1, 2, 3, 4, 11, 12, 13, 20, 21, 22, 100, 101, 111, 112]
    df = spark.createDataFrame([(n,) for n in ranks], "n int").coalesce(1)
    assert [r[0] for r in df.select(text.ordinal(F.col("n"))).collect()] == [
        "1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "20th", "21st", "22nd", "100th", "101st", "111th", "112th"]
    df = spark.createDataFrame([("2023-08-01T03:14:00+05:30",), ("nope",)], "s string").coalesce(1)
    stamps = [str(r[0]) for r in df.select(text.to_naive_timestamp(F.col("s"))).collect()]
    assert stamps == ["2023-08-01 03:14:00", "None"]


def test_limits_of_feed_and_batch(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "transaction_id string, scored_at string")
    assert [r[0] for r in log.recent(df, 1).collect()] == ["b"]
    for bad in (0, 501):
        with pytest.raises(ValueError):
            log.recent(df, bad)
        with pytest.raises(up.BadPayload):
            up.check_batch_size(bad)


def test_strict_load_names_missing_columns(spark):
    with pytest.raises(ValueError, match="Channel"):
        load_transactions(spark.createDataFrame([("x",)], "TransactionID string"))
