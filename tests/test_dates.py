"""Date spellings of uploads."""

import datetime

import pytest
from pyspark.sql import functions as F

from txnlens.functions.text import to_naive_timestamp

D = datetime.datetime


@pytest.mark.parametrize(("text", "want"), [
    ("2023-12-01 10:15:00", D(2023, 12, 1, 10, 15)), (" 2023-12-01T10:15:00+02:00 ", D(2023, 12, 1, 10, 15)),
    ("12/01/2023 10:15", D(2023, 12, 1, 10, 15)), ("13/01/2023", D(2023, 1, 13)), ("2023/12/01 10:15:00", D(2023, 12, 1, 10, 15)),
    ("Dec 1 2023", D(2023, 12, 1)), ("december 1, 2023 08:09:10", D(2023, 12, 1, 8, 9, 10)), ("1 Dec 2023", D(2023, 12, 1)),
    ("1-Dec-2023 10:15", D(2023, 12, 1, 10, 15)), ("20231201", D(2023, 12, 1)), ("2023-12-01", D(2023, 12, 1)),
    ("not a date", None), ("13/13/2023", None), ("2023-02-30", None), ("", None), (None, None), ("Dez 1 2023", None),
])
def test_spellings(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(to_naive_timestamp(F.col("t")).alias("t"))
    assert df.first()["t"] == want
