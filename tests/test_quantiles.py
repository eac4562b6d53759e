"""Narrowing and buffering give the same quantiles, whatever the values."""

import math
import random

import pytest

from txnlens.operators.quantiles import quantile_table

INF, NAN = float("inf"), float("nan")


def _exact(values, p):
    ordered = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
    spot = p * (len(ordered) - 1)
    a, b = ordered[math.floor(spot)], ordered[math.ceil(spot)]
    if a == b or math.floor(spot) == math.ceil(spot):
        return a
    return (math.ceil(spot) - spot) * a + (spot - math.floor(spot)) * b


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, NAN, NAN], [1.0, 2.0, 3.0, INF], [-INF, 5.0, INF, INF, 7.0], [NAN] * 4, [4.0] * 9,
    [1e300, -1e300, 1.0, 2.0, 3.0], [None, 1.0, None, 2.0], [0.0] * 50 + [1.0] * 50,
    [random.Random(1).gauss(0, 1) for _ in range(500)], [float(i % 7) for i in range(300)],
])
def test_both_ways_agree(spark, values):
    df = spark.createDataFrame([(v, "g", None if v is None or math.isnan(v) else -v) for v in values], "x double, g string, y double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = [_exact(values, p) for p in probs]
    for limit in (10_000, 3):
        for by in ([], ["g"]):
            got = quantile_table(df, ["x", "y"], probs, by, buffer_rows=limit).first()
            assert got["x"] == pytest.approx(want, nan_ok=True), (limit, by)


def test_many_groups_also_without_a_name(spark):
    rows = [(i % 40 if i % 40 else None, float((i * 7919) % 1009)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, x double")
    few, many = (
        {r["g"]: r["x"] for r in quantile_table(df, ["x"], [0.1, 0.5], ["g"], buffer_rows=n).collect()} for n in (10_000, 5))
    assert few == many and len(few) == 40
