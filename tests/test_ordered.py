"""Running columns and quantiles: the paths for large groups against the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators.ordered import Running, running
from txnlens.operators.quantiles import quantile_table, quantiles
from txnlens.operators.ranking import distribution, hash_split, rank_against, stratified_split

COLUMNS = {
    "nth": Running("count"), "total": Running("sum", "v"), "before": Running("previous", "v"),
    "top": Running("max_before", "v"), "latest": Running("last", "maybe"),
}


@pytest.fixture(scope="module")
def rows(spark):
    """Two thirds of the rows share one key, a third of those one order value."""
    i = F.col("id")
    return spark.range(900).select(
        "id", F.when(i % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (i % 7).cast("string"))).alias("key"),
        F.when(i % 9 == 1, 0).otherwise(i % 50).alias("at"), F.pmod(i * 37, F.lit(101)).alias("v"),
        F.when(i % 5 == 0, i).alias("maybe"),
    ).persist()


@pytest.mark.parametrize("by", [["key"], []])
def test_chunked_equals_window(rows, by):
    plain = running(rows, by, ["at", "id"], COLUMNS, group_rows=10_000)
    chunked = running(rows, by, ["at", "id"], COLUMNS, group_rows=50)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, chunked.collect()), key=str)


def test_unknown_kind_is_refused(rows):
    with pytest.raises(ValueError):
        running(rows, ["key"], ["id"], {"x": Running("median")})


def test_narrowed_quantiles_equal_percentile(spark, rows):
    frame = rows.withColumn("x", F.col("v") / 7.0).withColumn("same", F.lit(3.0))
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    near = quantiles(frame, ["x", "same"], probs, buffer_rows=0)
    exact = quantiles(frame, ["x", "same"], probs)
    for c in near:
        assert np.allclose(near[c], exact[c])
    grouped = {r["key"]: r["x"] for r in quantile_table(frame, ["x"], probs, by=["key"], buffer_rows=0).collect()}
    for r in quantile_table(frame, ["x"], probs, by=["key"]).collect():
        assert np.allclose(grouped[r["key"]], r["x"])


def test_extreme_values_are_found(spark):
    frame = spark.createDataFrame([(x,) for x in [1e-300, 1.0, 2.0, 3.0, 1e300]], "x double")
    assert quantiles(frame, ["x"], [0.5], buffer_rows=0)["x"] == [2.0]


def test_rank_against_unseen_values(spark):
    train = spark.createDataFrame([("d", float(x)) for x in [1, 2, 2, 5]], "g string, v double")
    asked = spark.createDataFrame([("d", 0.0, "a"), ("d", 2.0, "b"), ("d", 3.0, "c"), ("d", 9.0, "e")], "g string, v double, id string")
    got = {r["id"]: (r["n_lt"], r["n_le"]) for r in rank_against(asked, distribution(train, ["g"], "v"), ["g"], "v", "id").collect()}
    assert got == {"a": (0, 0), "b": (1, 3), "c": (3, 3), "e": (4, 4)}


def test_split_sizes_and_repeatability(spark):
    df = spark.range(101)
    shares = {"train": 0.7, "validation": 0.2, "test": 0.1}
    first = hash_split(df, "id", shares, 1)
    assert {r[0]: r[1] for r in first.groupBy("split").count().collect()} == {"train": 71, "validation": 20, "test": 10}
    assert first.exceptAll(hash_split(df, "id", shares, 1)).isEmpty()
    assert not first.exceptAll(hash_split(df, "id", shares, 2)).isEmpty()
    labelled = df.withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    part = stratified_split(labelled, "id", "label", 0.25, 1).filter("is_test").groupBy("label").count()
    assert {r[0]: r[1] for r in part.collect()} == {0: 23, 1: 3}  # ceil(101 / 4) rows in all


def test_rank_lookup_keeps_rows_out_of_ordered_scans(spark, monkeypatch):
    """Rows that share a value are scanned as one, whatever their number; nulls, NaN and repeated rows keep their ranks."""
    from txnlens.operators import ranking

    scanned = []
    plain = ranking.running
    monkeypatch.setattr(ranking, "running", lambda df, *a, **k: (scanned.append(df.count()), plain(df, *a, **k))[1])
    kind = "g string, v double, id string"
    reference = spark.createDataFrame([("a", 1.0, 2, 0, 2), ("a", 3.0, 1, 2, 3), ("a", float("nan"), 1, 3, 4)],
                                      "g string, v double, n long, n_lt long, n_le long")
    asked = [("a", 1.0, "x")] * 500 + [("a", 2.0, None), ("a", float("nan"), "y"), ("a", None, "z"), ("b", 1.0, "w"), (None, 1.0, "q")]
    found = ranking.rank_against(spark.createDataFrame(asked, kind), reference, ["g"], "v", "id")
    got = sorted((str(r["g"]), str(r["v"]), str(r["id"]), r["n_lt"], r["n_le"]) for r in found.collect())
    assert scanned == [9]
    assert got == sorted(
        [("a", "1.0", "x", 0, 2)] * 500 + [("a", "2.0", "None", 2, 2), ("a", "nan", "y", 3, 4), ("a", "None", "z", 0, 0),
                                          ("b", "1.0", "w", 0, 0), ("None", "1.0", "q", 0, 0)])


def test_dated_scores_are_joined_once(spark, folder):
    """The parts of thr3 and thr4 read written rows; a reader does not join one row per detector again."""
    from txnlens.catalog import reports

    for part in reports._old_new(spark, folder):
        assert "Join" not in part._jdf.queryExecution().optimizedPlan().toString()
        assert part.columns == ["TransactionID", "detector", "score"]
