"""Exploratory tables: summaries, shapes, shares, boxes, histograms, correlations."""

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.operators.quantiles import quantile_table, quantiles
from txnlens.operators.voting import _stacked


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max per column."""
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = df.agg(*[
        F.struct(
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c)
        for c in columns
    ])
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), *[F.col(c)[k].alias(k) for k in ("count", "mean", "std", "min")],
            *[F.lit(q).alias(n) for n, q in zip(("q25", "q50", "q75"), quarters[c])],
            F.col(c)["max"].alias("max"),
        )
        for c in columns
    ])
    return rows.select(F.explode(entries).alias("e")).select("e.*")


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    found = _stacked(df, [([c], F.struct(
        F.count_if(F.col(f"`{c}`").isNull()).alias("missing"), F.count(F.lit(1)).alias("rows")))
        for c in columns], ["feature", "v"])
    return found.select(
        "feature", "v.missing", (F.col("v.missing") * 100.0 / F.col("v.rows")).alias("percent")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one in every column."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per column."""
    def skew(c):
        n = F.count(c)
        return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)

    def kurt(c):
        n = F.count(c)
        return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)

    found = _stacked(df, [([c], F.struct(skew(c).alias("skew"), kurt(c).alias("kurtosis")))
                          for c in columns], ["feature", "v"])
    return found.select("feature", "v.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and one-decimal shares, commonest first."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("t")).select("t").scalar()
    return counted.select(
        F.lit(column).alias("feature"), "value", "n", F.round(F.col("n") * 100.0 / total, 1).alias("percent")
    ).orderBy(F.desc("n"), "value")


def crosstab(df: DataFrame, row: str, column: str, levels: list[str]) -> DataFrame:
    """Share of each level of `column` within a row value, in percent."""
    return df.groupBy(row).agg(*[
        (F.count_if(F.col(column) == level) * 100.0 / F.count(F.lit(1))).alias(level) for level in levels
    ])


def distinct_per_key_histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys have 1, 2, 3 ... distinct values."""
    per_key = df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias("distinct_values"))
    return per_key.groupBy("distinct_values").agg(F.count(F.lit(1)).alias("keys"))


def daily_counts(df: DataFrame, stamp: str) -> DataFrame:
    return df.groupBy(F.to_date(stamp).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, from one pass."""
    pairs = [([a, b], F.corr(a, b)) for a, b in itertools.combinations(columns, 2)]
    return _stacked(df, pairs, ["a", "b", "correlation"])


def box_statistics(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles per group, and whiskers: the outermost values within 1.5 box heights."""
    quarters = quantile_table(df, [value], [0.25, 0.5, 0.75], by=by).select(
        *by, *[F.col(value)[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))]
    )
    fenced = df.join(F.broadcast(quarters), by)  # one row per group of few levels
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    kept = F.when(inside, F.col(value))
    return fenced.groupBy(*by, "q25", "q50", "q75").agg(
        F.min(kept).alias("whisker_low"), F.max(kept).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0; the last one includes its upper end."""
    spot = F.floor((value - low) / (high - low) * bins)
    return F.when(high > low, F.least(spot, F.lit(bins - 1))).otherwise(0).cast("int")


def histogram(df: DataFrame, column: str, bins: int, by: list[str] = ()) -> DataFrame:
    """Rows per equal-width bin between the column's ends (of its group)."""
    by = list(by)
    if not by:
        low, high = df.agg(F.min(column), F.max(column)).first()
        spot = bin_of(F.col(column), F.lit(float(low)), F.lit(float(high)), bins)
        return df.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    ends = df.groupBy(*by).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    spot = bin_of(F.col(column), F.col("_low"), F.col("_high"), bins)
    return (
        df.join(F.broadcast(ends), by)  # one row per group of few levels
        .groupBy(*by, spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )


def prevalence(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Mean of each level's indicator; the largest is the mode."""
    return _stacked(
        df, [([column, level], F.avg((F.col(column) == level).cast("double"))) for level in levels],
        ["feature", "level", "prevalence"],
    )
