"""Thresholds, flags, quorum votes and the tables of the vote report."""

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.operators.quantiles import quantile_table
from txnlens.schema import SANE_BAND


def thresholds(scores: DataFrame, contamination: float) -> dict[str, float]:
    """detector -> the score that a `contamination` share of its rows reaches."""
    cut = quantile_table(scores, ["score"], [1.0 - contamination], by=["detector"])
    return {r["detector"]: float(r["score"][0]) for r in cut.collect()}


def with_flags(scores: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Add `flag`: 1 where the score reaches its detector's threshold."""
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return scores.withColumn("flag", (F.col("score") >= limit[F.col("detector")]).cast("int"))


def votes_required(detectors: int, share: float) -> int:
    if detectors < 1:
        raise ValueError("a vote needs at least one detector")
    return max(1, math.ceil(detectors * share))


def verdict(flags: list[str], share: float) -> Column:
    """The five-field verdict struct over flag columns."""
    required = votes_required(len(flags), share)
    cast = sum((F.col(f).cast("int") for f in flags[1:]), F.col(flags[0]).cast("int"))
    return F.struct(
        (cast >= required).alias("is_anomaly"),
        cast.alias("votes_for"),
        F.lit(len(flags)).alias("votes_total"),
        F.lit(required).alias("votes_required"),
        F.lit(float(share)).alias("threshold"),
    )


def wide_flags(flags: DataFrame, identifier: str, detectors: list[str]) -> DataFrame:
    """One row per transaction with a flag column per detector."""
    return flags.groupBy(identifier).pivot("detector", detectors).agg(F.max("flag"))


def rate_table(flags: DataFrame) -> DataFrame:
    return flags.groupBy("detector").agg(
        F.avg("flag").alias("rate"), F.sum("flag").cast("long").alias("flagged")
    )


def band_warnings(rates: DataFrame, band: tuple[float, float] = SANE_BAND) -> DataFrame:
    low, high = band
    text = F.concat(
        F.col("detector"), F.format_string(" flagged %.2f%%", F.col("rate") * 100),
        F.lit(f", outside the sane band [{low:.0%}, {high:.0%}]"),
    )
    return rates.filter(~F.col("rate").between(low, high)).select("detector", text.alias("warning"))


def _ratio(a: str, b: str) -> Column:
    both = F.count_if((F.col(a) == 1) & (F.col(b) == 1))
    either = F.count_if((F.col(a) == 1) | (F.col(b) == 1))
    return F.when(either == 0, 0.0).otherwise(both / either)


def _stacked(df: DataFrame, columns: list[tuple[list, Column]], names: list[str]) -> DataFrame:
    """One aggregate per entry, computed in one pass and returned as rows."""
    row = df.agg(*[value.alias(f"v{i}") for i, (_, value) in enumerate(columns)])
    entries = F.array(*[
        F.struct(*[F.lit(k).alias(n) for k, n in zip(keys, names)], F.col(f"v{i}").alias(names[-1]))
        for i, (keys, _) in enumerate(columns)
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def pairwise_jaccard(wide: DataFrame, detectors: list[str]) -> DataFrame:
    """Agreement of every detector pair: flagged by both over flagged by either."""
    pairs = [([a, b], _ratio(a, b)) for a, b in itertools.combinations(detectors, 2)]
    return _stacked(wide, pairs, ["a", "b", "jaccard"])


def jaccard_matrix(wide: DataFrame, detectors: list[str]) -> DataFrame:
    """The symmetric matrix as (a, one column per detector), ones on the diagonal."""
    pairs = pairwise_jaccard(wide, detectors)
    mirrored = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")
    unit = pairs.sparkSession.createDataFrame(
        [(d, d, 1.0) for d in detectors], "a string, b string, jaccard double")
    cells = pairs.union(mirrored).union(unit)
    return cells.groupBy("a").pivot("b", detectors).agg(F.max("jaccard"))


def vote_histogram(votes: DataFrame, detectors: int, column: str = "votes_for") -> DataFrame:
    """Rows per number of votes, zero counts included."""
    bins = [([v], F.count_if(F.col(column) == v)) for v in range(detectors + 1)]
    return _stacked(votes, bins, ["votes", "n"])


def threshold_sweep(votes: DataFrame, detectors: int, column: str = "votes_for") -> DataFrame:
    """Rows that each possible quorum would flag."""
    steps = [([r], F.count_if(F.col(column) >= r)) for r in range(1, detectors + 1)]
    return _stacked(votes, steps, ["required", "n"])


def with_share(table: DataFrame, total: int) -> DataFrame:
    share = F.col("n") / F.lit(float(total))
    return table.select("*", share.alias("share"), F.format_string("%6.2f%%", share * 100).alias("text"))


def group_means(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Mean of every feature per label, as rows."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot([label], columns, "feature", "mean")


def split_rates(flags: DataFrame) -> DataFrame:
    """Flag rate per detector and split."""
    return flags.groupBy("detector", "split").agg(F.avg("flag").alias("rate"))
