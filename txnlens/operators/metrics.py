"""ROC and precision-recall of scores against labels, ties grouped."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.ordered import Running, running


def curve(scored: DataFrame, by: str = "detector", score: str = "score", label: str = "label") -> DataFrame:
    """Cumulative true and false positives per distinct score, highest first.

    Detectors whose labels are all alike have no curve and are left out.
    """
    grouped = scored.groupBy(by, (-F.col(score)).alias("_down")).agg(
        F.sum(label).cast("long").alias("pos"),
        F.sum(1 - F.col(label)).cast("long").alias("neg"),
    )
    cumulated = running(grouped, [by], ["_down"], {"tp": Running("sum", "pos"), "fp": Running("sum", "neg")})
    totals = grouped.groupBy(by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return (
        cumulated.join(F.broadcast(totals), by)  # one row per detector
        .filter("p > 0 and n > 0")
        .select(by, (-F.col("_down")).alias("score"), "pos", "neg", "tp", "fp", "p", "n")
    )


def roc_points(points: DataFrame, by: str = "detector") -> DataFrame:
    return points.select(
        by, "score", (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr")
    )


def pr_points(points: DataFrame, by: str = "detector") -> DataFrame:
    return points.select(
        by, "score", (F.col("tp") / F.col("p")).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def summary(points: DataFrame, by: str = "detector") -> DataFrame:
    """Area under the ROC curve (trapezoids) and average precision."""
    area = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2
    gain = F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.groupBy(by).agg(
        (F.sum(area / F.col("n")) / F.max("p")).alias("auc"),
        F.sum(gain).alias("average_precision"),
        (F.max("p") / (F.max("p") + F.max("n"))).alias("positive_rate"),
    )


def cumulative_share(parts: DataFrame, order: str, value: str) -> DataFrame:
    """Running total of a short ordered table, such as variance per component."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("cumulative", F.sum(value).over(upto))
