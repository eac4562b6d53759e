"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.scratch import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node hands the smallest of itself and its neighbours to its larger (or to its smaller) neighbours.

    Only minima are gathered per node, so a node of any degree is handled by partial aggregation and a join.
    """
    if large:
        sides = links.union(links.select("b", "a")).toDF("u", "v")
    else:
        sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = sides.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) that is not its own root, the smallest node of its component.

    Every round writes at most as many links as there were; a lost executor costs one round.
    """
    links = cut_lineage(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        links = cut_lineage(_star(_star(links, large=True), large=False))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
