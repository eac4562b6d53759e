"""Local outlier factor and DBSCAN on the neighbour operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.detectors.base import Detector
from txnlens.operators.neighbours import components, eps_links, nearest_neighbours
from txnlens.session import cut_lineage


def _mean(values):
    """The mean of a row's few neighbour values, the same in whatever order they arrive."""
    held = F.array_sort(F.collect_list(values))
    return F.aggregate(held, F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size(held), F.lit(0))


def local_density(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, lrd) from neighbour pairs and the k-distance of every neighbour."""
    k_of = reach.select(F.col("id").alias("neighbour_id"), "k_distance")
    mean_reach = _mean(F.greatest("distance", "k_distance"))
    return pairs.join(k_of, "neighbour_id").groupBy("id").agg((1.0 / (mean_reach + 1e-10)).alias("lrd"))


def outlier_factor(pairs: DataFrame, own: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, score): mean density of the neighbours over the row's own."""
    of = reference.select(F.col("id").alias("neighbour_id"), F.col("lrd").alias("_lrd"))
    around = pairs.join(of, "neighbour_id").groupBy("id").agg(_mean(F.col("_lrd")).alias("_around"))
    return around.join(own, "id").select("id", (F.col("_around") / F.col("lrd")).alias("score"))


class LocalOutlierFactor(Detector):
    """Two scales: training rows leave themselves out, live rows are all unseen."""

    name = "lof"

    def __init__(self, k: int = 20, **kwargs):
        super().__init__(**kwargs)
        self.k = k

    def learn(self, rows):
        self.rows = rows
        self.pairs = cut_lineage(nearest_neighbours(rows, rows, self.k, exclude_self=True))
        self.reach = self.pairs.groupBy("id").agg(F.max("distance").alias("k_distance"))
        self.reference = cut_lineage(
            local_density(self.pairs, self.reach).join(self.reach, "id"))

    def training_score(self, rows):
        return outlier_factor(self.pairs, self.reference.select("id", "lrd"), self.reference)

    def score(self, rows):
        pairs = cut_lineage(nearest_neighbours(rows, self.rows, self.k))
        own = local_density(pairs, self.reference)
        return outlier_factor(pairs, own, self.reference)

    def calibrate(self, rows):
        live = cut_lineage(self.score(rows))
        return live, self._cut(live)


class DBSCAN(Detector):
    """Density clusters; any row is scored by its distance to the nearest core row."""

    name = "dbscan"

    def __init__(self, eps: float = 3.0, min_samples: int = 5, **kwargs):
        super().__init__(**kwargs)
        self.eps, self.min_samples = eps, min_samples

    def learn(self, rows):
        """A row is core when its (min_samples - 1) nearest others lie within eps."""
        self.rows = rows
        others = self.min_samples - 1
        if others:
            close = nearest_neighbours(rows, rows, others, exclude_self=True, radius=self.eps)
            enough = close.groupBy("id").count().filter(F.col("count") >= others).select("id")
            core = rows.join(enough, "id", "left_semi")
        else:
            core = rows
        self.core = cut_lineage(core.select("id", "vector"))
        if self.core.isEmpty():
            raise ValueError(
                f"no row has {self.min_samples} rows within {self.eps} of it: choose a larger radius or a smaller count")

    def score(self, rows):
        return nearest_neighbours(rows, self.core, 1).select("id", F.col("distance").alias("score"))

    def clusters(self) -> DataFrame:
        """(id, cluster, is_core) of the fitted rows; noise has cluster -1."""
        found = components(self.core, eps_links(self.core, self.eps))
        nearest = nearest_neighbours(self.rows, self.core, 1, radius=self.eps)
        attached = nearest.join(found.withColumnRenamed("id", "neighbour_id"), "neighbour_id").select(
            "id", F.col("component").cast("string").alias("component"))
        is_core = self.core.select("id", F.lit(True).alias("is_core"))
        return (
            self.rows.select("id").join(attached, "id", "left").join(is_core, "id", "left")
            .select("id", F.coalesce("component", F.lit("-1")).alias("cluster"),
                    F.coalesce("is_core", F.lit(False)).alias("is_core"))
        )

    def noise_summary(self, clusters: DataFrame | None = None) -> DataFrame:
        """Native noise rate and the number of clusters."""
        clusters = self.clusters() if clusters is None else clusters
        return clusters.agg(
            F.avg((F.col("cluster") == "-1").cast("int")).alias("noise_rate"),
            F.countDistinct(F.when(F.col("cluster") != "-1", F.col("cluster"))).alias("clusters"),
        )
