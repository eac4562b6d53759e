"""Isolation forest: trees grown one per task on small samples, kept as a node table."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.detectors.base import Detector
from txnlens.detectors.batches import matrix, score_with
from txnlens.schema import SEED

SAMPLE_ROWS = 256
_NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
_SPAN = 2**62


def mean_path(size) -> np.ndarray:
    """Average path length of an unsuccessful search among `size` rows."""
    size = np.asarray(size, dtype=float)
    many = np.maximum(size, 3)
    long = 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many
    return np.where(size > 2, long, np.where(size == 2, 1.0, 0.0))


def tree_samples(rows: DataFrame, trees: int, per_tree: int, seed: int) -> DataFrame:
    """(tree, id, vector): `per_tree` rows drawn for every tree in one pass.

    A row's hash under each tree decides; about twice the wanted rows pass, and
    the lowest hashes of each tree are kept.
    """
    total = rows.count()
    limit = min(_SPAN, 2 * per_tree * _SPAN // max(total, 1))

    def ticket(tree):
        return F.pmod(F.xxhash64(F.col("id"), tree, F.lit(seed)), F.lit(_SPAN))

    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: ticket(t) < limit)
    chosen = rows.select("id", "vector", F.explode(drawn).alias("tree"))
    lowest = Window.partitionBy("tree").orderBy("_ticket", "id")
    return (
        chosen.withColumn("_ticket", ticket(F.col("tree")))
        .withColumn("_nth", F.row_number().over(lowest))
        .filter(F.col("_nth") <= per_tree).select("tree", "id", "vector")
    )


def _grow(seed: int, limit: int):
    def grow(key, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = matrix(rows.sort_values("id")["vector"])
        random = np.random.default_rng(seed * 1_000_003 + tree)
        nodes, waiting = [], [(np.arange(len(x)), 0, None, None)]
        while waiting:
            members, depth, parent, side = waiting.pop()
            number = len(nodes)
            if parent is not None:
                nodes[parent][side] = number
            part = x[members]
            low, high = part.min(axis=0), part.max(axis=0)
            varying = np.flatnonzero(high > low)
            node = {"tree": tree, "node": number, "feature": -1, "threshold": 0.0, "left": -1,
                    "right": -1, "size": len(members), "depth": depth}
            nodes.append(node)
            if depth >= limit or len(members) <= 1 or not len(varying):
                continue
            node["feature"] = int(random.choice(varying))
            node["threshold"] = float(random.uniform(low[node["feature"]], high[node["feature"]]))
            goes_left = part[:, node["feature"]] < node["threshold"]
            waiting.append((members[goes_left], depth + 1, number, "left"))
            waiting.append((members[~goes_left], depth + 1, number, "right"))
        return pd.DataFrame(nodes)

    return grow


class Forest:
    """The node table as arrays, for walking batches of rows down every tree."""

    def __init__(self, nodes: pd.DataFrame, sample_rows: int):
        self.sample_rows = sample_rows
        self.trees = []
        for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
            column = {c: part[c].to_numpy() for c in part.columns}
            column["length"] = column["depth"] + mean_path(column["size"])
            self.trees.append(column)

    def _sum_over_leaves(self, x, value):
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(int(tree["depth"].max())):
                feature = tree["feature"][at]
                inner = feature >= 0
                step = np.where(
                    x[rows, np.maximum(feature, 0)] < tree["threshold"][at], tree["left"][at], tree["right"][at])
                at = np.where(inner, step, at)
            total += tree[value][at]
        return total / len(self.trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self._sum_over_leaves(x, "length") / mean_path(self.sample_rows))

    def mean_depth(self, x: np.ndarray) -> np.ndarray:
        return self._sum_over_leaves(x, "depth")


class IsolationForest(Detector):
    name = "isolation_forest"

    def __init__(self, trees: int = 200, seed: int = SEED, **kwargs):
        super().__init__(**kwargs)
        self.trees, self.seed = trees, seed

    def learn(self, rows):
        per_tree = int(min(SAMPLE_ROWS, rows.count()))
        depth = math.ceil(math.log2(max(per_tree, 2)))
        samples = tree_samples(rows, self.trees, per_tree, self.seed)
        # At most trees x (2 x 256 - 1) nodes, whatever the size of the table.
        grown = samples.groupBy("tree").applyInPandas(_grow(self.seed, depth), _NODES)
        self.use(grown.toPandas(), per_tree)

    def use(self, nodes: pd.DataFrame, sample_rows: int) -> "IsolationForest":
        """Take a given node table."""
        self.nodes = nodes
        self.forest = Forest(nodes, sample_rows)
        return self

    def score(self, rows):
        return score_with(rows, self.forest, Forest.score)

    def mean_depth(self, rows: DataFrame) -> DataFrame:
        """(id, depth): average path length of each row."""
        return score_with(rows, self.forest, Forest.mean_depth, "depth")

    def tree_shapes(self, spark) -> DataFrame:
        """Depth and leaves of every tree."""
        return spark.createDataFrame(self.nodes).groupBy("tree").agg(
            F.max("depth").alias("depth"), F.count_if(F.col("feature") < 0).alias("leaves"))
