"""Arrow batches of (id, vector) rows: scoring and moment sums."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column) -> np.ndarray:
    """Vectors of equal length as rows, from an Arrow list column (one flat copy) or a pandas one."""
    if isinstance(column, pa.Array):
        widths = column.value_lengths().unique()
        if len(widths) != 1 or not widths[0].is_valid:
            raise ValueError("all vectors must have the same length")
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), widths[0].as_py())
    return np.stack(column.to_numpy()).astype(float)


def score_with(rows: DataFrame, model, function, name: str = "score") -> DataFrame:
    """(id, score) where `function(model, matrix)` gives one number per row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                found = np.asarray(function(shared.value, matrix(batch["vector"])), dtype=float)
                yield pa.record_batch([batch["id"], pa.array(found, from_pandas=True)], names=["id", name])  # NaN: null

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "vector").mapInArrow(score, f"id {kind}, {name} double")


def summed(rows: DataFrame, function, columns: list[str] = ("vector",)) -> np.ndarray:
    """Element-wise sum over all rows of a fixed-length array computed per batch.

    Each task adds up its own batches and returns one array, so what is merged
    grows with the number of tasks only.
    """
    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = np.asarray(function(batch), dtype=float)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()), from_pandas=True)], names=["part"])

    parts = rows.select(*columns).mapInArrow(partial, "part array<double>")
    spots = parts.select(F.posexplode("part").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    return np.array([r["x"] for r in sorted(spots.collect(), key=lambda r: r["i"])])


def moments(rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, mean vector and population covariance matrix."""
    def sums(batch):
        x = matrix(batch["vector"])
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    flat = summed(rows, sums)
    width = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    n, mean = flat[0], flat[1:1 + width] / flat[0]
    return n, mean, flat[1 + width:].reshape(width, width) / n - np.outer(mean, mean)


def squared_distance(vector: Column, centre) -> Column:
    """Squared Euclidean distance to a fixed point, as a JVM expression."""
    point = F.array(*[F.lit(float(x)) for x in centre])
    gaps = F.zip_with(vector, point, lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)


def dot(vector: Column, weights) -> Column:
    point = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(
        F.zip_with(vector, point, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
