"""Centroid clustering of integer vectors by bit-plane popcounts.

A component v is written in two's complement over B bits, B the fewest that hold every component of the
input. Plane a of a vector packs bit a of its 64 components into one uint64. For a vector x with planes X
and a centroid c with planes C,

    x . c = sum over a, b of  w_a * w_b * popcount(X_a & C_b),   w_a = 2^a for a < B-1,  w_(B-1) = -2^(B-1),

which is exact in integers, so distances |x|^2 - 2 x.c + |c|^2 are exact squared Euclidean distances.

Spark plan: the vectors are checked, scaled and turned into planes once (one map pass, written to the
checkpoint folder). Every round is one more map pass in which each task assigns its vectors with the k
centroid planes (k * B words in the closure) and emits at most k rows of per-cluster sums; the JVM adds
them up (partial aggregation, so a cluster holding most rows costs no task more than its share), and the
driver receives k rows and takes exact floors. Nothing on the driver grows with the number of vectors.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.llm.scratch import cut_lineage

WIDTH = 64
SCALE = 1024
# Distances are longs: 64 * (2 * 2^24)^2 < 2^63.
LARGEST = 2**24


def scaled_vectors(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a long, x as a double; null unless the vector has exactly
    WIDTH components, none null, NaN or infinite."""
    arr = F.col(vector)
    usable = (F.size(arr) == WIDTH) & F.forall(
        arr, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(usable, F.transform(arr, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def weights(bits: int) -> np.ndarray:
    w = np.array([1 << a for a in range(bits)], dtype=np.int64)
    w[-1] = -w[-1]
    return w


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, WIDTH) integers -> (n, bits) uint64 planes of their two's complement."""
    u = values.astype(np.int64) & ((1 << bits) - 1)
    set_bits = (u[:, :, None] >> np.arange(bits, dtype=np.int64)) & 1
    return (set_bits.astype(np.uint64) << np.arange(WIDTH, dtype=np.uint64)[None, :, None]).sum(axis=1, dtype=np.uint64)


def unpack(packed: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) planes -> (n, WIDTH) integers."""
    set_bits = ((packed[:, :, None] >> np.arange(WIDTH, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    return np.einsum("a,nai->ni", weights(bits), set_bits)


def dots(x_planes: np.ndarray, c_planes: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) and (k, bits) planes -> (n, k) exact dot products from weighted AND-popcounts."""
    counts = np.bitwise_count(x_planes[:, None, :, None] & c_planes[None, :, None, :]).astype(np.int64)
    w = weights(bits)
    return np.einsum("nkab,a,b->nk", counts, w, w)


class _Rounds:
    """The per-task work of a round, with the centroids as planes."""

    def __init__(self, centroids: np.ndarray, bits: int):
        self.bits = bits
        self.c_planes = planes(centroids, bits)
        self.c_norms = (centroids.astype(np.int64) ** 2).sum(axis=1)

    def assign(self, x_planes: np.ndarray, x_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number) and squared distance to it."""
        partial = self.c_norms[None, :] - 2 * dots(x_planes, self.c_planes, self.bits)
        cluster = partial.argmin(axis=1)
        return cluster, partial[np.arange(len(cluster)), cluster] + x_norms

    def _batches(self, frames):
        for frame in frames:
            if len(frame):
                x = np.array(frame["_planes"].tolist(), dtype=np.int64).view(np.uint64)
                yield frame, x, *self.assign(x, frame["_norm"].to_numpy(np.int64))

    def sums(self, frames):
        k = len(self.c_norms)
        count, total, spread = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for _, x, cluster, distance in self._batches(frames):
            np.add.at(count, cluster, 1)
            np.add.at(total, cluster, unpack(x, self.bits))
            np.add.at(spread, cluster, distance)
        held = np.flatnonzero(count)
        if not len(held):
            return
        yield pd.DataFrame({"cluster": held.astype(np.int32), "n": count[held], "spread": spread[held],
                            "total": [total[c].tolist() for c in held]})

    def rows(self, x_planes: pd.Series, x_norms: pd.Series) -> pd.DataFrame:
        if not len(x_planes):
            return pd.DataFrame({"cluster": pd.Series([], dtype=np.int32), "distance": pd.Series([], dtype=np.int64)})
        x = np.array(x_planes.tolist(), dtype=np.int64).view(np.uint64)
        cluster, distance = self.assign(x, x_norms.to_numpy(np.int64))
        return pd.DataFrame({"cluster": cluster.astype(np.int32), "distance": distance})


_SUMS = "cluster int, n long, spread long, total array<long>"


def _plane_udf(bits: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def to_planes(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        return pd.Series(list(planes(np.array(values.tolist(), dtype=np.int64), bits).view(np.int64)))

    return to_planes


def _per_cluster(vectors: DataFrame, work: _Rounds) -> dict[int, tuple[int, int, list[int]]]:
    """cluster -> (vectors, summed distance, componentwise sums); k rows reach the driver."""
    parts = vectors.select("_planes", "_norm").mapInPandas(work.sums, _SUMS)
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("spread").alias("spread"),
        *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(WIDTH)]).collect()
    return {r["cluster"]: (r["n"], r["spread"], [r[f"t{i}"] for i in range(WIDTH)]) for r in rows}


def centroid_hash(centroid) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10,
            seed_tag: str = "3", scale: int = SCALE) -> DataFrame:
    """Lloyd's rounds with exact integer centroids; one row per kept vector.

    Kept: vectors of exactly 64 components, none null, NaN or infinite; the others are left out, and an
    empty input (or none kept) gives no rows. Components become floor(scale * x). The first centroids are
    the k kept vectors with the smallest sha256 of `<seed_tag>:<id>` (ties and repeated rows: the smaller
    vector first, null ids last); fewer kept vectors make fewer clusters. A round assigns every vector to
    the nearest centroid (ties: the smaller number) and moves every non-empty centroid to the componentwise
    floor(sum / count); empty ones stay. After the rounds vectors are assigned once more.

    Result: `id_col`, cluster int, distance long (squared), cluster_inertia and inertia long (distance summed
    over the cluster and over all), centroid_sha256 (sha256 of the final centroid as decimal integers joined
    by `,`). Other input columns are not carried, so no name can clash. Components of magnitude 2^24 or more
    after scaling raise ValueError, since distances would not fit a long.
    """
    values = scaled_vectors(df, vector, scale)
    kept = df.select(F.col(id_col).alias("_id"), values.alias("_v")).where(F.col("_v").isNotNull())
    reach = kept.agg(F.min(F.array_min("_v")).alias("low"), F.max(F.array_max("_v")).alias("high")).first()
    result_schema = (f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, cluster int, distance long, "
                     "cluster_inertia long, inertia long, centroid_sha256 string")
    spark = df.sparkSession
    if reach["low"] is None:
        return spark.createDataFrame([], result_schema)
    if max(-reach["low"], reach["high"]) >= LARGEST:
        raise ValueError(f"scaled components reach {max(-reach['low'], reach['high'])}; at most {LARGEST - 1} fit")
    bits = max(int(reach["high"]).bit_length(), int(-reach["low"] - 1).bit_length()) + 1

    key = F.sha2(F.concat(F.lit(f"{seed_tag}:"), F.col("_id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), F.col("_v")).limit(k).select("_v").collect()
    centroids = np.array([r["_v"] for r in first], dtype=np.int64)

    vectors = cut_lineage(kept.select(
        "_id", _plane_udf(bits)("_v").alias("_planes"),
        F.aggregate("_v", F.lit(0).cast("long"), lambda acc, v: acc + v * v).alias("_norm")))
    for _ in range(rounds):
        for c, (n, _, total) in _per_cluster(vectors, _Rounds(centroids, bits)).items():
            centroids[c] = [t // n for t in total]

    work = _Rounds(centroids, bits)
    spread = {c: s for c, (_, s, _) in _per_cluster(vectors, work).items()}
    inertia = sum(spread.values())
    # One row per cluster: k rows, a proven bound, so broadcast.
    stats = spark.createDataFrame(
        [(c, spread.get(c, 0), inertia, centroid_hash(centroids[c])) for c in range(len(centroids))],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    nearest = F.pandas_udf(work.rows, "cluster int, distance long")
    assigned = vectors.select("_id", nearest("_planes", "_norm").alias("_a")).select("_id", "_a.*")
    return assigned.join(F.broadcast(stats), "cluster").select(
        F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
