"""K-Means, Gaussian mixture and PCA: MLlib or moment fits, scored from small parameters."""

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.detectors.base import Detector
from txnlens.detectors.batches import dot, matrix, moments, score_with, squared_distance, summed
from txnlens.schema import SEED


def _as_features(rows: DataFrame) -> DataFrame:
    return rows.select(array_to_vector("vector").alias("features"))


def nearest_centre(rows: DataFrame, centres) -> DataFrame:
    """(id, score, cluster): distance to the nearest centre, and which one it is."""
    gaps = F.array(*[squared_distance(F.col("vector"), c) for c in centres])
    return rows.select("id", gaps.alias("_gaps")).select(
        "id", F.sqrt(F.array_min("_gaps")).alias("score"),
        (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int").alias("cluster"),
    )


class KMeansDetector(Detector):
    name = "kmeans"

    def __init__(self, k: int = 8, starts: int = 10, seed: int = SEED, **kwargs):
        super().__init__(**kwargs)
        self.k, self.starts, self.seed = k, starts, seed

    def learn(self, rows):
        data = _as_features(rows).persist()
        fits = [KMeans(k=self.k, seed=self.seed + i, maxIter=50).fit(data) for i in range(self.starts)]
        data.unpersist()
        best = min(fits, key=lambda m: m.summary.trainingCost)
        self.centres = [c.tolist() for c in best.clusterCenters()]
        self.inertia = best.summary.trainingCost

    def score(self, rows):
        return nearest_centre(rows, self.centres).select("id", "score")


def elbow(rows: DataFrame, ks=range(2, 13), starts: int = 4, seed: int = SEED) -> DataFrame:
    """Lowest training cost for every k."""
    data = _as_features(rows).persist()
    found = [
        (k, min(KMeans(k=k, seed=seed + i).fit(data).summary.trainingCost for i in range(starts)))
        for k in ks
    ]
    data.unpersist()
    return rows.sparkSession.createDataFrame(found, "k int, inertia double")


@dataclass
class Mixture:
    """Weights, means and covariances, prepared for log-densities."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    ridge: float = 1e-6

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        width = x.shape[1]
        columns = []
        for weight, mean, cov in zip(self.weights, self.means, self.covariances):
            factor = np.linalg.cholesky(cov + self.ridge * np.eye(width))
            white = np.linalg.solve(factor, (x - mean).T)
            log_det = 2 * np.log(np.diag(factor)).sum()
            columns.append(
                np.log(weight) - 0.5 * ((white**2).sum(axis=0) + log_det + width * np.log(2 * np.pi)))
        return np.column_stack(columns)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each component in every row, and the rows' log-likelihoods."""
        joint = self.log_joint(x)
        top = joint.max(axis=1)
        total = top + np.log(np.exp(joint - top[:, None]).sum(axis=1))
        return np.exp(joint - total[:, None]), total

    def negative_log_likelihood(self, x: np.ndarray) -> np.ndarray:
        return -self.responsibilities(x)[1]


class GaussianMixtureDetector(Detector):
    name = "gmm"

    def __init__(self, k: int = 5, seed: int = SEED, iterations: int = 100, tolerance: float = 1e-3, **kwargs):
        super().__init__(**kwargs)
        self.k, self.seed, self.iterations, self.tolerance = k, seed, iterations, tolerance

    def learn(self, rows):
        """Expectation-maximisation from K-Means groups; each pass merges one array per task."""
        rows = rows.select("id", "vector").persist()
        start = KMeansDetector(self.k, starts=1, seed=self.seed)
        start.learn(rows)
        centres = np.array(start.centres)
        self.groups = len(centres)

        def to_nearest(_, x):
            gaps = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
            return np.eye(len(centres))[gaps.argmin(axis=1)], np.zeros(len(x))

        self.model, _ = self._maximise(rows, None, to_nearest)
        last = -np.inf
        for _ in range(self.iterations):
            self.model, likelihood = self._maximise(rows, self.model, Mixture.responsibilities)
            if likelihood - last < self.tolerance:
                break
            last = likelihood
        rows.unpersist()

    def _maximise(self, rows, model, responsibilities):
        """The next mixture, and the mean log-likelihood under the current one."""
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def sums(batch):
            x = matrix(batch["vector"])
            share, likelihood = responsibilities(shared.value, x)
            outer = np.einsum("nk,ni,nj->kij", share, x, x, optimize=True)
            return np.concatenate([
                [len(x), likelihood.sum()], share.sum(axis=0), (share.T @ x).ravel(), outer.ravel()])

        flat = summed(rows, sums)
        n, likelihood, rest = flat[0], flat[1], flat[2:]
        k = len(self.model.means) if model is not None else self.groups
        width = int((np.sqrt(4 * len(rest) / k - 3) - 1) / 2 + 0.5)
        mass = rest[:k] + 1e-10
        means = rest[k:k + k * width].reshape(k, width) / mass[:, None]
        second = rest[k + k * width:].reshape(k, width, width) / mass[:, None, None]
        covariances = second - np.einsum("ki,kj->kij", means, means)
        return Mixture(mass / n, means, covariances), likelihood / n

    def score(self, rows):
        return score_with(rows, self.model, Mixture.negative_log_likelihood)

    def clusters(self, rows: DataFrame) -> DataFrame:
        return score_with(rows, self.model, lambda m, x: m.log_joint(x).argmax(axis=1).astype(float), "c").select(
            "id", F.col("c").cast("int").alias("cluster"))


class PCA(Detector):
    """Principal components for a share of the variance; scored by what they leave out.

    A diagnostic: it supplies the plane of the reports and does not vote.
    """

    name = "pca"

    def __init__(self, share: float = 0.95, **kwargs):
        super().__init__(**kwargs)
        self.share = share

    def learn(self, rows):
        n, mean, covariance = moments(rows)
        values, vectors = np.linalg.eigh(covariance * n / (n - 1))
        order = np.argsort(values)[::-1]
        ratios = np.maximum(values[order], 0) / values.sum()
        keep = int(np.searchsorted(np.cumsum(ratios), self.share, side="right") + 1)
        keep = min(keep, len(ratios))
        self.use(mean, vectors[:, order[:keep]].T, ratios[:keep])

    def use(self, mean, loadings, ratios) -> "PCA":
        """Take given parameters: the mean, one row per component, their variance shares."""
        self.mean, self.loadings, self.ratios = map(np.asarray, (mean, loadings, ratios))
        return self

    def project(self, rows: DataFrame, components: int | None = None) -> DataFrame:
        """(id, pc1, pc2, ...) of centred rows; a missing second component is 0."""
        wanted = len(self.loadings) if components is None else components
        axes = [
            (dot(F.col("vector"), w) - F.lit(float(w @ self.mean))).alias(f"pc{i + 1}")
            for i, w in enumerate(self.loadings[:wanted])
        ]
        axes += [F.lit(0.0).alias(f"pc{i + 1}") for i in range(len(axes), wanted)]
        return rows.select("id", *axes)

    def lift(self, plane: DataFrame) -> DataFrame:
        """(id, vector): plane points (id, pc1, pc2) carried back to the feature space."""
        second = self.loadings[1] if len(self.loadings) > 1 else np.zeros(len(self.mean))
        cells = [
            F.lit(float(m)) + F.col("pc1") * F.lit(float(a)) + F.col("pc2") * F.lit(float(b))
            for m, a, b in zip(self.mean, self.loadings[0], second)
        ]
        return plane.select("id", F.array(*cells).alias("vector"))

    def score(self, rows):
        """Mean squared residual of the row after projection."""
        def residual(model, x):
            centred = x - model[0]
            return ((centred - centred @ model[1].T @ model[1]) ** 2).mean(axis=1)

        return score_with(rows, (self.mean, self.loadings), residual)

    def scree(self, spark) -> DataFrame:
        """Variance share per component and its running total."""
        return spark.createDataFrame(
            [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(self.ratios, np.cumsum(self.ratios)))],
            "component int, explained double, cumulative double")
