"""Minimum covariance determinant: concentration steps over the whole table."""

import math

import numpy as np
import pyarrow as pa
from txnlens.detectors.base import Detector
from txnlens.detectors.batches import matrix, moments, score_with
from txnlens.operators.quantiles import BUFFER_ROWS, quantiles
from txnlens.operators.ranking import uniform_sample
from txnlens.schema import SEED

START_ROWS = 1_500  # rows of the sample on which starts are tried
TRIALS, KEPT, STEPS = 200, 2, 20


def chi2_quantile(degrees: int, p: float) -> float:
    """Inverse of the chi-squared distribution, by bisection on its series."""
    def below(x):
        a, x = degrees / 2, x / 2
        term = total = 1 / a
        for i in range(1, 1000):
            term *= x / (a + i)
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 40.0 * degrees
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def mahalanobis(model, x: np.ndarray) -> np.ndarray:
    """Squared distance under (location, covariance)."""
    location, covariance = model
    gap = x - location
    return np.einsum("ij,ij->i", gap @ np.linalg.pinv(covariance), gap)


def _moments_of(x):
    return x.mean(axis=0), np.cov(x.T, bias=True)


def _starts(sample: np.ndarray, seed: int):
    """The few best locations and covariances found on the bounded sample."""
    random = np.random.default_rng(seed)
    rows, width = sample.shape
    half = (rows + width + 1) // 2
    tried = []
    for _ in range(TRIALS):
        model = _moments_of(sample[random.choice(rows, width + 1, replace=False)])
        for _ in range(2):
            model = _moments_of(sample[np.argsort(mahalanobis(model, sample))[:half]])
        tried.append((np.linalg.slogdet(model[1])[1], model))
    tried.sort(key=lambda t: t[0])
    best = []
    for _, model in tried[:10]:
        for _ in range(STEPS):
            model = _moments_of(sample[np.argsort(mahalanobis(model, sample))[:half]])
        best.append((np.linalg.slogdet(model[1])[1], model))
    best.sort(key=lambda t: t[0])
    return [model for _, model in best[:KEPT]]


class MinCovDet(Detector):
    name = "mcd"

    def __init__(self, seed: int = SEED, start_rows: int = START_ROWS, **kwargs):
        super().__init__(**kwargs)
        self.seed, self.start_rows = seed, start_rows

    def learn(self, rows):
        rows = rows.select("id", "vector").persist()
        total = rows.count()
        sample = matrix(uniform_sample(rows, "id", self.start_rows, self.seed).orderBy("id").toPandas()["vector"])
        width = sample.shape[1]
        share = min(1.0, math.ceil(0.5 * (total + width + 1)) / total)
        first = [self._step(rows, model, share, total) for model in _starts(sample, self.seed)]
        determinant, model = min(first, key=lambda f: f[0])
        for _ in range(STEPS):
            last = determinant
            determinant, model = self._step(rows, model, share, total)
            if not determinant < last - 1e-7:
                break
        location, covariance = model

        # Consistency at the normal distribution, then one reweighting.
        median = _quantile(rows, (location, covariance), 0.5, total)
        self.model = (location, covariance * median / chi2_quantile(width, 0.5))
        inside = _select_within(rows, self.model, chi2_quantile(width, 0.975))
        _, location, covariance = moments(inside)
        self.model = (location, covariance)
        rows.unpersist()

    def _step(self, rows, model, share, total):
        """Refit on the nearest half; the determinant can only fall."""
        limit = _quantile(rows, model, share, total)
        _, location, covariance = moments(_select_within(rows, model, limit))
        return np.linalg.slogdet(covariance)[1], (location, covariance)

    def score(self, rows):
        return score_with(rows, self.model, mahalanobis)


def _quantile(rows, model, share, total):
    """A quantile of the distances, which are measured once and kept while its passes read them."""
    squared = score_with(rows, model, mahalanobis).select("score")
    if total > BUFFER_ROWS:
        squared = squared.persist()
    found = quantiles(squared, ["score"], [share], rows=total)["score"][0]
    squared.unpersist()
    return found


def _select_within(rows, model, limit):
    """Rows no farther than `limit`, filtered inside the batch that measures them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(mahalanobis(shared.value, matrix(batch["vector"])) <= limit))

    return rows.mapInArrow(near, rows.schema)
