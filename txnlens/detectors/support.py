"""One-class SVM with an RBF kernel, through random Fourier features.

The kernel is approximated by D cosine features (Rahimi and Recht, 2007). The
dual of the one-class problem is then solved by Frank-Wolfe steps: each pass
averages the features of the `nu` share of rows with the lowest margin, so only
D sums per task are merged.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from txnlens.detectors.base import Detector
from txnlens.detectors.batches import matrix, moments, score_with, summed
from txnlens.operators.quantiles import quantiles
from txnlens.schema import SEED


@dataclass
class Machine:
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    offset: float = 0.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.frequencies.T + self.phases)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def outlyingness(self, x: np.ndarray) -> np.ndarray:
        return self.offset - self.margin(x)


class OneClassSVM(Detector):
    name = "one_class_svm"

    def __init__(self, nu: float = 0.05, width: int = 256, passes: int = 15, seed: int = SEED, **kwargs):
        super().__init__(**kwargs)
        self.nu, self.width, self.passes, self.seed = nu, width, passes, seed

    def learn(self, rows):
        rows = rows.select("id", "vector").persist()
        n, mean, covariance = moments(rows)
        size = len(mean)
        spread = float((np.diag(covariance) + mean**2).mean() - mean.mean() ** 2)
        self.gamma = 1.0 / (size * spread)
        random = np.random.default_rng(self.seed)
        machine = Machine(
            random.normal(scale=np.sqrt(2 * self.gamma), size=(self.width, size)),
            random.uniform(0, 2 * np.pi, self.width), np.zeros(self.width))
        machine.weights = self._average(rows, machine, np.inf)
        for step in range(1, self.passes + 1):
            margins = score_with(rows, machine, Machine.margin)
            low = margins.agg(F.percentile_approx("score", self.nu, 10_000)).first()[0]
            pull = 2.0 / (step + 2)
            machine.weights = (1 - pull) * machine.weights + pull * self._average(rows, machine, low)
        margins = score_with(rows, machine, Machine.margin)
        machine.offset = quantiles(margins, ["score"], [self.nu], rows=int(n))["score"][0]
        self.machine = machine
        rows.unpersist()

    def _average(self, rows, machine, limit):
        """Mean feature vector of the rows whose margin is at most `limit`."""
        shared = rows.sparkSession.sparkContext.broadcast(machine)

        def sums(batch):
            lifted = shared.value.lift(matrix(batch["vector"]))
            inside = lifted @ shared.value.weights <= limit
            return np.concatenate([[inside.sum()], lifted[inside].sum(axis=0)])

        flat = summed(rows, sums)
        return flat[1:] / max(flat[0], 1.0)

    def score(self, rows):
        return score_with(rows, self.machine, Machine.outlyingness)
