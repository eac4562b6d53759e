"""Detector contracts on a toy frame, attributions against brute force."""

import itertools
from math import factorial

import numpy as np
import pandas as pd
import pytest

from txnlens.detectors.centres import PCA, GaussianMixtureDetector, KMeansDetector
from txnlens.detectors.isolation import IsolationForest
from txnlens.detectors.neighbourhood import LocalOutlierFactor
from txnlens.detectors.robust import MinCovDet, chi2_quantile
from txnlens.detectors.support import OneClassSVM
from txnlens.operators import voting
from txnlens.operators.attribution import TreeAttribution


@pytest.fixture(scope="module")
def toy(spark):
    """114 ordinary rows and 6 far away in different directions."""
    rng = np.random.default_rng(0)
    away = np.vstack([np.eye(4)[:3], -np.eye(4)[:3]]) * 9
    data = np.vstack([rng.normal(size=(114, 4)), away])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id long, vector array<double>").persist()


@pytest.mark.parametrize("detector", [
    IsolationForest(trees=40), LocalOutlierFactor(k=10), OneClassSVM(nu=0.2, width=1024, passes=20), MinCovDet(),
    GaussianMixtureDetector(k=2, iterations=5), KMeansDetector(k=2, starts=2),
], ids=lambda d: d.name)
def test_rate_direction_and_percentile(toy, detector):
    detector.fit(toy)
    flags = detector.training_flags().toPandas()
    assert abs(flags["flag"].sum() - 6) <= 1
    assert (flags["flag"] == (flags["score"] >= detector.threshold)).all()
    assert flags.loc[flags["flag"] == 1, "id"].ge(114).mean() >= 0.8
    ranked = detector.percentile(detector.flag(toy)).toPandas()
    assert ranked["score_percentile"].max() == 100.0 and ranked["score_percentile"].min() > 0


def test_fits_are_repeatable(toy):
    first, again = (IsolationForest(trees=10).fit(toy).training.toPandas().sort_values("id") for _ in range(2))
    assert np.array_equal(first["score"].to_numpy(), again["score"].to_numpy())


def test_pca_keeps_the_wanted_share(toy):
    model = PCA(0.95).fit(toy)
    assert model.ratios.sum() > 0.95 and (model.ratios[:-1].sum() <= 0.95)
    plane = model.project(toy, 2)
    assert plane.columns == ["id", "pc1", "pc2"] and model.lift(plane).count() == 120


def test_chi2_quantile():
    assert abs(chi2_quantile(7, 0.975) - 16.01276) < 1e-4 and abs(chi2_quantile(7, 0.5) - 6.34581) < 1e-4


@pytest.mark.parametrize("n, share, wanted", [(4, 0.5, 2), (4, 0.0, 1), (4, 1.0, 4), (7, 0.5, 4), (1, 0.5, 1)])
def test_quorum(n, share, wanted):
    assert voting.votes_required(n, share) == wanted


def test_quorum_needs_detectors():
    with pytest.raises(ValueError):
        voting.votes_required(0, 0.5)


def _nodes():
    """One tree that uses a feature twice on a path."""
    return pd.DataFrame([
        (0, 0, 0.0, 100.0, 1, 2, 0, 0.5), (0, 1, 0.0, 60.0, 3, 4, 1, 0.0), (0, 2, 3.0, 40.0, -1, -1, -1, None),
        (0, 3, -1.0, 20.0, -1, -1, -1, None), (0, 4, 0.0, 40.0, 5, 6, 0, -0.5),
        (0, 5, 2.0, 10.0, -1, -1, -1, None), (0, 6, 0.5, 30.0, -1, -1, -1, None),
    ], columns=["tree", "node", "value", "cover", "left", "right", "feature", "threshold"])


def _expected(nodes, x, known, at=0):
    node = nodes.loc[at]
    if node["left"] < 0:
        return node["value"]
    left, right = int(node["left"]), int(node["right"])
    if int(node["feature"]) in known:
        return _expected(nodes, x, known, left if x[int(node["feature"])] <= node["threshold"] else right)
    share = nodes.loc[left, "cover"] / node["cover"]
    return share * _expected(nodes, x, known, left) + (1 - share) * _expected(nodes, x, known, right)


def test_attributions_equal_the_shapley_sum():
    nodes = _nodes()
    model = TreeAttribution(nodes, [0.5], 3)  # log-odds are twice the margin, so weight one
    indexed = nodes.set_index("node")
    rows = np.random.default_rng(1).normal(size=(20, 3))
    got = model.contributions(rows)
    for x, phi in zip(rows, got):
        for i in range(3):
            total = 0.0
            others = [j for j in range(3) if j != i]
            for size in range(3):
                weight = factorial(size) * factorial(2 - size) / factorial(3)
                for s in itertools.combinations(others, size):
                    total += weight * (_expected(indexed, x, {*s, i}) - _expected(indexed, x, set(s)))
            assert np.isclose(phi[i], total)
        assert np.isclose(model.base + phi.sum(), _expected(indexed, x, {0, 1, 2}))


def test_arrow_batches_become_matrices(spark):
    import pyarrow as pa
    from txnlens.detectors.batches import matrix, score_with

    whole = pa.array([[0.0, 1.0], [2.0, None], [4.0, 5.0]], pa.list_(pa.float64()))
    assert np.array_equal(matrix(whole.slice(1)), [[2.0, np.nan], [4.0, 5.0]], equal_nan=True)
    with pytest.raises(ValueError):
        matrix(pa.array([[1.0], [1.0, 2.0, 3.0]], pa.list_(pa.float64())))
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 1.0])], "id long, vector array<double>")
    got = {r["id"]: r["score"] for r in score_with(rows, 3.0, lambda m, x: x.sum(axis=1) * m).collect()}
    assert got == {1: 9.0, 2: None}


def test_mcd_keeps_the_distances_that_quantiles_read_more_than_once(spark, monkeypatch):
    from txnlens.detectors import robust

    x = np.random.default_rng(6).normal(size=(200, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    kept, measure = [], robust.quantiles
    monkeypatch.setattr(robust, "quantiles", lambda df, *rest, **more: kept.append(df.is_cached) or measure(df, *rest, **more))
    monkeypatch.setattr(robust, "BUFFER_ROWS", 100, raising=False)
    robust.MinCovDet(start_rows=100).learn(rows)
    assert kept and all(kept)
