"""The seven detectors in roster order, each on its own scaled view."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.detectors.base import Detector
from txnlens.detectors.centres import GaussianMixtureDetector, KMeansDetector
from txnlens.detectors.isolation import IsolationForest
from txnlens.detectors.neighbourhood import DBSCAN, LocalOutlierFactor
from txnlens.detectors.robust import MinCovDet
from txnlens.detectors.support import OneClassSVM
from txnlens.operators.scaling import Scaler
from txnlens.schema import DETECTORS, LIVE_DETECTORS, ROSTER

_KINDS = {
    "isolation_forest": IsolationForest,
    "lof": LocalOutlierFactor,
    "one_class_svm": OneClassSVM,
    "dbscan": DBSCAN,
    "mcd": MinCovDet,
    "gmm": GaussianMixtureDetector,
    "kmeans": KMeansDetector,
}
SCALER_OF = {name: scaler for name, _, scaler, _ in ROSTER}


def build_roster(settings: dict[str, dict] | None = None) -> dict[str, Detector]:
    """Every detector with its published settings, or those given by name."""
    settings = settings or {}
    return {name: _KINDS[name](**settings.get(name, {})) for name in DETECTORS}


def live_roster(roster: dict[str, Detector]) -> dict[str, Detector]:
    return {name: roster[name] for name in LIVE_DETECTORS if name in roster}


def scaled_rows(features: DataFrame, scaler: Scaler, key: str = "TransactionID") -> DataFrame:
    """(id, vector) through one scaler."""
    return features.select(F.col(key).alias("id"), scaler.vector())
