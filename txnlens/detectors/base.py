"""The detector contract: fit on (id, vector) rows, score others, transfer a threshold."""

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.operators.quantiles import quantiles
from txnlens.operators.ranking import distribution, rank_against, right_percentile
from txnlens.schema import CONTAMINATION
from txnlens.session import cut_lineage


class Detector(ABC):
    """Higher scores are more anomalous. Rows are (id, vector), vectors scaled."""

    name = "detector"

    def __init__(self, contamination: float = CONTAMINATION):
        self.contamination = contamination

    @abstractmethod
    def learn(self, rows: DataFrame) -> None:
        """Fit the model parameters."""

    @abstractmethod
    def score(self, rows: DataFrame) -> DataFrame:
        """(id, score) of rows that need not have been seen."""

    def training_score(self, rows: DataFrame) -> DataFrame:
        """The scores whose quantile becomes the training threshold."""
        return self.score(rows)

    def fit(self, rows: DataFrame) -> "Detector":
        self.learn(rows)
        self.training = cut_lineage(self.training_score(rows))
        self.threshold = self._cut(self.training)
        self.live, self.live_threshold = self.calibrate(rows)
        return self

    def calibrate(self, rows: DataFrame) -> tuple[DataFrame, float]:
        """The distribution and threshold that new rows are held against."""
        return self.training, self.threshold

    def _cut(self, scored: DataFrame) -> float:
        return quantiles(scored, ["score"], [1.0 - self.contamination])["score"][0]

    def training_flags(self) -> DataFrame:
        return self.training.withColumn("flag", (F.col("score") >= self.threshold).cast("int"))

    def flag(self, rows: DataFrame) -> DataFrame:
        """(id, score, flag) against the live threshold."""
        return self.score(rows).withColumn("flag", (F.col("score") >= self.live_threshold).cast("int"))

    def percentile(self, scored: DataFrame) -> DataFrame:
        """Add where each score falls in the live distribution, 0 to 100."""
        tagged = scored.withColumn("detector", F.lit(self.name))
        reference = distribution(self.live.withColumn("detector", F.lit(self.name)), ["detector"], "score")
        ranked = rank_against(tagged, reference, ["detector"], "score", "id")
        total = F.lit(float(self.live.count()))
        return ranked.select(
            *scored.columns, right_percentile(F.col("n_le"), total).alias("score_percentile"))
