"""Standard and robust scaling as fitted numbers applied in column expressions."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.operators.quantiles import quantiles
from txnlens.schema import CONTINUOUS_FEATURES, FEATURES


@dataclass
class Scaler:
    """Per column: a centre and a width; a zero width divides by one."""

    centre: dict[str, float]
    width: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return list(self.centre)

    def expression(self, column: str) -> Column:
        width = self.width[column] or 1.0
        return ((F.col(column) - F.lit(self.centre[column])) / F.lit(width)).alias(column)

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        return df.select(*keep, *[self.expression(c) for c in self.columns])

    def vector(self, name: str = "vector") -> Column:
        return F.array(*[self.expression(c) for c in self.columns]).alias(name)


def fit_standard(df: DataFrame, columns: list[str]) -> Scaler:
    """Mean and population standard deviation, all columns in one pass."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        *[(F.min(c) == F.max(c)).alias(f"flat_{c}") for c in columns],
    ).first()
    return Scaler(
        {c: float(row[f"m_{c}"]) for c in columns},
        {c: 0.0 if row[f"flat_{c}"] else float(row[f"s_{c}"]) for c in columns},
    )


def fit_robust(df: DataFrame, columns: list[str]) -> Scaler:
    """Median and interquartile range, exact and interpolated."""
    found = quantiles(df, columns, [0.25, 0.5, 0.75])
    return Scaler(
        {c: q[1] for c, q in found.items()}, {c: q[2] - q[0] for c, q in found.items()}
    )


def fit_scalers(features: DataFrame) -> dict[str, Scaler]:
    """One scaler per detector view."""
    return {
        "standard": fit_standard(features, FEATURES),
        "robust": fit_robust(features, FEATURES),
        "continuous": fit_standard(features, CONTINUOUS_FEATURES),
    }
