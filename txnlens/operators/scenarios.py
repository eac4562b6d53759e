"""Named scenario rows for injection tests of a fitted pipeline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens import schema
from txnlens.operators.ordered import Running, running


def scenario_table(spark) -> DataFrame:
    """One row per scenario: its base fields and whether repeats share a day."""
    rows = [
        (name, name in schema.ACCUMULATING_SCENARIOS,
         *[{**schema.SCENARIO_BASE, **changes}[c] for c in schema.SCORED_FIELDS])
        for name, changes in schema.SCENARIOS.items()
    ]
    kinds = {f.name: f.dataType.simpleString() for f in schema.PAYLOAD_SCHEMA.fields}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in schema.SCORED_FIELDS)
    return spark.createDataFrame(rows, f"scenario string, accumulates boolean, {ddl}").withColumn(
        "TransactionDate", F.col("TransactionDate").cast("timestamp_ntz"))


def inject(requests: DataFrame, order: str, overrides: list[str] = ()) -> DataFrame:
    """Scenario rows for (scenario, order, override columns) requests.

    The i-th request of a scenario is dated i days later unless its repeats are
    meant to pile up on one day; a non-null override replaces the base field.
    """
    counted = running(requests, ["scenario"], [order], {"_nth": Running("count")})
    given = [c for c in requests.columns if c not in overrides and c != "scenario"]
    asked = counted.select(
        "scenario", *given, "_nth", *[F.col(c).alias(f"_given_{c}") for c in overrides])
    base = F.broadcast(scenario_table(requests.sparkSession))  # four rows
    days = F.when(F.col("accumulates"), 0).otherwise(F.col("_nth") - 1).cast("int")
    dated = F.col("TransactionDate") + F.make_dt_interval(days)
    values = {"TransactionDate": dated}
    values.update({c: F.coalesce(f"_given_{c}", c) for c in overrides})
    return asked.join(base, "scenario").select(
        "scenario", *given, *[values.get(c, F.col(c)).alias(c) for c in schema.SCORED_FIELDS])
