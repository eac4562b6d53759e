"""History features: training matrix, profile tables and replay in arrival order."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions.text import quoted
from txnlens.operators.ordered import Running, running
from txnlens.operators.quantiles import quantiles
from txnlens.schema import FEATURES, LEVELS, NUMERIC_FEATURES
from txnlens.session import bounded_lookup

TIME_ORDER = ["TransactionDate", "TransactionID"]


def hours_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def day_of(when: Column) -> Column:
    return F.to_date(when)


def with_gap(txn: DataFrame) -> DataFrame:
    """Hours since the account's previous transaction; null for its first."""
    ordered = running(
        txn, ["AccountID"], TIME_ORDER, {"_previous": Running("previous", "TransactionDate")}
    )
    gap = hours_between(F.col("_previous"), F.col("TransactionDate"))
    return ordered.withColumn("gap_hours", gap).drop("_previous")


def with_running_count(txn: DataFrame, key: str, name: str) -> DataFrame:
    """How many transactions of `key` the day holds so far, this one included."""
    dated = txn.withColumn("_day", day_of(F.col("TransactionDate")))
    return running(dated, [key, "_day"], TIME_ORDER, {name: Running("count")}).drop("_day")


def location_counts(txn: DataFrame) -> DataFrame:
    return txn.groupBy("Location").agg(F.count(F.lit(1)).alias("n"))


def one_hot_columns() -> list[Column]:
    return [
        F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0)).alias(f"{c}_{level}")
        for c, levels in LEVELS.items()
        for level in levels
    ]


def utilization() -> Column:
    return F.col("TransactionAmount") / F.col("AccountBalance")


@dataclass
class FeatureState:
    """What scoring needs from training: city counts and the gap's median and maximum."""

    locations: DataFrame  # Location, n
    location_default: int
    gap_median: float
    gap_max: float


def feature_state(txn: DataFrame, gaps: DataFrame | None = None) -> FeatureState:
    gaps = with_gap(txn) if gaps is None else gaps
    locations = location_counts(txn)
    median, largest = quantiles(gaps, ["gap_hours"], [0.5, 1.0])["gap_hours"]
    rarest = locations.agg(F.min("n")).first()[0]
    return FeatureState(bounded_lookup(locations), int(rarest), median, largest)


def with_location_frequency(df: DataFrame, state: FeatureState) -> DataFrame:
    known = state.locations.select("Location", F.col("n").alias("_city_n"))
    return df.join(known, "Location", "left")


def training_features(txn: DataFrame, state: FeatureState | None = None) -> DataFrame:
    """TransactionID and the nineteen features in their fixed order."""
    gaps = with_gap(txn)
    state = state or feature_state(txn, gaps)
    counted = with_running_count(gaps, "AccountID", "DailyAccountVolume")
    counted = with_running_count(counted, "DeviceID", "DailyDeviceVelocity")
    placed = with_location_frequency(counted, state)
    filled = placed.select(
        "*",
        F.coalesce("gap_hours", F.lit(state.gap_median)).alias("TimeSinceLastTx_Hours"),
        utilization().alias("UtilizationRatio"),
        F.col("_city_n").alias("Location_Freq"),
    )
    return filled.select(
        "TransactionID",
        *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES],
        *one_hot_columns(),
    )


@dataclass
class Profiles:
    """Account and device history: last transaction, and counts per day."""

    account_last: DataFrame  # AccountID, last_ts
    account_days: DataFrame  # AccountID, day, n
    device_days: DataFrame  # DeviceID, day, n


def build_profiles(txn: DataFrame) -> Profiles:
    day = day_of(F.col("TransactionDate")).alias("day")
    count = F.count(F.lit(1)).alias("n")
    return Profiles(
        txn.groupBy("AccountID").agg(F.max("TransactionDate").alias("last_ts")),
        txn.groupBy("AccountID", day).agg(count),
        txn.groupBy("DeviceID", day).agg(count),
    )


def merge_profiles(old: Profiles, new: Profiles) -> Profiles:
    """Fold newer history into older: latest timestamp, summed counts."""

    def summed(a, b, key):
        return a.unionByName(b).groupBy(key, "day").agg(F.sum("n").alias("n"))

    return Profiles(
        old.account_last.unionByName(new.account_last)
        .groupBy("AccountID").agg(F.max("last_ts").alias("last_ts")),
        summed(old.account_days, new.account_days, "AccountID"),
        summed(old.device_days, new.device_days, "DeviceID"),
    )


def replay_features(
    rows: DataFrame,
    state: FeatureState,
    order: list[str],
    scope: list[str] = (),
    profiles: Profiles | None = None,
) -> DataFrame:
    """Features of rows in arrival order; each sees only the rows before it.

    `scope` columns (an upload id) keep histories apart. `profiles` is history
    from before the first row; without it every account starts unseen. Adds the
    features, `last_ts` and the `feature_warnings` array to the rows.
    """
    scope, order = list(scope), list(order)
    dated = rows.withColumn("_day", day_of(F.col("TransactionDate")))
    seen = running(
        dated, [*scope, "AccountID"], order, {"last_ts": Running("max_before", "TransactionDate")}
    )
    seen = running(
        seen, [*scope, "AccountID", "_day"], order, {"DailyAccountVolume": Running("count")}
    )
    seen = running(
        seen, [*scope, "DeviceID", "_day"], order, {"DailyDeviceVelocity": Running("count")}
    )
    if profiles is not None:
        seen = _with_history(seen, profiles)
    return _serve_rules(with_location_frequency(seen, state), state).drop("_day", "_city_n")


def serve_features(seen: DataFrame, state: FeatureState) -> DataFrame:
    """Features of rows that already carry their history (`last_ts` and the two day counts), as a
    stream's state emits them: the same serving rules as `replay_features`."""
    dated = seen.withColumn("_day", day_of(F.col("TransactionDate")))
    return _serve_rules(with_location_frequency(dated, state), state).drop("_day", "_city_n")


def _with_history(seen, profiles):
    last = profiles.account_last.withColumnRenamed("last_ts", "_old_ts")
    accounts = profiles.account_days.toDF("AccountID", "_day", "_account_n")
    devices = profiles.device_days.toDF("DeviceID", "_day", "_device_n")
    joined = (
        seen.join(last, "AccountID", "left")
        .join(accounts, ["AccountID", "_day"], "left")
        .join(devices, ["DeviceID", "_day"], "left")
    )

    def plus(name, old):
        return (F.col(name) + F.coalesce(old, F.lit(0))).alias(name)

    return joined.select(
        *[c for c in seen.columns if c not in ("last_ts", "DailyAccountVolume", "DailyDeviceVelocity")],
        F.greatest("last_ts", "_old_ts").alias("last_ts"),
        plus("DailyAccountVolume", F.col("_account_n")),
        plus("DailyDeviceVelocity", F.col("_device_n")),
    )


def _serve_rules(df, state):
    """Fall back to training values where history or city is unknown, and say so."""
    gap = hours_between(F.col("last_ts"), F.col("TransactionDate"))
    median, largest = F.lit(state.gap_median), F.lit(state.gap_max)
    median_text, largest_text = f"{state.gap_median:.2f}h", f"{state.gap_max:.2f}h"
    unseen = F.col("last_ts").isNull()
    predates = gap < 0
    beyond = gap > state.gap_max
    no_city = F.col("_city_n").isNull()

    account = F.col("AccountID")
    gap_note = (
        F.when(unseen, F.format_string(
            "unseen account %s: TimeSinceLastTx_Hours filled with the training median "
            f"({median_text})", account))
        .when(predates, F.format_string(
            "transaction predates account %s's last known activity: TimeSinceLastTx_Hours "
            f"filled with the training median ({median_text})", account))
        .when(beyond, F.format_string(
            "gap since account %s's last transaction (%.2fh) exceeds the training range "
            f"(max {largest_text}): TimeSinceLastTx_Hours capped at the training maximum "
            f"({largest_text})", account, gap))
    )
    city_note = F.when(no_city, F.format_string(
        "unseen location %s: Location_Freq set to the training minimum "
        f"({state.location_default})", quoted(F.col("Location"))))
    level_notes = [
        F.when(~F.col(c).isin(levels), F.format_string(
            f"unseen {c} %s: all {c} indicators set to 0", quoted(F.col(c))))
        for c, levels in LEVELS.items()
    ]
    values = {
        "TimeSinceLastTx_Hours": F.when(unseen | predates, median).when(beyond, largest).otherwise(gap),
        "UtilizationRatio": utilization(),
        "Location_Freq": F.coalesce("_city_n", F.lit(state.location_default)).cast("double"),
    }
    kept = [c for c in df.columns if c not in NUMERIC_FEATURES]
    return df.select(
        *kept,
        *[values.get(c, F.col(c).cast("double")).alias(c) for c in NUMERIC_FEATURES],
        *one_hot_columns(),
        F.array_compact(F.array(gap_note, city_note, *level_notes)).alias("feature_warnings"),
    )


def notebook_features(txn: DataFrame) -> DataFrame:
    """The exploratory variants: whole-day totals, gap to the export stamp, one-hots.

    Day totals are counted before they are joined back, so a busy account or
    device never travels whole to one task.
    """
    dated = txn.withColumn("_day", day_of(F.col("TransactionDate")))

    def totals(key, name):
        return dated.groupBy(key, "_day").agg(F.count("TransactionID").alias(name))

    return (
        dated.join(totals("AccountID", "DailyAccountVolume"), ["AccountID", "_day"])
        .join(totals("DeviceID", "DailyDeviceVelocity"), ["DeviceID", "_day"])
        .select(
            "TransactionID",
            hours_between(F.col("PreviousTransactionDate"), F.col("TransactionDate"))
            .alias("TimeSinceLastTx_Hours"),
            "DailyAccountVolume",
            "DailyDeviceVelocity",
            utilization().alias("UtilizationRatio"),
            *one_hot_columns(),
        )
    )


def feature_columns() -> list[str]:
    return list(FEATURES)
