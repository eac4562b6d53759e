"""History features and scaling: FEA1-FEA18, SCL1-SCL3, the flagship query."""

from pyspark.sql import functions as F

from txnlens.catalog.base import (
    GAPS, TXN, UPLOAD, feature_sql, features, query, rounded, scaled_sql, sql, state, txn, uploads,
)
from txnlens.operators import features as fe
from txnlens.operators import scaling
from txnlens.operators.quantiles import quantiles
from txnlens.functions.text import to_naive_timestamp
from txnlens.schema import CONTINUOUS_FEATURES, FEATURES, ONE_HOT_FEATURES

_ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FEATURES)


@query("fea1_gap_hours", sql(TXN, GAPS, "SELECT TransactionID, round(gap_hours, 6) AS gap_hours FROM gaps"))
def gap_hours(spark, folder):
    return fe.with_gap(txn(spark, folder)).select(
        "TransactionID", rounded("gap_hours").alias("gap_hours")
    )


@query("fea2_gap_median_max", sql(TXN, GAPS, """
SELECT round(quantile_cont(gap_hours, 0.5), 6) AS gap_median, round(max(gap_hours), 6) AS gap_max FROM gaps"""))
def gap_median_max(spark, folder):
    gaps = fe.with_gap(txn(spark, folder))
    median, largest = quantiles(gaps, ["gap_hours"], [0.5, 1.0])["gap_hours"]
    return gaps.agg(F.first(F.lit(median)).alias("m"), F.first(F.lit(largest)).alias("x")).select(
        rounded("m").alias("gap_median"), rounded("x").alias("gap_max")
    )


@query("fea3_gap_filled", sql(TXN, GAPS, """
SELECT TransactionID, round(coalesce(gap_hours, (SELECT quantile_cont(gap_hours, 0.5) FROM gaps)), 6) AS gap_hours FROM gaps"""))
def gap_filled(spark, folder):
    gaps = fe.with_gap(txn(spark, folder))
    median = quantiles(gaps, ["gap_hours"], [0.5])["gap_hours"][0]
    return gaps.select(
        "TransactionID", rounded(F.coalesce("gap_hours", F.lit(median))).alias("gap_hours")
    )


def _running_count_sql(key, name):
    return sql(TXN, f"""SELECT TransactionID, row_number() OVER (
      PARTITION BY {key}, CAST(TransactionDate AS DATE) ORDER BY TransactionDate, TransactionID) AS {name} FROM txn""")


@query("fea4_running_account_count", _running_count_sql("AccountID", "DailyAccountVolume"))
def running_account_count(spark, folder):
    counted = fe.with_running_count(txn(spark, folder), "AccountID", "DailyAccountVolume")
    return counted.select("TransactionID", "DailyAccountVolume")


@query("fea5_running_device_count", _running_count_sql("DeviceID", "DailyDeviceVelocity"))
def running_device_count(spark, folder):
    counted = fe.with_running_count(txn(spark, folder), "DeviceID", "DailyDeviceVelocity")
    return counted.select("TransactionID", "DailyDeviceVelocity")


@query("fea6_utilization", sql(TXN, """
SELECT TransactionID, round(TransactionAmount / AccountBalance, 6) AS utilization FROM txn"""))
def utilization(spark, folder):
    return txn(spark, folder).select("TransactionID", rounded(fe.utilization()).alias("utilization"))


@query("fea7_location_frequency", sql(TXN, """
SELECT TransactionID, Location, count(*) OVER (PARTITION BY Location) AS frequency FROM txn"""))
def location_frequency(spark, folder):
    placed = fe.with_location_frequency(txn(spark, folder), state(spark, folder))
    return placed.select("TransactionID", "Location", F.col("_city_n").alias("frequency"))


@query("fea8_unseen_location_default", sql(TXN, """
known AS (SELECT Location, count(*) AS n FROM txn WHERE MerchantID < 'M050' GROUP BY Location HAVING count(*) % 3 > 0)""", """
SELECT TransactionID, coalesce(k.n, (SELECT min(n) FROM known)) AS frequency, k.n IS NULL AS unseen
FROM txn LEFT JOIN known k USING (Location)"""))
def unseen_location_default(spark, folder):
    """Cities counted on part of the merchants; the rest of the table meets unseen ones."""
    t = txn(spark, folder)
    known = fe.location_counts(t.filter("MerchantID < 'M050'")).filter("n % 3 > 0")
    rarest = known.agg(F.min("n").alias("n")).first()[0]
    placed = fe.with_location_frequency(t, fe.FeatureState(known, rarest, 0.0, 0.0))
    return placed.select(
        "TransactionID",
        F.coalesce("_city_n", F.lit(rarest)).alias("frequency"),
        F.col("_city_n").isNull().alias("unseen"),
    )


@query("fea9_one_hot", feature_sql(
    "SELECT TransactionID, " + ", ".join(ONE_HOT_FEATURES) + " FROM feat"))
def one_hot(spark, folder):
    return txn(spark, folder).select("TransactionID", *fe.one_hot_columns())


@query("fea10_training_matrix", feature_sql(f"SELECT TransactionID, {_ROUNDED} FROM feat"))
def training_matrix(spark, folder):
    return features(spark, folder).select(
        "TransactionID", *[rounded(c).alias(c) for c in FEATURES]
    )


@query("fea11_profiles", sql(TXN, """
SELECT 'account' AS kind, AccountID AS key, CAST(max(TransactionDate) AS VARCHAR) AS stamp, CAST(0 AS BIGINT) AS n FROM txn GROUP BY AccountID
UNION ALL SELECT 'account_day', AccountID, CAST(CAST(TransactionDate AS DATE) AS VARCHAR), count(*) FROM txn GROUP BY AccountID, CAST(TransactionDate AS DATE)
UNION ALL SELECT 'device_day', DeviceID, CAST(CAST(TransactionDate AS DATE) AS VARCHAR), count(*) FROM txn GROUP BY DeviceID, CAST(TransactionDate AS DATE)"""))
def profiles(spark, folder):
    p = fe.build_profiles(txn(spark, folder))
    last = p.account_last.select(
        F.lit("account").alias("kind"), F.col("AccountID").alias("key"),
        F.col("last_ts").cast("string").alias("stamp"), F.lit(0).cast("long").alias("n"))
    account = p.account_days.select(
        F.lit("account_day"), "AccountID", F.col("day").cast("string"), "n")
    device = p.device_days.select(
        F.lit("device_day"), "DeviceID", F.col("day").cast("string"), "n")
    return last.union(account).union(device)


# History up to a date; the rows after it are served in a shuffled arrival order.
_CUT = "2024-01-19"
_SERVE = f"""
old AS (SELECT * FROM txn WHERE TransactionDate < TIMESTAMP '{_CUT} 00:00:00'),
late AS (SELECT *, CAST(TransactionDate AS DATE) AS d, md5(TransactionID) AS arrival
         FROM txn WHERE TransactionDate >= TIMESTAMP '{_CUT} 00:00:00'),
old_gaps AS (SELECT date_diff('microsecond', lag(TransactionDate) OVER (
    PARTITION BY AccountID ORDER BY TransactionDate, TransactionID), TransactionDate) / 3.6e9 AS g FROM old),
art AS (SELECT quantile_cont(g, 0.5) AS med, max(g) AS mx FROM old_gaps),
last AS (SELECT AccountID, max(TransactionDate) AS ts FROM old GROUP BY AccountID),
acct AS (SELECT AccountID, CAST(TransactionDate AS DATE) AS d, count(*) AS n FROM old GROUP BY ALL),
dev AS (SELECT DeviceID, CAST(TransactionDate AS DATE) AS d, count(*) AS n FROM old GROUP BY ALL),
served AS (
  SELECT late.*,
    date_diff('microsecond', greatest(last.ts, max(late.TransactionDate) OVER (
      PARTITION BY late.AccountID ORDER BY arrival, TransactionID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      TransactionDate) / 3.6e9 AS gap,
    row_number() OVER (PARTITION BY late.AccountID, late.d ORDER BY arrival, TransactionID) + coalesce(acct.n, 0) AS account_n,
    row_number() OVER (PARTITION BY late.DeviceID, late.d ORDER BY arrival, TransactionID) + coalesce(dev.n, 0) AS device_n
  FROM late LEFT JOIN last ON last.AccountID = late.AccountID
            LEFT JOIN acct ON acct.AccountID = late.AccountID AND acct.d = late.d
            LEFT JOIN dev ON dev.DeviceID = late.DeviceID AND dev.d = late.d)"""


def _served(spark, folder):
    t = txn(spark, folder)
    cut = F.lit(f"{_CUT} 00:00:00").cast("timestamp_ntz")
    old = t.filter(F.col("TransactionDate") < cut)
    late = t.filter(F.col("TransactionDate") >= cut).withColumn("arrival", F.md5("TransactionID"))
    return fe.replay_features(
        late, fe.feature_state(old), ["arrival", "TransactionID"],
        profiles=fe.build_profiles(old),
    )


@query("fea12_serve_gap_rule", sql(TXN, _SERVE, """
SELECT TransactionID,
  round(CASE WHEN gap IS NULL OR gap < 0 THEN med WHEN gap > mx THEN mx ELSE gap END, 6) AS gap_hours,
  CASE WHEN gap IS NULL THEN 'unseen account ' || AccountID || ': TimeSinceLastTx_Hours filled with the training median (' || printf('%.2f', med) || 'h)'
       WHEN gap < 0 THEN 'transaction predates account ' || AccountID || '''s last known activity: TimeSinceLastTx_Hours filled with the training median (' || printf('%.2f', med) || 'h)'
       WHEN gap > mx THEN 'gap since account ' || AccountID || '''s last transaction (' || printf('%.2f', gap) || 'h) exceeds the training range (max ' || printf('%.2f', mx) || 'h): TimeSinceLastTx_Hours capped at the training maximum (' || printf('%.2f', mx) || 'h)'
       ELSE '' END AS warning
FROM served, art"""))
def serve_gap_rule(spark, folder):
    gap_note = F.concat_ws("|", F.filter("feature_warnings", lambda w: w.contains("TimeSince")))
    return _served(spark, folder).select(
        "TransactionID", rounded("TimeSinceLastTx_Hours").alias("gap_hours"),
        gap_note.alias("warning"),
    )


@query("fea13_serve_counts", sql(TXN, _SERVE, """
SELECT TransactionID, CAST(account_n AS BIGINT) AS account_count, CAST(device_n AS BIGINT) AS device_count FROM served"""))
def serve_counts(spark, folder):
    return _served(spark, folder).select(
        "TransactionID",
        F.col("DailyAccountVolume").cast("long").alias("account_count"),
        F.col("DailyDeviceVelocity").cast("long").alias("device_count"),
    )


def _replay_sql(scope, rows, key):
    part = f"{scope}, " if scope else ""
    return sql(TXN, GAPS, f"""
src AS (SELECT *, CAST(TransactionDate AS DATE) AS d {rows}),
art AS (SELECT quantile_cont(gap_hours, 0.5) AS med, max(gap_hours) AS mx FROM gaps),
r AS (SELECT *,
  date_diff('microsecond', max(TransactionDate) OVER (PARTITION BY {part}AccountID ORDER BY {key}
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TransactionDate) / 3.6e9 AS gap,
  row_number() OVER (PARTITION BY {part}AccountID, d ORDER BY {key}) AS account_count,
  row_number() OVER (PARTITION BY {part}DeviceID, d ORDER BY {key}) AS device_count FROM src)""", """
SELECT TransactionID, round(CASE WHEN gap IS NULL OR gap < 0 THEN med WHEN gap > mx THEN mx ELSE gap END, 6) AS gap_hours,
  account_count, device_count FROM r, art""")


def _replay_columns(df):
    return df.select(
        "TransactionID", rounded("TimeSinceLastTx_Hours").alias("gap_hours"),
        F.col("DailyAccountVolume").cast("long").alias("account_count"),
        F.col("DailyDeviceVelocity").cast("long").alias("device_count"),
    )


@query("fea14_arrival_replay", _replay_sql("", ", md5(TransactionID) AS arrival FROM txn", "arrival, TransactionID"))
def arrival_replay(spark, folder):
    arrived = txn(spark, folder).withColumn("arrival", F.md5("TransactionID"))
    return _replay_columns(
        fe.replay_features(arrived, state(spark, folder), ["arrival", "TransactionID"])
    )


@query("fea15_store_isolation", _replay_sql(
    "upload_id", ", CAST(right(TransactionID, 5) AS BIGINT) % 7 AS upload_id FROM txn", "TransactionID"))
def store_isolation(spark, folder):
    scoped = txn(spark, folder).withColumn(
        "upload_id", F.substring("TransactionID", -5, 5).cast("long") % 7
    )
    return _replay_columns(
        fe.replay_features(scoped, state(spark, folder), ["TransactionID"], ["upload_id"])
    )


@query("fea16_history_parity", sql(TXN, """
SELECT CAST(0 AS BIGINT) AS rows_differing, count(*) AS rows_compared,
  count(DISTINCT AccountID) AS accounts_starting_unseen FROM txn"""))
def history_parity(spark, folder):
    """Replay in time order against the training matrix: no row may differ."""
    replayed = fe.replay_features(txn(spark, folder), state(spark, folder), fe.TIME_ORDER)
    trained = features(spark, folder)
    pairs = replayed.alias("r").join(trained.alias("t"), "TransactionID")
    same = F.lit(True)
    for c in FEATURES:
        same = same & (F.abs(F.col(f"r.{c}") - F.col(f"t.{c}")) <= 1e-9 * F.greatest(F.abs(f"t.{c}"), F.lit(1.0)))
    return pairs.agg(
        F.count_if(~same).alias("rows_differing"),
        F.count(F.lit(1)).alias("rows_compared"),
        F.count_if(F.col("last_ts").isNull()).alias("accounts_starting_unseen"),
    )


@query("fea17_naive_timestamps", sql(UPLOAD, """
SELECT line, CASE WHEN TransactionDate = 'not a date' THEN NULL
  ELSE CAST(CAST(TransactionDate AS TIMESTAMP) AS VARCHAR) END AS stamp FROM upload"""))
def naive_timestamps(spark, folder):
    """Every text is given an offset first; the wall time must survive it."""
    offset = F.when(F.col("line") % 2 == 0, "+05:30").otherwise("-08:00")
    aware = F.concat(F.replace(F.col("TransactionDate"), F.lit(" "), F.lit("T")), offset)
    return uploads(spark, folder).select(
        "line", to_naive_timestamp(aware).cast("string").alias("stamp")
    )


@query("fea18_notebook_variants", sql(TXN, """
SELECT TransactionID,
  round(date_diff('microsecond', PreviousTransactionDate, TransactionDate) / 3.6e9, 6) AS gap_hours,
  count(*) OVER (PARTITION BY AccountID, CAST(TransactionDate AS DATE)) AS account_day_total,
  count(*) OVER (PARTITION BY DeviceID, CAST(TransactionDate AS DATE)) AS device_day_total
FROM txn"""))
def notebook_variants(spark, folder):
    return fe.notebook_features(txn(spark, folder)).select(
        "TransactionID", rounded("TimeSinceLastTx_Hours").alias("gap_hours"),
        F.col("DailyAccountVolume").alias("account_day_total"),
        F.col("DailyDeviceVelocity").alias("device_day_total"),
    )


def _scaled(scaler, frame, columns):
    return scaler.transform(frame, ["TransactionID"]).select(
        "TransactionID", *[rounded(c).alias(c) for c in columns]
    )


def _scaled_check(kind, columns):
    shown = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)
    return feature_sql(scaled_sql(kind, columns), f"SELECT TransactionID, {shown} FROM scaled")


@query("scl1_standard_scale", _scaled_check("standard", FEATURES))
def standard_scale(spark, folder):
    frame = features(spark, folder)
    return _scaled(scaling.fit_standard(frame, FEATURES), frame, FEATURES)


@query("scl2_robust_scale", _scaled_check("robust", FEATURES))
def robust_scale(spark, folder):
    frame = features(spark, folder)
    return _scaled(scaling.fit_robust(frame, FEATURES), frame, FEATURES)


@query("scl3_continuous_scale", _scaled_check("standard", CONTINUOUS_FEATURES))
def continuous_scale(spark, folder):
    frame = features(spark, folder)
    scaler = scaling.fit_standard(frame, CONTINUOUS_FEATURES)
    return _scaled(scaler, frame, CONTINUOUS_FEATURES)


@query("flagship_distance_flags", feature_sql(scaled_sql("standard"), f"""
dist AS (SELECT TransactionID, round(sqrt({" + ".join(f"{c} * {c}" for c in FEATURES)}), 6) AS score FROM scaled),
cut AS (SELECT quantile_cont(score, 0.95) AS threshold FROM dist)""", """
SELECT TransactionID, AccountID, TransactionAmount, AccountBalance, score
FROM dist JOIN txn USING (TransactionID), cut WHERE score >= threshold"""))
def distance_flags(spark, folder):
    """Rows far from the centre of the scaled features, joined to their transaction."""
    frame = features(spark, folder)
    vector = scaling.fit_standard(frame, FEATURES).vector()
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)
    scored = frame.select("TransactionID", F.round(F.sqrt(squares), 6).alias("score"))
    threshold = quantiles(scored, ["score"], [0.95])["score"][0]
    shown = ["TransactionID", "AccountID", "TransactionAmount", "AccountBalance"]
    return (
        scored.filter(F.col("score") >= threshold)
        .join(txn(spark, folder).select(*shown), "TransactionID")
        .select(*shown, "score")
    )
