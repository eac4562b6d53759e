"""Splits, thresholds, votes, aggregates, windows and set operations."""

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from txnlens import schema
from txnlens.catalog.base import (
    FEATURES, TXN, feature_sql, features, query, rounded, sql, txn, unpivot_sql,
)
from txnlens.catalog.ingest import RESULTS, results
from txnlens.operators import explore as ex
from txnlens.operators import metrics, ranking, review, voting
from txnlens.operators.features import day_of
from txnlens.operators.ordered import Running, running
from txnlens.session import cut_lineage

# Stand-in scores: one fixed formula per roster name, so that SQL can follow them.
_FORMULAS = {
    "isolation_forest": "TransactionAmount / 1e2 + LoginAttempts",
    "lof": "UtilizationRatio * 1e1 + DailyAccountVolume / 1e1",
    "one_class_svm": "abs(CustomerAge - 49) / 1e1 + TransactionAmount / 5e1",
    "dbscan": "TimeSinceLastTx_Hours / 1e1 + TransactionAmount / 2e2",
    "mcd": "AccountBalance / 1e3",
    "gmm": "DailyDeviceVelocity + UtilizationRatio",
    "kmeans": "TransactionDuration / 1e2 + TransactionAmount / 1e2",
}
_SCORES = "scores AS (" + " UNION ALL ".join(
    f"SELECT TransactionID, '{d}' AS detector, round({f}, 6) AS score FROM feat"
    for d, f in _FORMULAS.items()
) + ")"
_FLAGS = """
cuts AS (SELECT detector, quantile_cont(score, 0.95) AS threshold FROM scores GROUP BY detector),
flags AS (SELECT s.*, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS flag FROM scores s JOIN cuts USING (detector))"""
_LIVE = schema.LIVE_DETECTORS
_WIDE = "wide AS (SELECT TransactionID, " + ", ".join(
    f"max(flag) FILTER (detector = '{d}') AS {d}" for d in _LIVE
) + " FROM flags GROUP BY TransactionID), votes AS (SELECT *, " + " + ".join(_LIVE) + " AS votes_for FROM wide)"


def _score_entries():
    return F.array(*[
        F.struct(F.lit(d).alias("detector"), F.round(F.expr(f), 6).alias("score"))
        for d, f in _FORMULAS.items()
    ])


def scores(spark, folder):
    """(TransactionID, detector, score) for the whole roster."""
    return features(spark, folder).select("TransactionID", F.explode(_score_entries()).alias("s")).select(
        "TransactionID", "s.*")


def flags(spark, folder):
    scored = scores(spark, folder)
    return voting.with_flags(scored, voting.thresholds(scored, schema.CONTAMINATION))


def wide(spark, folder):
    """Flag columns of the four voters, straight from the feature row."""
    limits = voting.thresholds(scores(spark, folder), schema.CONTAMINATION)
    return features(spark, folder).select("TransactionID", *[
        (F.round(F.expr(_FORMULAS[d]), 6) >= limits[d]).cast("int").alias(d) for d in _LIVE
    ])


def votes(spark, folder):
    verdict = voting.verdict(_LIVE, schema.QUORUM_SHARE).alias("v")
    return wide(spark, folder).select("TransactionID", *_LIVE, verdict).select(
        "TransactionID", *_LIVE, "v.*")


# ---- splits and samples ----------------------------------------------------

_SPLIT = """
ranked AS (SELECT TransactionID, row_number() OVER (ORDER BY md5(TransactionID || '#42'), TransactionID) AS nth, count(*) OVER () AS n FROM txn),
split AS (SELECT TransactionID, CASE WHEN nth <= round_even(n * 0.7, 0) THEN 'train'
  WHEN nth <= round_even(n * 0.7, 0) + round_even(n * 0.2, 0) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


def _split(spark, folder):
    return ranking.hash_split(
        txn(spark, folder).select("TransactionID"), "TransactionID", schema.SPLIT_FRACTIONS, schema.SEED)


@query("spl1_train_validation_test", sql(TXN, _SPLIT, "SELECT TransactionID, split FROM split"))
def train_validation_test(spark, folder):
    return _split(spark, folder)


def _labelled(spark, folder):
    return txn(spark, folder).select("TransactionID", (F.col("TransactionAmount") > 100).cast("int").alias("label"))


_LABELLED = """
lab AS (SELECT TransactionID, CAST(TransactionAmount > 100 AS INTEGER) AS label FROM txn),
ord AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(TransactionID || '#42'), TransactionID) AS nth,
  count(*) OVER (PARTITION BY label) AS nl, count(*) OVER () AS n FROM lab)"""


@query("spl2_stratified_split", sql(TXN, _LABELLED, """
s AS (SELECT label, nl, floor(nl * 0.25) AS whole FROM ord GROUP BY label, nl),
sizes AS (
  SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY nl * 0.25 - whole DESC, label)
                                  <= ceil(0.25 * sum(nl) OVER ()) - sum(whole) OVER () THEN 1 ELSE 0 END AS size FROM s)""", """
SELECT TransactionID, ord.label, nth <= size AS is_test FROM ord JOIN sizes ON ord.label = sizes.label"""))
def stratified_split(spark, folder):
    return ranking.stratified_split(_labelled(spark, folder), "TransactionID", "label", 0.25, schema.SEED)


@query("spl3_stratified_sample", sql(TXN, _LABELLED, """
SELECT TransactionID, label FROM ord WHERE nth <= CASE WHEN n <= 2000 THEN nl ELSE greatest(1, round_even(nl * 2000 / n, 0)) END"""))
def stratified_sample(spark, folder):
    return ranking.stratified_sample(_labelled(spark, folder), "TransactionID", "label", 2000, schema.SEED)


@query("spl4_uniform_sample", sql(TXN, "SELECT TransactionID FROM txn ORDER BY md5(TransactionID || '#42'), TransactionID LIMIT 260"))
def uniform_sample(spark, folder):
    return ranking.uniform_sample(
        txn(spark, folder).select("TransactionID"), "TransactionID", schema.GRAPH_NODES, schema.SEED)


# ---- thresholds and percentiles ---------------------------------------------

@query("thr1_contamination_threshold", feature_sql(_SCORES, _FLAGS, "SELECT detector, round(threshold, 6) AS threshold FROM cuts"))
def contamination_threshold(spark, folder):
    limits = voting.thresholds(scores(spark, folder), schema.CONTAMINATION)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return scores(spark, folder).select("detector").distinct().select(
        "detector", rounded(limit[F.col("detector")]).alias("threshold"))


@query("thr2_flags", feature_sql(_SCORES, _FLAGS, "SELECT TransactionID, detector, flag FROM flags"))
def threshold_flags(spark, folder):
    return flags(spark, folder).select("TransactionID", "detector", "flag")


# Scores of the first part of the month are the reference for the later ones.
_OLD_NEW = """
dated AS (SELECT s.*, t.TransactionDate < TIMESTAMP '2024-01-19 00:00:00' AS old FROM scores s JOIN txn t USING (TransactionID))"""


def _old_new(spark, folder):
    stamp = txn(spark, folder).select(
        "TransactionID",
        (F.col("TransactionDate") < F.lit("2024-01-19 00:00:00").cast("timestamp_ntz")).alias("old"))
    # One row per transaction is joined, then spread to a row per detector; written once for its readers.
    wide = features(spark, folder).select("TransactionID", _score_entries().alias("entries"))
    dated = cut_lineage(wide.join(stamp.hint("merge"), "TransactionID"))

    def part(keep):
        return dated.filter(keep).select("TransactionID", F.explode("entries").alias("s")).select(
            "TransactionID", "s.*")

    return part("old"), part("not old")


@query("thr3_score_percentile", feature_sql(_SCORES, _OLD_NEW, """
sizes AS (SELECT detector, count(*) AS n FROM dated WHERE old GROUP BY detector),
ranks AS (SELECT detector, TransactionID, old, count(*) FILTER (old) OVER (PARTITION BY detector ORDER BY score) AS n_le FROM dated)""", """
SELECT TransactionID, detector, round(100.0::DOUBLE * n_le / n, 6) AS percentile FROM ranks JOIN sizes USING (detector) WHERE NOT old"""))
def score_percentile(spark, folder):
    old, new = _old_new(spark, folder)
    reference = ranking.distribution(old, ["detector"], "score")
    total = old.groupBy("detector").agg(F.count(F.lit(1)).alias("total"))
    ranked = ranking.rank_against(new, reference, ["detector"], "score", "TransactionID")
    share = ranking.right_percentile(F.col("n_le"), F.col("total"))
    return ranked.join(F.broadcast(total), "detector").select(  # one row per detector
        "TransactionID", "detector", rounded(share).alias("percentile"))


@query("thr4_separate_live_calibration", feature_sql(_SCORES, _OLD_NEW, """
SELECT detector, round(quantile_cont(score, 0.95) FILTER (old), 6) AS training_threshold,
  round(quantile_cont(score, 0.95) FILTER (NOT old), 6) AS live_threshold FROM dated GROUP BY detector"""))
def separate_live_calibration(spark, folder):
    """Two score scales per detector, each with its own threshold."""
    old, new = _old_new(spark, folder)
    training = voting.thresholds(old, schema.CONTAMINATION)
    live = voting.thresholds(new, schema.CONTAMINATION)

    def of(limits):
        return rounded(F.create_map(*[F.lit(x) for p in limits.items() for x in p])[F.col("detector")])

    return old.select("detector").distinct().select(
        "detector", of(training).alias("training_threshold"), of(live).alias("live_threshold"))


@query("thr5_held_out_rate", feature_sql(_SCORES, _SPLIT, """
cut AS (SELECT detector, quantile_cont(score, 0.95) AS threshold FROM scores JOIN split USING (TransactionID) WHERE split = 'train' GROUP BY detector)""", """
SELECT detector, split, round(avg(CASE WHEN score >= threshold THEN 1 ELSE 0 END), 6) AS rate
FROM scores JOIN split USING (TransactionID) JOIN cut USING (detector) GROUP BY ALL"""))
def held_out_rate(spark, folder):
    parted = scores(spark, folder).join(_split(spark, folder), "TransactionID")
    limits = voting.thresholds(parted.filter("split = 'train'"), schema.CONTAMINATION)
    return voting.split_rates(voting.with_flags(parted, limits)).select(
        "detector", "split", rounded("rate").alias("rate"))


@query("thr6_row_scores", feature_sql(_SCORES, "SELECT TransactionID, detector, score FROM scores"))
def row_scores(spark, folder):
    return scores(spark, folder)


@query("det11_roster", sql(TXN, "roster(detector, ord, view_name, scaler, votes) AS (VALUES " + ", ".join(
    f"('{n}', {i}, '{v}', '{s}', {str(b).lower()})" for i, (n, v, s, b) in enumerate(schema.ROSTER)) + ")", """
SELECT detector, ord, view_name, scaler, votes, (SELECT count(*) FROM txn) AS rows_to_score FROM roster"""))
def roster(spark, folder):
    """The roster with the rows each detector has to score."""
    members = spark.createDataFrame(
        [(n, i, v, s, b) for i, (n, v, s, b) in enumerate(schema.ROSTER)],
        "detector string, ord int, view_name string, scaler string, votes boolean")
    size = txn(spark, folder).agg(F.count(F.lit(1)).alias("n"))
    return members.select("*", size.select("n").scalar().alias("rows_to_score"))


@query("det12_native_labels", feature_sql(_SCORES, _FLAGS, """
SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY detector), 6) AS percent FROM (
  SELECT detector, CASE WHEN flag = 1 THEN -1 ELSE 1 END AS native_label, count(*) AS n
  FROM flags WHERE detector IN ('isolation_forest', 'lof') GROUP BY detector, flag)"""))
def native_labels(spark, folder):
    counted = flags(spark, folder).filter("detector in ('isolation_forest', 'lof')").groupBy(
        "detector", F.when(F.col("flag") == 1, -1).otherwise(1).alias("native_label")
    ).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("detector"))
    return counted.select("detector", "native_label", "n", rounded(F.col("n") * 100.0 / total).alias("percent"))


# ---- votes -------------------------------------------------------------------

@query("agg1_rate_table", feature_sql(_SCORES, _FLAGS, """
SELECT detector, round(avg(flag), 6) AS rate, CAST(sum(flag) AS BIGINT) AS flagged FROM flags GROUP BY detector"""))
def rate_table(spark, folder):
    return voting.rate_table(flags(spark, folder)).select("detector", rounded("rate").alias("rate"), "flagged")


@query("agg2_band_warnings", feature_sql(_SCORES, _FLAGS, """
rates AS (SELECT detector, avg(CASE WHEN score >= threshold * 0.9 THEN 1 ELSE 0 END) AS rate FROM scores JOIN cuts USING (detector) GROUP BY detector)""", """
SELECT detector, detector || ' flagged ' || printf('%.2f', rate * 100) || '%, outside the sane band [3%, 7%]' AS warning
FROM rates WHERE NOT rate BETWEEN 0.03 AND 0.07"""))
def rate_band_warnings(spark, folder):
    """Thresholds lowered by a tenth, which pushes some rates out of the band."""
    scored = scores(spark, folder)
    limits = {d: t * 0.9 for d, t in voting.thresholds(scored, schema.CONTAMINATION).items()}
    return voting.band_warnings(voting.rate_table(voting.with_flags(scored, limits)))


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(count_if({a} = 1 AND {b} = 1) / nullif(count_if({a} = 1 OR {b} = 1), 0), 0), 6) AS jaccard FROM wide"
    for a, b in itertools.combinations(_LIVE, 2)
)


@query("agg3_pairwise_jaccard", feature_sql(_SCORES, _FLAGS, _WIDE, _PAIRS))
def pairwise_jaccard(spark, folder):
    return voting.pairwise_jaccard(wide(spark, folder), _LIVE).select(
        "a", "b", rounded("jaccard").alias("jaccard"))


@query("agg3_jaccard_matrix", feature_sql(_SCORES, _FLAGS, _WIDE, f"pairs AS ({_PAIRS})", f"""
cells AS (SELECT * FROM pairs UNION ALL SELECT b, a, jaccard FROM pairs UNION ALL
  SELECT d, d, 1.0 FROM (VALUES {", ".join(f"('{d}')" for d in _LIVE)}) t(d))""",
  "SELECT a, " + ", ".join(f"CAST(max(jaccard) FILTER (b = '{d}') AS DOUBLE) AS {d}" for d in _LIVE) + " FROM cells GROUP BY a"))
def jaccard_matrix(spark, folder):
    matrix = voting.jaccard_matrix(wide(spark, folder), _LIVE)
    return matrix.select("a", *[rounded(d).alias(d) for d in _LIVE])


@query("pair_detectors", feature_sql(_SCORES, _FLAGS, """
roster(detector, ord) AS (VALUES """ + ", ".join(f"('{d}', {i})" for i, d in enumerate(schema.DETECTORS)) + ")", """
SELECT ra.detector AS a, rb.detector AS b, count_if(fa.flag = 1 AND fb.flag = 1) AS both_flag
FROM flags fa JOIN flags fb USING (TransactionID) JOIN roster ra ON ra.detector = fa.detector JOIN roster rb ON rb.detector = fb.detector
WHERE ra.ord < rb.ord GROUP BY ALL"""))
def pair_detectors(spark, folder):
    """All 21 roster pairs: the flags of a row side by side, not joined to themselves."""
    flagged = flags(spark, folder).filter("flag = 1").groupBy("TransactionID").agg(
        F.collect_set("detector").alias("by"))
    pairs = list(itertools.combinations(schema.DETECTORS, 2))
    counted = [([a, b], F.count_if(F.array_contains("by", a) & F.array_contains("by", b))) for a, b in pairs]
    return voting._stacked(flagged, counted, ["a", "b", "both_flag"])


@query("agg4_votes", feature_sql(_SCORES, _FLAGS, _WIDE, "SELECT TransactionID, votes_for FROM votes"))
def row_votes(spark, folder):
    return votes(spark, folder).select("TransactionID", "votes_for")


@query("agg5_quorum", feature_sql(_SCORES, _FLAGS, """
per AS (SELECT TransactionID, count(*) AS n, count_if(flag = 1) AS cast_votes FROM flags GROUP BY TransactionID),
shares(share) AS (VALUES (0.0::DOUBLE), (0.25), (0.34), (0.5), (0.75), (1.0))""", """
SELECT share, CAST(greatest(1, ceil(max(n) * share)) AS INTEGER) AS required,
  count_if(cast_votes >= greatest(1, ceil(n * share))) AS flagged FROM per, shares GROUP BY share"""))
def quorum(spark, folder):
    """All seven detectors voting, under several quorum shares."""
    size = len(schema.DETECTORS)
    per_row = flags(spark, folder).groupBy("TransactionID").agg(F.sum("flag").alias("cast_votes"))
    needed = {s: voting.votes_required(size, s) for s in (0.0, 0.25, 0.34, 0.5, 0.75, 1.0)}
    return voting._stacked(
        per_row, [([s, r], F.count_if(F.col("cast_votes") >= r)) for s, r in needed.items()],
        ["share", "required", "flagged"])


@query("agg6_verdict", feature_sql(_SCORES, _FLAGS, _WIDE, """
SELECT TransactionID, votes_for >= 2 AS is_anomaly, votes_for, CAST(4 AS INTEGER) AS votes_total,
  CAST(2 AS INTEGER) AS votes_required, 0.5::DOUBLE AS threshold FROM votes"""))
def verdicts(spark, folder):
    return votes(spark, folder).drop(*_LIVE)


@query("agg7_vote_histogram", feature_sql(_SCORES, _FLAGS, _WIDE, """
SELECT v.votes, count(votes_for) AS n FROM (VALUES (0), (1), (2), (3), (4)) v(votes) LEFT JOIN votes ON votes_for = v.votes GROUP BY v.votes"""))
def vote_histogram(spark, folder):
    return voting.vote_histogram(votes(spark, folder), len(_LIVE))


_SWEEP = """
SELECT r.required, count(votes_for) AS n FROM (VALUES (1), (2), (3), (4)) r(required) LEFT JOIN votes ON votes_for >= r.required GROUP BY r.required"""


@query("agg8_threshold_sweep", feature_sql(_SCORES, _FLAGS, _WIDE, _SWEEP))
def threshold_sweep(spark, folder):
    return voting.threshold_sweep(votes(spark, folder), len(_LIVE))


@query("agg9_ensemble_rate", feature_sql(_SCORES, _FLAGS, _WIDE, """
SELECT round(avg(CASE WHEN votes_for >= 2 THEN 1 ELSE 0 END), 6) AS rate, count_if(votes_for >= 2) AS flagged FROM votes"""))
def ensemble_rate(spark, folder):
    return votes(spark, folder).agg(
        rounded(F.avg(F.col("is_anomaly").cast("int"))).alias("rate"), F.count_if("is_anomaly").alias("flagged"))


@query("agg10_group_contrast", feature_sql(_SCORES, _FLAGS, _WIDE, "long AS (" + unpivot_sql("feat", FEATURES) + ")", """
SELECT votes_for >= 2 AS is_anomaly, feature, round(avg(value), 6) + 0.0 AS mean FROM long JOIN votes USING (TransactionID) GROUP BY ALL"""))
def group_contrast(spark, folder):
    joined = features(spark, folder).join(votes(spark, folder).select("TransactionID", "is_anomaly"), "TransactionID")
    return voting.group_means(joined, "is_anomaly", FEATURES).select(
        "is_anomaly", "feature", rounded("mean").alias("mean"))


@query("agg22_vote_shares", feature_sql(_SCORES, _FLAGS, _WIDE, f"sweep AS ({_SWEEP})", """
SELECT required, n, round(n / (SELECT count(*) FROM votes), 6) AS share, printf('%6.2f%%', n * 100.0::DOUBLE / (SELECT count(*) FROM votes)) AS text FROM sweep"""))
def vote_shares(spark, folder):
    ballots = votes(spark, folder)
    table = voting.threshold_sweep(ballots, len(_LIVE))
    return voting.with_share(table, ballots.count()).select("required", "n", rounded("share").alias("share"), "text")


# ---- exploratory tables ---------------------------------------------------------

_NUMERIC = schema.CRUCIAL_COLUMNS


@query("agg11_describe", sql(TXN, " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM txn""" for c in _NUMERIC)))
def describe(spark, folder):
    return ex.describe(txn(spark, folder), _NUMERIC).select(
        "feature", "count", *[rounded(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("agg12_missing_values", sql(TXN, " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count_if("{c}" IS NULL) AS missing, round(count_if("{c}" IS NULL) * 100.0::DOUBLE / count(*), 6) AS percent FROM txn"""
    for c in schema.RAW_COLUMNS)))
def missing_values(spark, folder):
    return ex.missing_values(txn(spark, folder), schema.RAW_COLUMNS).select(
        "feature", "missing", rounded("percent").alias("percent"))


@query("agg13_duplicate_rows", sql(TXN, """
coarse AS (SELECT AccountID, Channel, TransactionType, CAST(TransactionDate AS DATE) AS d FROM txn)""", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM coarse)) AS BIGINT) AS duplicates FROM coarse"""))
def duplicate_rows(spark, folder):
    """Repeats of (account, channel, type, day), as full rows of that view."""
    coarse = txn(spark, folder).select("AccountID", "Channel", "TransactionType", day_of(F.col("TransactionDate")).alias("d"))
    return ex.duplicate_rows(coarse)


@query("agg14_skew_kurtosis", sql(TXN, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis FROM txn" for c in _NUMERIC)))
def skew_kurtosis(spark, folder):
    return ex.shape(txn(spark, folder), _NUMERIC).select(
        "feature", rounded("skew", 4).alias("skew"), rounded("kurtosis", 4).alias("kurtosis"))


@query("agg15_value_counts", sql(TXN, """
SELECT 'Location' AS feature, Location AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM txn GROUP BY Location"""))
def value_counts(spark, folder):
    return ex.value_counts(txn(spark, folder), "Location")


def _crosstab_sql(row, column):
    shown = ", ".join(
        f"round(count_if({column} = '{x}') * 100.0::DOUBLE / count(*), 6) AS {x}" for x in schema.LEVELS[column])
    return sql(TXN, f"SELECT {row}, {shown} FROM txn GROUP BY {row}")


@query("agg16_channel_type_crosstab", _crosstab_sql("Channel", "TransactionType"))
def channel_type_crosstab(spark, folder):
    levels = schema.LEVELS["TransactionType"]
    return ex.crosstab(txn(spark, folder), "Channel", "TransactionType", levels).select(
        "Channel", *[rounded(x).alias(x) for x in levels])


@query("agg16_location_channel_crosstab", _crosstab_sql("Location", "Channel"))
def location_channel_crosstab(spark, folder):
    levels = schema.LEVELS["Channel"]
    return ex.crosstab(txn(spark, folder), "Location", "Channel", levels).select(
        "Location", *[rounded(x).alias(x) for x in levels])


@query("agg17_devices_per_account", sql(TXN, """
per AS (SELECT AccountID, count(DISTINCT DeviceID) AS distinct_values FROM txn GROUP BY AccountID)""", """
SELECT distinct_values, count(*) AS keys FROM per GROUP BY distinct_values"""))
def devices_per_account(spark, folder):
    return ex.distinct_per_key_histogram(txn(spark, folder), "AccountID", "DeviceID")


_DAILY = "SELECT CAST(CAST(TransactionDate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM txn GROUP BY ALL"


@query("agg18_daily_counts", sql(TXN, _DAILY))
def daily_counts(spark, folder):
    return ex.daily_counts(txn(spark, folder), "TransactionDate").select(F.col("day").cast("string").alias("day"), "n")


@query("agg19_correlations", feature_sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS correlation FROM feat"
    for a, b in itertools.combinations(schema.NUMERIC_FEATURES, 2))))
def correlations(spark, folder):
    return ex.correlations(features(spark, folder), schema.NUMERIC_FEATURES).select(
        "a", "b", rounded("correlation").alias("correlation"))


def _box_sql(value, by):
    keys = ", ".join(by)
    return sql(TXN, f"""
q AS (SELECT {keys}, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({value} AS DOUBLE), 0.5) AS q50,
  quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q75 FROM txn GROUP BY {keys}),
f AS (SELECT t.{value} AS v, q.*, t.{value} BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM txn t JOIN q USING ({keys}))""", f"""
SELECT {keys}, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, CAST(min(v) FILTER (inside) AS DOUBLE) AS whisker_low,
  CAST(max(v) FILTER (inside) AS DOUBLE) AS whisker_high, count_if(NOT inside) AS outliers FROM f GROUP BY {keys}, f.q25, f.q50, f.q75""")


def _box(spark, folder, value, by):
    box = ex.box_statistics(txn(spark, folder), value, by)
    return box.select(*by, *[rounded(q).alias(q) for q in ("q25", "q50", "q75")],
                      *[F.col(w).cast("double").alias(w) for w in ("whisker_low", "whisker_high")], "outliers")


@query("agg20_amount_by_occupation", _box_sql("TransactionAmount", ["CustomerOccupation"]))
def amount_by_occupation(spark, folder):
    return _box(spark, folder, "TransactionAmount", ["CustomerOccupation"])


@query("agg20_duration_by_channel", _box_sql("TransactionDuration", ["Channel"]))
def duration_by_channel(spark, folder):
    return _box(spark, folder, "TransactionDuration", ["Channel"])


@query("agg20_amount_by_channel_type", _box_sql("TransactionAmount", ["Channel", "TransactionType"]))
def amount_by_channel_type(spark, folder):
    return _box(spark, folder, "TransactionAmount", ["Channel", "TransactionType"])


@query("agg21_histogram", sql(TXN, "ends AS (SELECT min(TransactionAmount) AS lo, max(TransactionAmount) AS hi FROM txn)", """
SELECT CAST(least(floor((TransactionAmount - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM txn, ends GROUP BY ALL"""))
def amount_histogram(spark, folder):
    return ex.histogram(txn(spark, folder), "TransactionAmount", 40)


@query("agg21_histogram_by_flag", feature_sql(_SCORES, _FLAGS, """
ends AS (SELECT detector, flag, min(score) AS lo, max(score) AS hi FROM flags GROUP BY ALL)""", """
SELECT detector, flag, CAST(CASE WHEN hi > lo THEN least(floor((score - lo) / (hi - lo) * 60), 59) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
FROM flags JOIN ends USING (detector, flag) GROUP BY ALL"""))
def score_histogram_by_flag(spark, folder):
    return ex.histogram(flags(spark, folder), "score", 60, ["detector", "flag"])


@query("agg23_prevalence", sql(TXN, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{x}' AS level, round(avg(CASE WHEN {c} = '{x}' THEN 1 ELSE 0 END), 6) AS prevalence FROM txn"
    for c, levels in schema.LEVELS.items() for x in levels)))
def prevalence(spark, folder):
    tables = [ex.prevalence(txn(spark, folder), c, levels) for c, levels in schema.LEVELS.items()]
    return tables[0].union(tables[1]).union(tables[2]).select(
        "feature", "level", rounded("prevalence").alias("prevalence"))


# ---- curves against labels -----------------------------------------------------------

_CURVE = """
lab AS (SELECT s.detector, s.score, CASE WHEN votes_for >= 2 THEN 1 ELSE 0 END AS label FROM scores s JOIN votes USING (TransactionID)),
grp AS (SELECT detector, score, sum(label) AS pos, sum(1 - label) AS neg FROM lab GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector) AS p, sum(neg) OVER (PARTITION BY detector) AS n
  FROM grp WINDOW w AS (PARTITION BY detector ORDER BY score DESC))"""


def _curve(spark, folder):
    label = votes(spark, folder).select("TransactionID", F.col("is_anomaly").cast("int").alias("label"))
    return metrics.curve(scores(spark, folder).join(label, "TransactionID"))


@query("agg32_roc_curve", feature_sql(_SCORES, _FLAGS, _WIDE, _CURVE, """
SELECT detector, score, round(fp / n + 1e-9, 6) AS fpr, round(tp / p + 1e-9, 6) AS tpr FROM cum"""))
def roc_curve(spark, folder):
    return metrics.roc_points(_curve(spark, folder)).select(
        "detector", "score", *[rounded(F.col(c) + 1e-9).alias(c) for c in ("fpr", "tpr")])


_LABEL_CURVE = """
lab AS (SELECT 'n_chars' AS detector, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label FROM labels l JOIN documents d USING (doc_id)
  UNION ALL SELECT 'toxic', CAST(l.toxic AS DOUBLE), l.quality FROM labels l),
grp AS (SELECT detector, score, sum(label) AS pos, sum(1 - label) AS neg FROM lab GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector) AS p, sum(neg) OVER (PARTITION BY detector) AS n
  FROM grp WINDOW w AS (PARTITION BY detector ORDER BY score DESC))"""
_AREAS = """
SELECT detector, round(sum(neg * (2 * tp - pos) / 2 / n) / max(p), 6) AS auc, round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision,
  round(max(p) / (max(p) + max(n)), 6) AS positive_rate FROM cum GROUP BY detector"""


@query("agg32_auc", feature_sql(_SCORES, _FLAGS, _WIDE, _CURVE, _AREAS))
def auc(spark, folder):
    return metrics.summary(_curve(spark, folder)).select(
        "detector", *[rounded(c).alias(c) for c in ("auc", "average_precision", "positive_rate")])


@query("agg32_auc_real_labels", sql(_LABEL_CURVE, _AREAS))
def auc_real_labels(spark, folder):
    """Text length and toxicity as scores of the quality label."""
    from txnlens.sources.tables import table

    labels = table(spark, folder, "labels")
    sized = labels.join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    both = sized.select(F.lit("n_chars").alias("detector"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label")).union(
        labels.select(F.lit("toxic"), F.col("toxic").cast("double"), "quality"))
    return metrics.summary(metrics.curve(both)).select(
        "detector", *[rounded(c).alias(c) for c in ("auc", "average_precision", "positive_rate")])


@query("agg33_pr_curve", feature_sql(_SCORES, _FLAGS, _WIDE, _CURVE, """
SELECT detector, score, round(tp / p + 1e-9, 6) AS recall, round(tp / (tp + fp) + 1e-9, 6) AS precision FROM cum"""))
def pr_curve(spark, folder):
    return metrics.pr_points(_curve(spark, folder)).select(
        "detector", "score", *[rounded(F.col(c) + 1e-9).alias(c) for c in ("recall", "precision")])


# ---- decisions and batch reports ---------------------------------------------------------

_DECISIONS = """
keyed AS (SELECT *, CASE WHEN transaction_id = '' THEN 'tx' ELSE transaction_id END || '::' || CAST(scored_at AS VARCHAR) AS decision_key FROM results),
decisions AS (SELECT decision_key, CASE right(transaction_id, 1) WHEN '1' THEN 'approve' WHEN '2' THEN 'block' ELSE 'defer' END AS verdict
  FROM keyed WHERE right(transaction_id, 1) IN ('1', '2', '3'))"""


def _keyed(spark, folder):
    key = review.decision_key(F.col("transaction_id"), F.col("scored_at").cast("string"))
    return results(spark, folder).withColumn("decision_key", key)


def _decisions(spark, folder):
    """Analyst verdicts derived from the log; one in three is not a known verdict."""
    last = F.substring("transaction_id", -1, 1)
    verdict = F.when(last == "1", "approve").when(last == "2", "block").otherwise("defer")
    return _keyed(spark, folder).filter(last.isin("1", "2", "3")).select("decision_key", verdict.alias("verdict"))


@query("dec1_results_with_decisions", sql(TXN, RESULTS, _DECISIONS, """
SELECT k.decision_key, is_anomaly, d.verdict FROM keyed k LEFT JOIN decisions d ON d.decision_key = k.decision_key AND d.verdict <> 'defer'"""))
def results_with_decisions(spark, folder):
    return review.with_decisions(_keyed(spark, folder), _decisions(spark, folder)).select(
        "decision_key", "is_anomaly", "verdict")


@query("agg24_decision_summary", sql(TXN, RESULTS, _DECISIONS, """
SELECT count(d.verdict) AS reviewed, count_if((d.verdict = 'block' AND NOT is_anomaly) OR (d.verdict = 'approve' AND is_anomaly)) AS overrides
FROM keyed k LEFT JOIN decisions d ON d.decision_key = k.decision_key AND d.verdict <> 'defer'"""))
def decision_summary(spark, folder):
    return review.decision_summary(review.with_decisions(_keyed(spark, folder), _decisions(spark, folder)))


@query("agg26_confirmed_count", sql(TXN, RESULTS, _DECISIONS, """
SELECT count(*) AS confirmed FROM keyed WHERE decision_key IN (SELECT decision_key FROM decisions WHERE verdict = 'block')"""))
def confirmed_count(spark, folder):
    confirmations = _decisions(spark, folder).select(
        "decision_key", F.when(F.col("verdict") == "block", "2024-02-01").alias("at"))
    return review.confirmed_count(_keyed(spark, folder), confirmations)


@query("srt4_stored_flagged_rows", sql(TXN, RESULTS, """
SELECT transaction_id, (SELECT count(*) FROM results WHERE is_anomaly) > 500 AS partial FROM results WHERE is_anomaly ORDER BY transaction_id LIMIT 500"""))
def stored_flagged_rows(spark, folder):
    kept, partial = review.stored_view(results(spark, folder), "transaction_id")
    return kept.select("transaction_id", F.lit(partial).alias("partial"))


# ---- windows, sorts, set operations --------------------------------------------------------

@query("win6_cume_dist", feature_sql(_SCORES, """
SELECT TransactionID, detector, round(cume_dist() OVER (PARTITION BY detector ORDER BY score) * 100, 6) AS percentile FROM scores"""))
def cume_dist(spark, folder):
    """Training rows against their own distribution: an equal join on the value."""
    scored = scores(spark, folder)
    reference = ranking.distribution(scored, ["detector"], "score")
    total = features(spark, folder).count()
    share = ranking.right_percentile(F.col("n_le"), F.lit(float(total)))
    return scored.join(reference, ["detector", "score"]).select(
        "TransactionID", "detector", rounded(share).alias("percentile"))


_LONG = "long AS (" + unpivot_sql("feat", FEATURES) + ")"


@query("win7_mid_rank_percentile", feature_sql(_LONG, """
SELECT TransactionID, feature, round(100.0::DOUBLE * (rank() OVER (PARTITION BY feature ORDER BY value) - 1
  + count(*) OVER (PARTITION BY feature ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2 / count(*) OVER (PARTITION BY feature), 6) AS percentile
FROM long"""))
def mid_rank_percentile(spark, folder):
    frame = features(spark, folder)
    long = frame.unpivot(["TransactionID"], FEATURES, "feature", "value")
    reference = ranking.distribution(long, ["feature"], "value")
    share = ranking.mid_percentile(F.col("n_lt"), F.col("n_le"), F.lit(float(frame.count())))
    return long.join(reference, ["feature", "value"]).select(
        "TransactionID", "feature", rounded(share).alias("percentile"))


@query("win4_running_max_before", sql(TXN, """
SELECT TransactionID, CAST(max(TransactionDate) OVER (PARTITION BY DeviceID ORDER BY md5(TransactionID), TransactionID
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) AS latest_before FROM txn"""))
def running_max_before(spark, folder):
    keyed = txn(spark, folder).withColumn("k", F.md5("TransactionID"))
    seen = running(keyed, ["DeviceID"], ["k", "TransactionID"], {"latest": Running("max_before", "TransactionDate")})
    return seen.select("TransactionID", F.col("latest").cast("string").alias("latest_before"))


@query("win5_running_total", sql(TXN, """
SELECT TransactionID, round(sum(TransactionAmount) OVER (PARTITION BY AccountID ORDER BY TransactionDate, TransactionID), 4) AS spent FROM txn"""))
def running_total(spark, folder):
    spent = running(txn(spark, folder), ["AccountID"], ["TransactionDate", "TransactionID"],
                    {"spent": Running("sum", "TransactionAmount")})
    return spent.select("TransactionID", rounded("spent", 4).alias("spent"))


@query("srt2_most_recent", sql(TXN, """
SELECT TransactionID, CAST(TransactionDate AS VARCHAR) AS stamp FROM (SELECT * FROM txn ORDER BY TransactionDate DESC, TransactionID DESC LIMIT 200)"""))
def most_recent(spark, folder):
    newest = txn(spark, folder).orderBy(F.desc("TransactionDate"), F.desc("TransactionID")).limit(schema.REPLAY_LIMIT)
    return newest.orderBy("TransactionDate", "TransactionID").select(
        "TransactionID", F.col("TransactionDate").cast("string").alias("stamp"))


@query("srt5_roster_order", feature_sql(_SCORES, _FLAGS, """
roster(detector, ord) AS (VALUES """ + ", ".join(f"('{d}', {i})" for i, d in enumerate(schema.DETECTORS)) + ")", """
SELECT TransactionID, string_agg(detector, '|' ORDER BY ord) AS flagged_by FROM flags JOIN roster USING (detector) WHERE flag = 1 GROUP BY TransactionID"""))
def roster_order(spark, folder):
    place = F.create_map(*[F.lit(x) for i, d in enumerate(schema.DETECTORS) for x in (d, i)])
    flagged = flags(spark, folder).filter("flag = 1").groupBy("TransactionID").agg(
        F.array_sort(F.collect_list(F.struct(place[F.col("detector")].alias("ord"), "detector"))).alias("d"))
    return flagged.select("TransactionID", F.array_join(F.transform("d", lambda x: x["detector"]), "|").alias("flagged_by"))


@query("set2_flag_set_sizes", feature_sql(_SCORES, _FLAGS, _WIDE, """
SELECT 'intersection' AS what, count(*) AS n FROM (SELECT TransactionID FROM wide WHERE isolation_forest = 1 INTERSECT SELECT TransactionID FROM wide WHERE dbscan = 1)
UNION ALL SELECT 'union', count(*) FROM (SELECT TransactionID FROM wide WHERE isolation_forest = 1 UNION SELECT TransactionID FROM wide WHERE dbscan = 1)"""))
def flag_set_sizes(spark, folder):
    flagged = wide(spark, folder)
    a = flagged.filter("isolation_forest = 1").select("TransactionID")
    b = flagged.filter("dbscan = 1").select("TransactionID")

    def size(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    return size(a.intersect(b), "intersection").union(size(a.union(b).distinct(), "union"))


@query("set3_exhaustive_partition", sql(TXN, """
SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added, count(*) AS kept FROM txn"""))
def exhaustive_partition(spark, folder):
    """The three splits together are the table, row for row."""
    split = _split(spark, folder)
    parts = [split.filter(F.col("split") == p).select("TransactionID") for p in schema.SPLIT_FRACTIONS]
    whole = txn(spark, folder).select("TransactionID")
    joined = parts[0].unionAll(parts[1]).unionAll(parts[2])

    def size(df):
        return df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()

    return joined.agg(F.count(F.lit(1)).alias("kept")).select(
        size(whole.exceptAll(joined)).alias("lost"), size(joined.exceptAll(whole)).alias("added"), "kept")
