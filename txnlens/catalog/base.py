"""Query registry and the shared SQL of the check queries."""

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.operators import features as fe
from txnlens.schema import FEATURES, LEVELS
from txnlens.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the statement that checks it."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rounded(column, digits: int = 6):
    """A double rounded for comparison; negative zero becomes zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


@lru_cache(maxsize=8)
def txn(spark: SparkSession, folder: str) -> DataFrame:
    """The clean transactions, kept in memory or on disk for the session."""
    return tables.transactions(spark, folder).persist()


@lru_cache(maxsize=8)
def state(spark: SparkSession, folder: str) -> fe.FeatureState:
    return fe.feature_state(txn(spark, folder))


@lru_cache(maxsize=8)
def features(spark: SparkSession, folder: str) -> DataFrame:
    """The training matrix, kept because every detector reads it."""
    return fe.training_features(txn(spark, folder), state(spark, folder)).persist()


@lru_cache(maxsize=8)
def uploads(spark: SparkSession, folder: str) -> DataFrame:
    return tables.upload_rows(spark, folder).persist()


# ---- SQL fragments for the check queries --------------------------------

TXN = """
txn AS (
  SELECT 'TX' || lpad(CAST(e.event_id AS VARCHAR), 7, '0') AS TransactionID,
         'AC' || lpad(CAST(e.user_id AS VARCHAR), 5, '0') AS AccountID,
         e.value AS TransactionAmount,
         e.ts AS TransactionDate,
         CASE WHEN e.event_type = 'signup' THEN 'Credit' ELSE 'Debit' END AS TransactionType,
         n.n_name AS Location,
         'D' || lpad(regexp_extract(e.props, '([0-9]+)', 1), 6, '0') AS DeviceID,
         '10.0.' || CAST(e.user_id % 256 AS VARCHAR) || '.' || CAST(e.event_id % 256 AS VARCHAR) AS "IP Address",
         'M' || lpad(CAST((e.event_id * 13) % 100 AS VARCHAR), 3, '0') AS MerchantID,
         CASE WHEN e.event_type IN ('view', 'click') THEN 'Online'
              WHEN e.event_type = 'error' THEN 'ATM' ELSE 'Branch' END AS Channel,
         CAST(18 + (e.user_id * 11) % 63 AS BIGINT) AS CustomerAge,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Engineer' WHEN 'AUTOMOBILE' THEN 'Student'
              WHEN 'MACHINERY' THEN 'Retired' ELSE 'Doctor' END AS CustomerOccupation,
         CAST(10 + (e.event_id * 37) % 291 AS BIGINT) AS TransactionDuration,
         CASE WHEN e.event_id % 20 = 7
              THEN 2 + CAST(floor(e.event_id / 20) AS BIGINT) % 4
              ELSE CAST(1 AS BIGINT) END AS LoginAttempts,
         c.c_acctbal AS AccountBalance,
         TIMESTAMP '2024-11-04 08:08:08' AS PreviousTransactionDate
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
                JOIN nation n ON n.n_nationkey = c.c_nationkey
  WHERE c.c_acctbal > 0
)"""

UPLOAD = """
upload AS (
  SELECT CAST(floor(e.event_id / 5000) AS BIGINT) AS upload_id,
         e.event_id + 2 AS line,
         'TX' || lpad(CAST(CASE WHEN e.event_id % 107 = 11 THEN e.event_id - 1 ELSE e.event_id END AS VARCHAR), 7, '0') AS TransactionID,
         'AC' || lpad(CAST(e.user_id AS VARCHAR), 5, '0') AS AccountID,
         CASE WHEN e.event_id % 97 = 3 THEN ' N/A ' ELSE CAST(e.value AS VARCHAR) END AS TransactionAmount,
         CASE WHEN e.event_id % 137 = 29 THEN 'not a date' ELSE CAST(e.ts AS VARCHAR) END AS TransactionDate,
         CASE WHEN e.event_type = 'signup' THEN 'Credit' ELSE 'Debit' END AS TransactionType,
         n.n_name AS Location,
         CASE WHEN e.event_id % 127 = 19 THEN 'D 1'
              ELSE 'D' || lpad(regexp_extract(e.props, '([0-9]+)', 1), 6, '0') END AS DeviceID,
         CASE WHEN e.event_id % 103 = 7 THEN 'Kiosk'
              WHEN e.event_type IN ('view', 'click') THEN 'Online'
              WHEN e.event_type = 'error' THEN 'ATM' ELSE 'Branch' END AS Channel,
         CASE WHEN e.event_id % 101 = 5 THEN 'abc' WHEN e.event_id % 113 = 17 THEN '150'
              ELSE CAST(18 + (e.user_id * 11) % 63 AS VARCHAR) END AS CustomerAge,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Engineer' WHEN 'AUTOMOBILE' THEN 'Student'
              WHEN 'MACHINERY' THEN 'Retired' ELSE 'Doctor' END AS CustomerOccupation,
         CAST(10 + (e.event_id * 37) % 291 AS VARCHAR) AS TransactionDuration,
         CASE WHEN e.event_id % 131 = 23 THEN '101' ELSE '1' END AS LoginAttempts,
         CASE WHEN e.event_id % 109 = 13 THEN '0' ELSE CAST(c.c_acctbal AS VARCHAR) END AS AccountBalance
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
                JOIN nation n ON n.n_nationkey = c.c_nationkey
)"""

_ONE_HOT = ",\n         ".join(
    f"CASE WHEN {c} = '{level}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}_{level}"
    for c, levels in LEVELS.items() for level in levels
)

GAPS = """
gaps AS (
  SELECT *, date_diff('microsecond',
           lag(TransactionDate) OVER (PARTITION BY AccountID ORDER BY TransactionDate, TransactionID),
           TransactionDate) / 3.6e9 AS gap_hours
  FROM txn
)"""

FEATURE_TABLE = f"""
feat AS (
  SELECT TransactionID,
         CAST(TransactionAmount AS DOUBLE) AS TransactionAmount,
         CAST(CustomerAge AS DOUBLE) AS CustomerAge,
         CAST(TransactionDuration AS DOUBLE) AS TransactionDuration,
         CAST(LoginAttempts AS DOUBLE) AS LoginAttempts,
         CAST(AccountBalance AS DOUBLE) AS AccountBalance,
         CAST(coalesce(gap_hours, (SELECT quantile_cont(gap_hours, 0.5) FROM gaps)) AS DOUBLE) AS TimeSinceLastTx_Hours,
         CAST(row_number() OVER (PARTITION BY AccountID, CAST(TransactionDate AS DATE) ORDER BY TransactionDate, TransactionID) AS DOUBLE) AS DailyAccountVolume,
         TransactionAmount / AccountBalance AS UtilizationRatio,
         CAST(row_number() OVER (PARTITION BY DeviceID, CAST(TransactionDate AS DATE) ORDER BY TransactionDate, TransactionID) AS DOUBLE) AS DailyDeviceVelocity,
         CAST(count(*) OVER (PARTITION BY Location) AS DOUBLE) AS Location_Freq,
         {_ONE_HOT}
  FROM gaps
)"""


def sql(*parts: str) -> str:
    """CTE fragments followed by the final select."""
    return "WITH " + ",".join(parts[:-1]) + "\n" + parts[-1]


def feature_sql(*parts: str) -> str:
    return sql(TXN, GAPS, FEATURE_TABLE, *parts)


def unpivot_sql(source: str, columns: list[str], keep: str = "TransactionID") -> str:
    """A long (keep, feature, value) select over `source`."""
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}"
        for c in columns
    )


def scaled_sql(kind: str, columns: list[str] = FEATURES, source: str = "feat") -> str:
    """CTEs giving `scaled`: the feature table through one scaler."""
    if kind == "robust":
        stats = ", ".join(
            f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}"
            for c in columns
        )
    else:
        stats = ", ".join(
            f"avg({c}) AS m_{c}, CASE WHEN min({c}) = max({c}) THEN 0 ELSE stddev_pop({c}) END AS s_{c}"
            for c in columns
        )
    scaled = ", ".join(
        f"({c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END) AS {c}" for c in columns
    )
    return (
        f"scaler AS (SELECT {stats} FROM {source}), "
        f"scaled AS (SELECT TransactionID, {scaled} FROM {source}, scaler)"
    )
