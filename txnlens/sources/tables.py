"""Transaction tables: the strict training load and the views over the test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.schema import DATE_COLUMNS, RAW_COLUMNS, RAW_SCHEMA


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_transactions(df: DataFrame) -> DataFrame:
    """Require the sixteen columns, keep them in order, parse the dates strictly."""
    missing = [c for c in RAW_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    types = {f.name: f.dataType for f in RAW_SCHEMA.fields}
    return df.select([F.col(f"`{c}`").cast(types[c]).alias(c) for c in RAW_COLUMNS])


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """A training file: every column is read as text, then cast (a bad date fails the job)."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return load_transactions(raw)


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    return events.join(customer, F.col("c_custkey") == F.col("user_id")).join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    )


def _text(prefix: str, value, width: int):
    return F.concat(F.lit(prefix), F.lpad(value.cast("string"), width, "0"))


def _device():
    return _text("D", F.regexp_extract("props", "([0-9]+)", 1), 6)


def _kind():
    return F.when(F.col("event_type") == "signup", "Credit").otherwise("Debit")


def _channel():
    return (
        F.when(F.col("event_type").isin("view", "click"), "Online")
        .when(F.col("event_type") == "error", "ATM")
        .otherwise("Branch")
    )


def _occupation():
    segment = F.col("c_mktsegment")
    return (
        F.when(segment == "BUILDING", "Engineer")
        .when(segment == "AUTOMOBILE", "Student")
        .when(segment == "MACHINERY", "Retired")
        .otherwise("Doctor")
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The clean sixteen-column table over events, customer and nation."""
    event, user = F.col("event_id"), F.col("user_id")
    logins = F.when(
        event % 20 == 7, 2 + F.floor(event / 20).cast("long") % 4
    ).otherwise(F.lit(1).cast("long"))
    view = _joined(spark, folder).filter("c_acctbal > 0").select(
        _text("TX", event, 7).alias("TransactionID"),
        _text("AC", user, 5).alias("AccountID"),
        F.col("value").alias("TransactionAmount"),
        F.col("ts").alias("TransactionDate"),
        _kind().alias("TransactionType"),
        F.col("n_name").alias("Location"),
        _device().alias("DeviceID"),
        F.concat(
            F.lit("10.0."), (user % 256).cast("string"), F.lit("."), (event % 256).cast("string")
        ).alias("IP Address"),
        _text("M", (event * 13) % 100, 3).alias("MerchantID"),
        _channel().alias("Channel"),
        (18 + (user * 11) % 63).cast("long").alias("CustomerAge"),
        _occupation().alias("CustomerOccupation"),
        (10 + (event * 37) % 291).cast("long").alias("TransactionDuration"),
        logins.alias("LoginAttempts"),
        F.col("c_acctbal").alias("AccountBalance"),
        F.lit("2024-11-04 08:08:08").cast(T.TimestampNTZType()).alias("PreviousTransactionDate"),
    )
    return load_transactions(view)


def upload_rows(spark: SparkSession, folder: str, rows_per_upload: int = 5000) -> DataFrame:
    """The dirty text view: one uploaded file per `rows_per_upload` lines."""
    event = F.col("event_id")

    def defect(modulus, remainder, text, otherwise):
        return F.when(event % modulus == remainder, text).otherwise(otherwise)

    age = (18 + (F.col("user_id") * 11) % 63).cast("string")
    return _joined(spark, folder).select(
        F.floor(event / rows_per_upload).cast("long").alias("upload_id"),
        (event + 2).alias("line"),
        _text("TX", F.when(event % 107 == 11, event - 1).otherwise(event), 7).alias("TransactionID"),
        _text("AC", F.col("user_id"), 5).alias("AccountID"),
        defect(97, 3, " N/A ", F.col("value").cast("string")).alias("TransactionAmount"),
        defect(137, 29, "not a date", F.col("ts").cast("string")).alias("TransactionDate"),
        _kind().alias("TransactionType"),
        F.col("n_name").alias("Location"),
        defect(127, 19, "D 1", _device()).alias("DeviceID"),
        defect(103, 7, "Kiosk", _channel()).alias("Channel"),
        defect(101, 5, "abc", defect(113, 17, "150", age)).alias("CustomerAge"),
        _occupation().alias("CustomerOccupation"),
        (10 + (event * 37) % 291).cast("string").alias("TransactionDuration"),
        defect(131, 23, "101", F.lit("1")).alias("LoginAttempts"),
        defect(109, 13, "0", F.col("c_acctbal").cast("string")).alias("AccountBalance"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as (id, vector of doubles, label)."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        "label",
    )
