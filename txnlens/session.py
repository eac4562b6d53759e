"""Session helpers: lineage cuts, shared scratch space, bounded lookups."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "txnlens", **conf) -> SparkSession:
    """A session with the settings the operators rely on."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="txnlens-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_lookup(dim: DataFrame, cap: int = 20_000) -> DataFrame:
    """Broadcast `dim` when it is measured to hold at most `cap` rows.

    A larger lookup is returned as it is, and the join shuffles on its key,
    where adaptive execution splits hot keys.
    """
    rows = dim.limit(cap + 1).collect()
    if len(rows) > cap:
        return dim
    return F.broadcast(dim.sparkSession.createDataFrame(rows, dim.schema))


def scalar(one_row: DataFrame, column: str):
    """A column of a one-row frame as a scalar subquery."""
    return one_row.select(column).scalar()
