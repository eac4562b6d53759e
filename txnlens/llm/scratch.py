"""Intermediate tables in the shared checkpoint folder."""

import atexit

from pyspark.sql import DataFrame, SparkSession

from txnlens.session import checkpoint_dir, cut_lineage, scratch_path

__all__ = ["checkpoint_dir", "cut_lineage", "written", "drop_written"]

_MADE: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a compressed table in the shared folder; `drop_written` removes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def drop_written() -> None:
    """Remove all tables of `written`; call it when no frame that reads them is needed any more."""
    while _MADE:
        spark, path = _MADE.pop()
        if spark.sparkContext._jsc is None:
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
