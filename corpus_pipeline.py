"""From raw documents to shuffled training shards: five stages, each written and read again.

quality rules -> one of each group of near copies -> no benchmark passages -> target mix -> shards.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm import decontaminate, minhash, mixing, quality, sharding
from txnlens.llm.scratch import written


# Whole documents are long: batches of this many keep the Arrow buffers of a task small.
ARROW_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified rules of their language keep."""
    _small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    _small_batches(spark)
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item at similarity 0.8 or more."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, benchmark, column="_leaks").where(F.size("_leaks") == 0).drop("_leaks")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    aside = {c: f"_kept_{c}" for c in docs.columns if c in ("copy", "shard")}
    drawn = mixing.draw_copies(docs.withColumnsRenamed(aside))
    return drawn.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, uniformly shuffled."""
    return sharding.shard_rows(docs, shards=16)


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

# Sketches, certified cutoffs and random draws are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
