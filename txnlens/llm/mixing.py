"""Mixing sources to target weights: whole blocks of documents, split among output shards by exact quotas.

Documents of a source fall into blocks by a hash, so a block is a random part of its source and block
order is a random permutation. The mix takes whole passes over a source and, of one more pass, the
blocks and documents that come first. A tree over the output shards splits the numbers of block draws:
each node gives its left half a multivariate-hypergeometric part. A shard's draws are consecutive,
hence disjoint, in the order of passes and blocks.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnlens.llm.scratch import cut_lineage
from txnlens.llm.sharding import multivariate, number_slots

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS = 1_000
MOST_BLOCKS = 65_536
MOST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    """32 hexadecimal digits for a document; only rows with equal doc_id and text share one."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             F.md5(F.coalesce(F.col("text"), F.lit("")))))


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """`sources` (source, source_size) with target: shares of all sizes by weight, none above `most` sizes.

    Sources go by code point, null last, and weigh as `weights` repeats. Sources whose share would pass
    their ceiling keep the ceiling; the rest share what is left. One row per source is sorted in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    # A source is at its ceiling exactly if all with a smaller ceiling per weight are and the level passes its own.
    by_level = Window.orderBy(F.col("level"), F.col("place"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    ranked = (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("level", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("money", F.sum("source_size").over(everything)
                    - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("money") * F.col("weight") >= most * F.col("source_size") * F.col("rest"))
    )
    open_money = F.max(F.when(~F.col("full"), F.struct(-F.col("level"), -F.col("place"), "money", "rest"))).over(everything)
    return ranked.withColumn("left", open_money).select(
        "source", "source_size",
        F.when(F.col("full"), (most * F.col("source_size")).cast("double"))
        .otherwise((F.col("left.money") * F.col("weight")) / F.col("left.rest")).alias("target"),
    )


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Block draws of every source for each shard, by halving the range of shards."""
    out, rng = [[]] * shards, np.random.default_rng(seed)
    todo = [(0, shards, list(quotas))]
    while todo:
        first, end, have = todo.pop()
        if end - first == 1:
            out[first] = have
            continue
        middle = (first + end) // 2
        left = multivariate(rng, have, sum(have) * (middle - first) // (end - first))
        todo += [(middle, end, [h - x for h, x in zip(have, left, strict=True)]), (first, middle, left)]
    return out


def allot(docs: DataFrame, shards: int = 16, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`docs` with size, source_size, target and draws: the output shard of each copy that the mix takes.

    Size is the number of words; a null text has none. A null source is a source of its own. The words
    taken from a source differ from its target by half a document at most (rows that are equal in
    doc_id and text go together). No document is drawn more than three times. Equal input gives equal
    draws. Columns of the four names are replaced. The driver holds block counts per source and shard,
    and the plan of a source is broadcast; more than MOST_SOURCES sources are refused.
    """
    docs = docs.drop("size", "source_size", "target", "draws")
    spark = docs.sparkSession
    sized = docs.withColumns({"size": n_words(F.col("text")), "_key": shuffle_key(seed)})
    slim = cut_lineage(sized.select("source", "size", "_key"))
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    if totals.count() > MOST_SOURCES:
        raise ValueError(f"a mix takes {MOST_SOURCES} sources at most; group the small ones first")
    blocks_of = F.least(F.ceil(F.col("n") / block_rows), F.lit(MOST_BLOCKS)).cast("long")
    plan = cut_lineage(
        targets(totals.drop("n")).alias("t")
        .join(totals.select(F.col("source").alias("_s"), blocks_of.alias("blocks")), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("wanted", F.col("target") - F.col("passes") * F.col("source_size"))
    )
    block = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("blocks"), 32)

    def placed(frame):
        joined = frame.join(
            F.broadcast(plan.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return joined.withColumn("_block", block)

    # Words up to each block, then up to each document of the block in which the last pass ends.
    running = Window.partitionBy("source").orderBy("_block")
    sums = (
        placed(slim).groupBy("source", "_block").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
        .withColumn("upto", F.sum("words").over(running))
    )
    last = sums.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("words") < F.col("wanted"))).select(
        F.col("source").alias("_s"), F.col("_block").alias("_b"), (F.col("upto") - F.col("words")).alias("before"), "wanted")
    inside = (
        placed(slim).drop("wanted")
        .join(F.broadcast(last), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
        .groupBy("source", "_block", "_key").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("wanted").alias("wanted"))
        .withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("_key")))
    )
    cut = (
        inside.where(F.col("upto") - F.col("size") / 2 <= F.col("wanted"))
        .groupBy("source").agg(F.max("_key").alias("cut"))
    )
    # A source whose last block holds no document below the cut still ends before that block.
    ends = plan.join(
        last.groupBy("_s").agg(F.max("_b").alias("_b")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    ends = ends.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    drawn = F.col("passes") * F.col("blocks") + F.coalesce(F.col("_b") + 1, F.lit(0))
    rows = ends.select("source", "source_size", "target", "blocks", "passes", "_b", "cut", drawn.alias("drawn")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    by_shard = split_quotas([r["drawn"] for r in rows], shards, seed)
    upto = np.cumsum(np.array(by_shard, dtype=np.int64).reshape(shards, len(rows)), axis=0)
    table = spark.createDataFrame(
        [(r["source"], r["source_size"], r["target"], r["blocks"], r["passes"], r["_b"], r["cut"],
          [int(x) for x in upto[:, k]]) for k, r in enumerate(rows)],
        f"_s {dict(docs.dtypes)['source']}, source_size long, target double, blocks long, passes long, _b long, _cut string, _upto array<long>",
    )
    dealt = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_block", block)
    once_more = (F.col("_block") < F.col("_b")) | ((F.col("_block") == F.col("_b")) & (F.col("_key") <= F.col("_cut")))
    copies = (F.col("passes") + F.coalesce(once_more, F.lit(False)).cast("long")).cast("int")
    draws = F.transform(
        F.sequence(F.lit(1), F.col("_copies")),
        lambda k: F.aggregate("_upto", F.lit(0), lambda s, end: s + ((k - 1) * F.col("blocks") + F.col("_block") >= end).cast("int")),
    )
    return dealt.withColumn("_copies", copies).select(
        *[f"`{c}`" for c in docs.columns], "size", "source_size", "target",
        F.when(F.col("_copies") > 0, draws).otherwise(F.array().cast("array<int>")).alias("draws"))


def draw_copies(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """A row per copy that the mix takes, with its output shard and the number of the copy."""
    # Columns of the same names as those of the mix are set aside and come back.
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("size", "source_size", "target", "draws")}
    drawn = allot(docs.withColumnsRenamed(aside), shards, seed)
    own = [F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns if c not in ("copy", "shard")]
    return drawn.select(*own, F.posexplode("draws").alias("copy", "shard"))


def mix(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The mix itself: the copies with shard and, in a random order inside it, slot."""
    rows = draw_copies(docs, shards, seed).withColumn("_k", shuffle_key(seed))
    most = max((r[0] for r in rows.groupBy("shard").count().select("count").collect()), default=0)
    own = [f"`{c}`" for c in docs.columns if c not in ("copy", "shard", "slot")]
    return number_slots(rows, ["_k", "copy"], most, seed).select(*own, "copy", "shard", "slot")
