"""Sharding: a uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Every input partition permutes its rows locally and sends exact counts to every shard. The counts are
drawn as a random contingency table with the partition sizes and the shard sizes as margins, which is
how a uniform permutation of all rows would deal them. Every shard then permutes what it has received.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from txnlens.llm.scratch import written

CELL_ROWS = 250_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls are good. Exact inversion over a window of 12 deviations; sizes are unbounded."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mean = drawn * good / total
    spread = math.sqrt(max(mean * (bad / total) * (total - drawn) / max(total - 1, 1), 0.0))
    a = max(low, int(mean - 12 * spread) - 20)
    b = min(high, int(mean + 12 * spread) + 20)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], side="right").clip(0, b - a))


def multivariate(rng: np.random.Generator, colours: list[int], drawn: int) -> list[int]:
    """How many of `drawn` balls have each colour."""
    out, rest = [], sum(colours)
    for count in colours:
        rest -= count
        taken = hypergeometric(rng, count, rest, drawn)
        out.append(taken)
        drawn -= taken
    return out


def communication_matrix(partition_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard."""
    rng, room, matrix = np.random.default_rng(seed), list(shard_rows), []
    for rows in partition_rows:
        sent = multivariate(rng, room, rows)
        room = [r - s for r, s in zip(room, sent, strict=True)]
        matrix.append(sent)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _row_hash(df: DataFrame, seed: int, label: str) -> Column:
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.lit(f"{label}{seed}"), *[F.col(f"`{c}`") for c in plain])


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 11, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`df` with shard (0 .. shards-1) and slot (0, 1, .. within the shard); shard sizes differ by one at most.

    Rows are dealt one by one whatever they hold: nulls, equal texts and repeated rows need no care,
    and identical rows are interchangeable. Columns named shard or slot are replaced. An empty table
    stays empty. The driver holds one count per input partition and shard, and one per cell (of
    about `cell_rows` rows) of a shard; both are broadcast, so they take a few bytes per task.
    """
    df = df.drop("shard", "slot")
    names = [f"`{c}`" for c in df.columns]
    local = (
        df.withColumns({"_r1": _row_hash(df, seed, "local"), "_r2": _row_hash(df, seed, "tie")})
        .sortWithinPartitions("_r1", "_r2")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # Written once: the counts and the exchange must see the same partitions, also after a lost executor.
    fixed = written(local, "shards")
    partition = F.shiftright("_at", 33).cast("long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in fixed.groupBy(partition.alias("p")).count().collect()}
    order = sorted(sizes)
    room = shard_sizes(sum(sizes.values()), shards)
    matrix = communication_matrix([sizes[p] for p in order], room, seed)
    ends = [(p, [int(x) for x in np.cumsum(sent)]) for p, sent in zip(order, matrix, strict=True)]
    spark = df.sparkSession
    table = spark.createDataFrame(ends, "_p long, _ends array<long>")
    sent = fixed.join(F.broadcast(table), partition == F.col("_p")).withColumn(
        "shard", F.aggregate("_ends", F.lit(0), lambda n, end: n + (place >= end).cast("int")))
    return number_slots(sent, ["_r1", "_r2"], max(room, default=0), seed, cell_rows).select(*names, "shard", "slot")


def number_slots(df: DataFrame, keys: list[str], most_rows: int, seed: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`df` with slot: a random order, by a hash of `keys`, inside every shard of `most_rows` rows at most.

    A shard is cut into cells, consecutive ranges of the random key, and the cell sizes give the first
    slot of each; no shard is sorted in one task.
    """
    spark = df.sparkSession
    cells = max(1, math.ceil(most_rows / cell_rows))
    mixed = df.withColumn("_r3", F.xxhash64(F.lit(f"again{seed}"), *keys))
    cell = F.least(F.floor((F.col("_r3") / F.lit(2.0**64) + 0.5) * cells), F.lit(cells - 1)).cast("int")
    mixed = mixed.withColumn("_cell", cell)
    first, filled = [], {}
    for s, c, n in sorted(mixed.groupBy("shard", "_cell").count().collect()):
        first.append((s, c, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + n
    starts = spark.createDataFrame(first, "_s int, _c int, _first long")
    dealt = mixed.join(F.broadcast(starts), (F.col("shard") == F.col("_s")) & (F.col("_cell") == F.col("_c")))
    rank = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_r3", *keys))
    return dealt.withColumn("slot", F.col("_first") + rank - 1)
