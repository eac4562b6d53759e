"""Running columns over ordered rows, safe for keys that hold much of the table.

A window puts every row of a key into one task. `running` does so only for keys
measured to be small. Rows of larger keys are range-partitioned on (key, order),
scanned chunk by chunk, and each chunk is completed with what the chunks before
it hold for the same key. Only the first key of a chunk can start in an earlier
one, so that carry-over table has at most one row per chunk.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.session import cut_lineage

# A group up to this many rows may be sorted inside one task.
GROUP_ROWS = 2_000_000


@dataclass(frozen=True)
class Running:
    """One running column.

    kind `count`: rows up to and including this one; `sum`: running total of
    `column`; `previous`: `column` one row before; `max_before`: its maximum over
    the rows before; `last`: its latest non-null value up to and including this row.
    """

    kind: str
    column: str | None = None


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    columns: dict[str, Running],
    group_rows: int | None = None,
) -> DataFrame:
    """Append running `columns` per `by`, in `order` (ascending, unique per key)."""
    limit = GROUP_ROWS if group_rows is None else group_rows
    total = df.count()
    if total <= limit:
        return _window(df, by, order, columns)
    if not by:
        return _chunked(df, by, order, columns, total, limit)
    # Every key above the fixed limit is hot: at most total / limit keys, kept as a table.
    hot = cut_lineage(df.groupBy(*by).count().filter(F.col("count") > limit).drop("count"))
    if hot.isEmpty():
        return _window(df, by, order, columns)
    keys = hot.toDF(*[f"_h_{c}" for c in by])
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    cold = _window(df.join(keys, match, "left_anti"), by, order, columns)
    hot_rows = df.join(keys, match, "left_semi")
    scanned = cold.unionByName(_chunked(hot_rows, by, order, columns, hot_rows.count(), limit))
    return scanned.select(*[F.col(f"`{c}`") for c in df.columns], *columns)


def _local(kind: str, column: str | None, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "count":
        return F.row_number().over(window).cast("long")
    if kind == "sum":
        return F.sum(column).over(upto)
    if kind == "previous":
        return F.lag(column).over(window)
    if kind == "max_before":
        return F.max(column).over(before)
    if kind == "last":
        return F.last(column, ignorenulls=True).over(upto)
    raise ValueError(f"unknown running kind {kind!r}")


def _window(df, by, order, columns):
    window = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[_local(r.kind, r.column, window).alias(n) for n, r in columns.items()])


def _chunked(df, by, order, columns, rows, limit):
    # Chunks of half the limit at most, however many rows there are.
    chunks = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows // max(1, limit))
    ranged = df.repartitionByRange(chunks, *by, *order)
    # The chunk number must stay the same in every later read, hence the cut.
    ranged = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))

    window = Window.partitionBy("_chunk", *by).orderBy(*order)
    local = ranged.select(
        "*",
        F.row_number().over(window).alias("_nth"),
        *[_local(r.kind, r.column, window).alias(f"_l_{n}") for n, r in columns.items()],
    )

    position = F.struct(*order)
    totals = {
        "count": lambda c: F.count(F.lit(1)),
        "sum": F.sum,
        "previous": lambda c: F.max_by(c, position),
        "max_before": F.max,
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), position)),
    }
    earlier = (
        Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = {
        "count": F.sum, "sum": F.sum, "max_before": F.max, "previous": F.last,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    per_chunk = ranged.groupBy(*by, "_chunk").agg(
        *[totals[r.kind](r.column).alias(f"_t_{n}") for n, r in columns.items()]
    )
    carry = per_chunk.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col("_chunk").alias("_k_chunk"),
        F.count(F.lit(1)).over(earlier).alias("_seen"),
        *[carried[r.kind](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, r in columns.items()],
    ).filter("_seen > 0")

    match = F.col("_chunk") == F.col("_k_chunk")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = local.join(F.broadcast(carry), match, "left")  # at most one row per chunk

    def complete(name, kind):
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("count", "sum"):
            return F.coalesce(here + before, here, before)
        if kind == "max_before":
            return F.greatest(here, before)
        if kind == "previous":
            return F.when(F.col("_nth") == 1, before).otherwise(here)
        return F.coalesce(here, before)

    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[complete(n, r.kind).alias(n) for n, r in columns.items()],
    )
