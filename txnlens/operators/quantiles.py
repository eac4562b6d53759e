"""Exact interpolated quantiles without collecting a column into one task.

`percentile` keeps every distinct value of a group in one aggregation buffer. A
group that does not fit is first narrowed: the wanted ranks are bracketed, a
mergeable sketch of each bracket proposes closer ends, and the rows outside are
counted exactly, until the bracket fits the buffer. Brackets are rows of a small
table. Both ways give the same numbers; NaN counts as the largest value.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.session import cut_lineage

BUFFER_ROWS = 1_000_000
_GRID = 256
_SKETCH = 20_000


def quantile_table(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] = (),
    buffer_rows: int | None = None, rows: int | None = None,
) -> DataFrame:
    """One row per group of `by` with an array of quantiles per column.

    `rows` saves the counting pass when the size is known. Groups of any number
    and size are allowed; `buffer_rows` changes the work, never the result.
    """
    limit = BUFFER_ROWS if buffer_rows is None else buffer_rows
    by = list(by)
    if (df.count() if rows is None else rows) <= limit:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*by).agg(*[F.percentile(c, wanted).alias(c) for c in columns])
    return _narrowed(df, columns, probs, by, limit)


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], buffer_rows: int | None = None,
    rows: int | None = None,
) -> dict[str, list[float]]:
    """Quantiles of the whole frame as plain numbers."""
    row = quantile_table(df, columns, probs, buffer_rows=buffer_rows, rows=rows).first()
    return {c: [float(v) for v in row[c]] for c in columns}


def _same(names, prefix):
    """Null-safe equality of the columns and of their prefixed copies."""
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(prefix + c))
    return match


def _prefixed(df, names, prefix):
    return df.select(*[F.col(c).alias(prefix + c) for c in names], *[c for c in df.columns if c not in names])


def _narrowed(df, columns, probs, by, buffer_rows):
    keys = [*by, "field"]
    entries = F.array(*[
        F.struct(F.lit(i).alias("field"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)
    ])
    values = df.select(*by, F.explode(entries).alias("v")).select(*by, "v.field", "v.x").filter("x IS NOT NULL")
    number = F.when(~F.isnan("x"), F.col("x"))
    sizes = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("m"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    sizes = cut_lineage(sizes)
    numbers = values.filter(~F.isnan("x"))

    spots = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(s).cast("long") for s in spots for f in (F.floor, F.ceil)]))
    state = cut_lineage(sizes.select(
        *keys, "m", "lo", "hi", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"),
        F.col("m").alias("inside"), F.lit(None).cast("double").alias("value")))
    state = state.withColumn("value", F.when(F.col("rank") >= F.col("m"), F.lit(float("nan"))))
    while True:
        wide = "value IS NULL AND inside > {} AND lo < hi".format(buffer_rows)
        if state.filter(wide).isEmpty():
            break
        state = cut_lineage(_closer(numbers, state.filter(wide), keys).unionByName(state.filter(f"NOT coalesce({wide}, false)")))

    # What is left of each bracket fits one buffer.
    state = state.withColumn("value", F.coalesce("value", F.when(F.col("lo") == F.col("hi"), F.col("lo"))))
    ends = [*keys, "lo", "hi"]
    left = _prefixed(state.filter("value IS NULL").select(*ends).distinct(), ends, "_")
    held = numbers.join(left, _same(keys, "_") & F.col("x").between(F.col("_lo"), F.col("_hi")))
    held = held.groupBy(*[f"_{c}" for c in ends]).agg(F.sort_array(F.collect_list("x")).alias("held"))
    known = state.join(held, _same(ends, "_"), "left").withColumn(
        "value", F.coalesce("value", F.get("held", F.col("rank") - F.col("below"))))
    table = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"))
    table = _prefixed(table, keys, "_").join(sizes, _same(keys, "_"))

    def at(spot):
        low, high = F.floor(spot), F.ceil(spot)
        a, b = F.element_at("of", low), F.element_at("of", high)
        return F.when((low == high) | (a == b), a).otherwise((high - spot) * a + (spot - low) * b)

    found = table.select(*keys, F.array(*[at(s) for s in spots]).alias("found"))
    return found.groupBy(*by).agg(*[
        F.max(F.when(F.col("field") == i, F.col("found"))).alias(c) for i, c in enumerate(columns)])


def _closer(numbers, wide, keys):
    """The open brackets with closer ends, or with the value where it lies on an end."""
    ends = [*keys, "lo", "hi"]
    brackets = _prefixed(wide.select(*ends).distinct(), ends, "_")
    x, lo, hi = F.col("x"), F.col("_lo"), F.col("_hi")
    inside = numbers.join(brackets, _same(keys, "_") & x.between(lo, hi))
    seen = inside.groupBy(*[f"_{c}" for c in ends]).agg(
        F.percentile_approx("x", [k / _GRID for k in range(_GRID + 1)], _SKETCH).alias("grid"),
        F.count_if(x == lo).alias("n_lo"), F.count_if(x == hi).alias("n_hi"),
        F.min(F.when(x > lo, x)).alias("lo_in"), F.max(F.when(x < hi, x)).alias("hi_in"))
    place = (F.col("rank") - F.col("below")) * _GRID / F.col("inside")
    low = F.get("grid", F.greatest(F.floor(place) - 1, F.lit(0)).cast("int"))
    high = F.get("grid", F.least(F.ceil(place) + 1, F.lit(_GRID)).cast("int"))
    rank = F.col("rank") - F.col("below")
    aimed = wide.join(seen, _same(ends, "_")).select(
        *wide.columns, "n_lo", "n_hi", "lo_in", "hi_in",
        F.when(rank < F.col("n_lo"), F.col("lo")).when(rank >= F.col("inside") - F.col("n_hi"), F.col("hi")).alias("met"),
        F.greatest(low, "lo_in").alias("lo2"), F.least(high, "hi_in").alias("hi2"))
    aimed = cut_lineage(aimed)
    narrow = [*ends, "lo2", "hi2"]
    asked = _prefixed(aimed.filter("met IS NULL").select(*narrow).distinct(), narrow, "_")
    counted = (
        numbers.join(asked, _same(keys, "_") & x.between(F.col("_lo"), F.col("_hi2")))
        .groupBy(*[f"_{c}" for c in narrow])
        .agg(F.count_if(x < F.col("_lo2")).alias("skipped"), F.count_if(x >= F.col("_lo2")).alias("kept"))
    )
    both = aimed.join(counted, _same(narrow, "_"), "left")
    below = F.col("below") + F.col("skipped")
    # A sketch that missed costs a pass: only the two ends are taken off.
    hit = (F.col("rank") >= below) & (F.col("rank") < below + F.col("kept"))
    open_ = F.col("met").isNull()
    return both.select(
        *keys, "m",
        F.when(open_, F.when(hit, F.col("lo2")).otherwise(F.col("lo_in"))).otherwise(F.col("lo")).alias("lo"),
        F.when(open_, F.when(hit, F.col("hi2")).otherwise(F.col("hi_in"))).otherwise(F.col("hi")).alias("hi"),
        "rank",
        F.when(open_, F.when(hit, below).otherwise(F.col("below") + F.col("n_lo"))).otherwise(F.col("below")).alias("below"),
        F.when(open_, F.when(hit, F.col("kept")).otherwise(F.col("inside") - F.col("n_lo") - F.col("n_hi")))
        .otherwise(F.col("inside")).alias("inside"),
        F.col("met").alias("value"))
