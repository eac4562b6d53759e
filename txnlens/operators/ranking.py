"""Ranks, percentiles, splits and samples over whole tables."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.operators.ordered import Running, running
from txnlens.session import cut_lineage


def shuffle_key(identifier: str, seed: int) -> Column:
    """A repeatable random order: the hash of the row's id and the seed."""
    return F.md5(F.concat(F.col(identifier).cast("string"), F.lit(f"#{seed}")))


def hash_split(df: DataFrame, identifier: str, fractions: dict[str, float], seed: int) -> DataFrame:
    """Add `split`: disjoint parts of round(n * share) rows; the last takes the rest."""
    total = df.count()
    ranked = running(
        df.withColumn("_key", shuffle_key(identifier, seed)), [], ["_key", identifier],
        {"_nth": Running("count")},
    )
    names = list(fractions)
    part, upto = F.lit(names[-1]), 0
    cuts = []
    for name in names[:-1]:
        upto += round(total * fractions[name])
        cuts.append((name, upto))
    for name, cut in reversed(cuts):
        part = F.when(F.col("_nth") <= cut, name).otherwise(part)
    return ranked.withColumn("split", part).drop("_key", "_nth")


def _ranked_within(df, identifier, label, seed):
    keyed = df.withColumn("_key", shuffle_key(identifier, seed))
    return running(keyed, [label], ["_key", identifier], {"_nth": Running("count")})


def _by_label(df, label, size, exact=None):
    """label -> rows wanted, from the label counts (few labels).

    With `exact`, the wanted rows add up to ceil(exact * all rows).
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    wanted = {k: size(n, total) for k, n in counts.items()}
    if exact is not None:
        whole = {k: math.floor(w) for k, w in wanted.items()}
        up = sorted(wanted, key=lambda k: (whole[k] - wanted[k], k))[:math.ceil(exact * total) - sum(whole.values())]
        wanted = {k: w + (k in up) for k, w in whole.items()}
    return F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])


def stratified_split(df: DataFrame, identifier: str, label: str, test_share: float, seed: int) -> DataFrame:
    """Add `is_test`: the same share of every label, in hash order.

    ceil(share * rows) rows in all; the labels with the largest remainders are rounded up, the first label at ties.
    """
    sizes = _by_label(df, label, lambda n, total: n * test_share, exact=test_share)
    ranked = _ranked_within(df, identifier, label, seed)
    return ranked.withColumn("is_test", F.col("_nth") <= sizes[F.col(label)]).drop("_key", "_nth")


def stratified_sample(df: DataFrame, identifier: str, label: str, rows: int, seed: int) -> DataFrame:
    """About `rows` rows with every label kept in proportion, at least one each."""
    def size(n, total):
        return n if total <= rows else max(1, round(n * rows / total))

    sizes = _by_label(df, label, size)
    ranked = _ranked_within(df, identifier, label, seed)
    return ranked.filter(F.col("_nth") <= sizes[F.col(label)]).drop("_key", "_nth")


def uniform_sample(df: DataFrame, identifier: str, rows: int, seed: int) -> DataFrame:
    """At most `rows` rows, drawn without replacement in hash order."""
    key = shuffle_key(identifier, seed)
    return df.withColumn("_key", key).orderBy("_key", identifier).limit(rows).drop("_key")


def distribution(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values per `by` with the rows below (`n_lt`) and up to (`n_le`) each."""
    counted = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counted, by, [value], {"n_le": Running("sum", "n")})
    return ranked.withColumn("n_lt", F.col("n_le") - F.col("n"))


def rank_against(
    rows: DataFrame, reference: DataFrame, by: list[str], value: str, identifier: str
) -> DataFrame:
    """Add `n_lt` and `n_le`: reference values below, and not above, each row's value.

    The distinct values asked for and the reference are merged in value order and the
    last reference entry is carried forward, so no value meets more than its
    predecessor. Rows take part only in the last join, which splits heavy values.
    """
    entries = reference.select(
        *by, value, F.lit(0).alias("_kind"), F.col(value).alias("_at"), "n_lt", "n_le"
    )
    asked = rows.select(*by, value).distinct().withColumn("_kind", F.lit(1))
    merged = cut_lineage(asked.unionByName(entries, allowMissingColumns=True))
    carried = running(merged, by, [value, "_kind"], {
        "_found": Running("last", "_at"), "_lt": Running("last", "n_lt"),
        "_le": Running("last", "n_le"),
    })
    zero = F.lit(0).cast("long")
    found = carried.filter("_kind = 1").select(
        *[F.col(c).alias(f"_r_{c}") for c in (*by, value)],
        F.coalesce(F.when(F.col("_found") == F.col(value), F.col("_lt")).otherwise(F.col("_le")), zero)
        .alias("n_lt"),
        F.coalesce("_le", zero).alias("n_le"),
    )
    match = F.lit(True)
    for c in (*by, value):
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    # As many entries as distinct values: merged, never sent through the driver.
    return rows.join(found.hint("merge"), match).select(*rows.columns, "n_lt", "n_le")


def right_percentile(n_le: Column, total: Column) -> Column:
    return 100.0 * n_le / total


def mid_percentile(n_lt: Column, n_le: Column, total: Column) -> Column:
    """Halfway between the ranks of a tie; 50 against an empty reference."""
    return F.when(total > 0, 100.0 * (n_lt + n_le) / 2 / total).otherwise(50.0)
