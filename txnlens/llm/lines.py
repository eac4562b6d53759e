"""Line deduplication: lines found in many documents stay in one of them only.

Hashes travel, texts do not: the only exchange of whole texts is the last join, by document.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _UPPER.lower())


def _pair(column: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits of hash as two longs."""
    return [F.xxhash64(column).alias(names[0]), F.xxhash64(F.lit("second"), column).alias(names[1])]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with `text` cleaned, and n_lines and n_dropped added (columns of these names are replaced).

    A key of at least `min_chars` code points found in at least `min_docs` documents loses its lines
    except in the largest doc_id holding it. Rows that share a doc_id count as one document, rows
    without one as a single document below all others. A null or empty text is one empty line and
    becomes an empty text. Positions are kept: the lines that stay are joined again in order.
    """
    own = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    own = own.select("*", *_pair(F.col("_text"), ("_t1", "_t2")))
    lines = own.select("doc_id", "_t1", "_t2", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    # The stripped length decides before the key is built.
    lines = lines.where(F.length(F.btrim("line", F.lit(_BLANKS))) >= min_chars).select(
        "doc_id", "_t1", "_t2", "pos", *_pair(line_key(F.col("line")), ("h1", "h2")))
    # Two levels: distinct (key, document) spreads a hot key, the count is then pre-aggregated.
    held = lines.select("h1", "h2", "doc_id").distinct()
    common = (
        held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    )
    dropped = (
        lines.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "_t1", "_t2").agg(F.collect_set("pos").alias("_drop"))
    )
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("_t1").alias("_d1"), F.col("_t2").alias("_d2"), "_drop")
    both = own.join(
        dropped,
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_d1")) & (F.col("_t2") == F.col("_d2")),
        "left",
    )
    parts = F.split("_text", "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(stays, lambda p: F.get(F.col("_parts"), p)), "\n"))
    done = both.withColumn("_parts", parts).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        kept.alias("text"),
        F.size("_parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*[f"`{c}`" for c in order], "n_lines", "n_dropped")
