"""Uploaded CSV files as numbered text rows."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlens.operators.headers import Header, read_header
from txnlens.session import bounded_lookup

FIRST_DATA_LINE = 2
_QUOTED = r'"([^"]|"")*"'
_BOM = "﻿"


def number_lines(lines: DataFrame) -> DataFrame:
    """Add `line`, counted from 1 over all files in path order.

    Rows of one file block are read in order by one task, so a row's place in
    its block comes from the increasing id; blocks are then offset by the rows
    of the blocks before them. Only block counts are shuffled.
    """
    placed = lines.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = placed.groupBy("_path", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # One row per file block: a few hundred thousand for 100 TB.
    earlier = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_path", "_start", "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    line = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return (
        placed.join(bounded_lookup(offsets), ["_path", "_start"])
        .select(*lines.columns, line.alias("line"))
    )


def count_cells(line: Column) -> Column:
    """Cells of a CSV line; commas inside quotes do not separate."""
    return F.size(F.split(F.regexp_replace(line, _QUOTED, ""), ",", -1))


def split_cells(line: Column, width: int) -> Column:
    """The cells of a line as a struct c0..c{width-1}; missing ones are null."""
    ddl = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(line, ddl, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})


def is_blank(line: Column) -> Column:
    return F.regexp_replace(line, r'(?U)[\s,"]', "") == ""


def read_upload(
    spark: SparkSession, path: str, start_row: int = FIRST_DATA_LINE, quoted_newlines: bool = False
) -> tuple[Header, DataFrame]:
    """The resolved header and the rows (line, cells_found, one column per name).

    Lines are read as text so that blank and short ones keep their number and
    large files stay splittable. Files whose quoted cells contain line breaks
    need `quoted_newlines`, which reads each file in one task.
    """
    if quoted_newlines:
        return _read_multiline(spark, path, start_row)
    lines = number_lines(spark.read.text(path))
    top = lines.filter("line = 1").first()
    last = lines.filter(~is_blank(F.col("value"))).agg(F.max("line")).first()[0]
    if top is None or last is None:
        raise ValueError("The file is empty.")
    first_line = spark.createDataFrame([(top["value"].lstrip(_BOM),)], "value string")
    width = first_line.select(count_cells(F.col("value"))).first()[0]
    names = first_line.select(split_cells(F.col("value"), width).alias("c")).first()["c"]
    header = read_header(spark, [(n or "").strip() for n in names])
    if last == 1:
        raise ValueError("The file has a header but no rows.")
    rows = lines.filter(F.col("line").between(2, last)).select(
        (F.col("line") - 2 + start_row).alias("line"),
        count_cells(F.col("value")).alias("cells_found"),
        split_cells(F.col("value"), width).alias("c"),
    )
    return header, rows.select("line", "cells_found", *_named(header, "c.c"))


def _named(header: Header, prefix: str) -> list[Column]:
    """One column per distinct name; of repeated names the last one counts."""
    position = {name: i for i, name in enumerate(header.columns)}
    return [F.col(f"{prefix}{i}").alias(name) for name, i in position.items() if name]


def _read_multiline(spark, path, start_row):
    raw = (
        spark.read.option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("header", False).csv(path)
    )
    width = len(raw.columns)
    plain = raw.toDF(*[f"c{i}" for i in range(width)])
    lines = number_lines(plain.select("*", "_metadata"))
    top = lines.filter("line = 1").first()
    if top is None:
        raise ValueError("The file is empty.")
    names = [(top[f"c{i}"] or "").lstrip(_BOM).strip() for i in range(width)]
    header = read_header(spark, names)
    rows = lines.filter("line > 1")
    if rows.isEmpty():
        raise ValueError("The file has a header but no rows.")
    return header, rows.select(
        (F.col("line") - 2 + start_row).alias("line"),
        F.lit(width).alias("cells_found"),
        *_named(header, "c"),
    )


def write_text_lines(df: DataFrame, columns: list[str], order: str, path: str, header: list[str]) -> str:
    """Write rows as CSV text files that read back in `order`."""
    def cell(c):
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        wrapped = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",]'), wrapped).otherwise(text)

    body = df.select(F.col(order).alias("_o"), F.concat_ws(",", *[cell(c) for c in columns]).alias("value"))
    top = df.sparkSession.createDataFrame([(-1, ",".join(header))], "_o long, value string")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        top.union(body).repartitionByRange(parts, "_o").sortWithinPartitions("_o")
        .select("value").write.mode("overwrite").text(path)
    )
    return path
