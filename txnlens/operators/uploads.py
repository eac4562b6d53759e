"""Uploaded rows: parsed, filled, judged one by one, each rejection with its reason."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens import schema
from txnlens.functions.text import (
    has_space, is_null_token, parse_number, quoted, short_number, strip, to_naive_timestamp,
    to_number,
)
from txnlens.operators.headers import Header
from txnlens.operators.quantiles import quantiles


@dataclass(frozen=True)
class Check:
    """One reason to refuse a row: when it applies and how it reads.

    The text is `before`, then `shown` (quoted text or a short number), then `after`.
    """

    condition: Column
    code: str
    field: str
    before: str
    shown: Column | None = None
    style: str = "text"
    after: str = ""


def first_failure(checks: list[Check]) -> Column:
    """The number, from 1, of the first check that applies; null when none does."""
    found = F.when(checks[0].condition, 1)
    for i, check in enumerate(checks[1:], 2):
        found = found.when(check.condition, i)
    return found


def describe(checks: list[Check], number: Column) -> Column:
    """The (code, field, reason) of a check number; null for null."""

    def text_of(attribute):
        return F.element_at(F.array(*[F.lit(getattr(c, attribute)) for c in checks]), number)

    def subject(style):
        chosen = F.lit(None)
        for i, check in enumerate(checks, 1):
            if check.shown is not None and check.style == style:
                chosen = F.when(number == i, check.shown).otherwise(chosen)
        return chosen

    shown = F.coalesce(
        quoted(subject("text").cast("string")),
        short_number(subject("number").cast("double")),
        subject("count").cast("string"),
        F.lit(""),
    )
    reason = F.concat(text_of("before"), shown, text_of("after"))
    return F.when(number.isNotNull(), F.struct(
        text_of("code").alias("code"), text_of("field").alias("field"), reason.alias("reason")))


def width_check(found: Column, expected: int) -> Check:
    return Check(
        found != expected, "width", "", f"expected {expected} columns, found ", found, "count"
    )


def parse_checks(columns: list[str]) -> list[Check]:
    """Empty cells and unreadable numbers, column by column."""
    found = []
    for c in columns:
        cell = F.col(c)
        found.append(Check(is_null_token(cell), "empty", c, f"{c} is empty"))
        if c in schema.CRUCIAL_COLUMNS:
            unread = to_number(cell).isNull()
            found.append(Check(unread, "number", c, f"{c} is not a number: ", strip(cell)))
    return found


def _staged_parse_checks(columns: list[str]) -> list[Check]:
    """The same checks over cells already stripped and parsed once."""
    found = []
    for c in columns:
        empty = F.col(f"_t_{c}").isNull() | F.lower(f"_t_{c}").isin(schema.NULL_TOKENS)
        found.append(Check(empty, "empty", c, f"{c} is empty"))
        if c in schema.CRUCIAL_COLUMNS:
            found.append(Check(
                F.col(c).isNull(), "number", c, f"{c} is not a number: ", F.col(f"_t_{c}")))
    return found


def bound_checks() -> list[Check]:
    """Values no transaction can have."""
    found = [
        Check(F.col(c) <= 0, "bounds", c, f"{c} must be positive, got ", F.col(c), "number")
        for c in ("TransactionAmount", "AccountBalance")
    ]
    for c, (low, high), unit in (
        ("CustomerAge", schema.AGE_RANGE, ""),
        ("TransactionDuration", schema.DURATION_RANGE, " seconds"),
        ("LoginAttempts", schema.LOGIN_RANGE, ""),
    ):
        outside = ~F.col(c).between(low, high)
        found.append(Check(
            outside, "bounds", c, f"{c} ", F.col(c), "number", f" is outside {low}-{high}{unit}"))
    return found


def level_checks() -> list[Check]:
    return [
        Check(~F.col(c).isin(levels), "level", c, f"{c} ", F.col(c),
              after=f" is not one of {', '.join(levels)}")
        for c, levels in schema.LEVELS.items()
    ]


def identifier_checks() -> list[Check]:
    found = []
    for c in ("TransactionID", "AccountID", "DeviceID"):
        least = schema.TRANSACTION_ID_MIN if c == "TransactionID" else schema.IDENTIFIER_MIN
        most = schema.IDENTIFIER_MAX
        value, size = F.col(c), F.length(c)
        found += [
            Check(strip(value) == "", "identifier", c, f"{c} is empty"),
            Check(has_space(value), "identifier", c, f"{c} contains whitespace: ", value),
            Check(size < least, "identifier", c, f"{c} is too short at ", size, "count",
                  f" characters (minimum {least})"),
            Check(size > most, "identifier", c, f"{c} is too long at ", size, "count",
                  f" characters (maximum {most})"),
        ]
    return found


def training_defaults(txn: DataFrame) -> dict:
    """Fill values of the training table: medians, commonest levels, commonest city."""
    numbers = quantiles(txn, schema.CRUCIAL_COLUMNS, [0.5])
    counts = txn.agg(*[
        F.count_if(F.col(c) == level).alias(f"{c}_{level}")
        for c, levels in schema.LEVELS.items() for level in levels
    ]).first()
    city = txn.groupBy("Location").count().orderBy(F.desc("count"), "Location").first()
    filled = {c: q[0] for c, q in numbers.items()}
    for c, levels in schema.LEVELS.items():
        filled[c] = max(levels, key=lambda level: counts[f"{c}_{level}"])
    filled["Location"] = city["Location"] if city else ""
    return filled


def judge_rows(
    cells: DataFrame,
    header: Header,
    defaults: dict | None = None,
    now: Column | None = None,
    scope: list[str] = (),
) -> DataFrame:
    """Parsed payload of every row, with `rejection` null where it is accepted.

    `cells` holds `line`, the scope columns, one text column per header name and,
    when rows may be short or long, `cells_found`. Identifiers repeated within a
    scope are rejected after their first accepted row; a date that cannot be read
    is refused after that, so it still uses up its identifier.
    """
    scope = list(scope)
    checks = _staged_parse_checks(header.supplied)
    if "cells_found" in cells.columns:
        checks.insert(0, width_check(F.col("cells_found"), len(header.columns)))
    checks += [*bound_checks(), *level_checks(), *identifier_checks()]
    identifier, stamp = F.col("TransactionID"), F.col("_stamp")
    late = [
        Check(F.col("line") > F.col("_first"), "duplicate", "TransactionID",
              "duplicate TransactionID ", identifier),
        Check(stamp.isNull(), "date", "TransactionDate", "TransactionDate is not a timestamp: ",
              F.col("TransactionDate")),
    ]
    passed = len(checks)

    # Each step reads the one before it, so a cell is stripped and parsed once.
    stripped = cells.select(
        "line", *scope, *[c for c in ["cells_found", schema.LABEL_COLUMN] if c in cells.columns],
        *[strip(F.col(c)).alias(f"_t_{c}") for c in header.supplied],
    )
    checked = stripped.select(
        "line", *scope, *[c for c in stripped.columns if c == "cells_found" or c.startswith("_t_")],
        *_payload(stripped, header, defaults, now),
    ).withColumn("_check", first_failure(checks))

    key = [*scope, "TransactionID"]
    firsts = checked.filter("_check is null").groupBy(*key).agg(F.min("line").alias("_first"))
    joined = checked.join(firsts, key, "left").withColumn(
        "_stamp", to_naive_timestamp(F.col("TransactionDate"))
    )
    judged = joined.withColumn("_check", F.coalesce("_check", first_failure(late) + passed))
    return judged.select(
        "line", *scope, schema.LABEL_COLUMN,
        *[stamp.alias(c) if c == "TransactionDate" else F.col(c) for c in schema.SCORED_FIELDS],
        F.array(*_fill_notes(header, defaults)).cast("array<string>").alias("warnings"),
        describe([*checks, *late], F.col("_check")).alias("rejection"),
    )


def _payload(cells, header, defaults, now):
    columns = []
    for c in schema.SCORED_FIELDS:
        text = F.col(f"_t_{c}")
        if c in header.columns:
            value = text
            if c in schema.CRUCIAL_COLUMNS:
                value = parse_number(text) * F.lit(header.scales.get(c, 1.0))
        elif c == "TransactionDate":
            value = (F.current_timestamp() if now is None else now).cast("string")
        elif c in schema.IDENTITY_COLUMNS:
            value = F.concat(F.lit(f"CSV-{c[0]}"), F.col("line").cast("string"))
        else:
            value = F.lit(defaults[c])
        columns.append(value.alias(c))
    row_name = F.concat(F.lit("row-"), F.col("line").cast("string"))
    label = row_name
    if schema.LABEL_COLUMN in cells.columns:
        given = F.col(schema.LABEL_COLUMN)
        label = F.when(is_null_token(given), row_name).otherwise(strip(given))
    return [*columns, label.alias(schema.LABEL_COLUMN)]


def _fill_notes(header, defaults):
    notes = list(header.notes)
    notes += [
        f"{c} missing from the file: filled with the training default ({defaults[c]!r})"
        for c in header.missing
    ]
    for c in header.absent_identity:
        if c == "TransactionDate":
            notes.append(f"{c} missing from the file: scored against the current time")
        else:
            notes.append(
                f"{c} missing from the file: this row was treated as a new one, so its "
                "history-derived features fall back to training defaults"
            )
    return [F.lit(n) for n in notes]


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("rejection is null").drop("rejection")


def rejected(judged: DataFrame) -> DataFrame:
    """(line, code, field, reason) of the refused rows; the sink sorts them."""
    return judged.filter("rejection is not null").select("line", "rejection.*")


class BadPayload(ValueError):
    """A typed payload that is refused as a whole."""


def parse_payloads(texts: DataFrame, column: str = "payload") -> DataFrame:
    """JSON transactions with a closed schema: parsed fields and a `refusal` or null."""
    fields = [f.name for f in schema.PAYLOAD_SCHEMA.fields]
    keys = F.json_object_keys(column)
    unknown = F.array_except(keys, F.array(*[F.lit(f) for f in fields]))
    absent = F.array_except(
        F.array(*[F.lit(f) for f in fields if f != schema.LABEL_COLUMN]), keys
    )
    parsed = F.from_json(column, schema.PAYLOAD_SCHEMA)
    mistyped = F.array_compact(F.array(*[
        F.when(F.array_contains(keys, f) & F.col(f"_p.{f}").isNull(), F.lit(f)) for f in fields
    ]))
    refusal = (
        F.when(keys.isNull(), "not a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))
        .when(F.size(absent) > 0, F.concat(F.lit("missing fields: "), F.array_join(absent, ", ")))
        .when(F.size(mistyped) > 0, F.concat(F.lit("mistyped fields: "), F.array_join(mistyped, ", ")))
    )
    return texts.withColumn("_p", parsed).select(*texts.columns, "_p.*", refusal.alias("refusal"))


def check_batch_size(size: int) -> int:
    """A batch request holds 1 to 500 transactions."""
    if not 1 <= size <= schema.BATCH_MAX:
        raise BadPayload(f"a batch holds 1 to {schema.BATCH_MAX} transactions, got {size}")
    return size
