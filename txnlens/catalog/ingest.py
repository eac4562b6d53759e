"""Sources, header resolution and row validation: SRC, PRJ, FLT, SNK1-3."""

from pyspark.sql import functions as F

from txnlens import schema
from txnlens.catalog.base import TXN, UPLOAD, feature_sql, query, rounded, sql, txn, uploads
from txnlens.catalog.base import features as feature_table
from txnlens.functions.text import is_null_token, match_key, strip, to_number
from txnlens.operators import headers as hd
from txnlens.operators import uploads as up
from txnlens.session import cut_lineage, scratch_path
from txnlens.sources import results as log
from txnlens.sources import tables
from txnlens.sources.uploads import count_cells, read_upload, write_text_lines

_SHOWN = [c for c in schema.RAW_COLUMNS if c not in schema.DATE_COLUMNS]
_DATES = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in schema.DATE_COLUMNS)


@query("src1_training_load", sql(TXN, "SELECT " + ", ".join(f'"{c}"' for c in _SHOWN) + f", {_DATES} FROM txn"))
def training_load(spark, folder):
    """The table goes out as CSV and comes back through the strict reader."""
    path = scratch_path(spark, "training-csv")
    txn(spark, folder).write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    loaded = tables.read_transactions_csv(spark, path)
    return loaded.select(
        *_SHOWN, *[F.col(c).cast("string").alias(c) for c in schema.DATE_COLUMNS]
    )


_CELLS = [schema.LABEL_COLUMN, *schema.SCORED_FIELDS]


def _written_upload(spark, folder):
    """The dirty view as a file with synonyms in its header and quoted cells."""
    rows = uploads(spark, folder).withColumn(
        "Location", F.concat(F.col("Location"), F.lit(', "'), F.col("Channel"), F.lit('"'))
    )
    path = scratch_path(spark, "upload-csv")
    names = [{"Location": "City", "TransactionAmount": " Txn-Amount "}.get(c, c) for c in _CELLS]
    return write_text_lines(rows, _CELLS, "line", path, names)


_NUMBERED = """numbered AS (SELECT *, row_number() OVER (ORDER BY line) + 1 AS file_line FROM upload)"""


@query("src2_upload_csv", sql(UPLOAD, _NUMBERED, f"""
SELECT file_line AS line, CAST({len(_CELLS)} AS INTEGER) AS cells_found, {", ".join(c for c in _CELLS if c != "Location")},
  Location || ', "' || Channel || '"' AS Location FROM numbered"""))
def upload_csv(spark, folder):
    _, rows = read_upload(spark, _written_upload(spark, folder))
    return rows.select("line", "cells_found", *_CELLS)


@query("src3_line_numbers", sql(UPLOAD, _NUMBERED, "SELECT TransactionID, file_line + 98 AS line FROM numbered"))
def line_numbers(spark, folder):
    """A chunk that starts at row 100 of its file."""
    _, rows = read_upload(spark, _written_upload(spark, folder), start_row=100)
    return rows.select("TransactionID", "line")


# ---- a table of upload headers, one file per event -----------------------

_SLOTS = [
    ["TransactionAmount", "Amount", "TXN Amount", "Transaction_Value", "Worth"],
    ["AccountBalance", "Available Balance", "balance", "Acct-Balance"],
    ["CustomerAge", "Age", "Client Age", "AGE "],
    ["TransactionDuration", "Duration", "Session Length (Minutes)", "duration_mins", "Elapsed Seconds"],
    ["LoginAttempts", "Logins", "sign-in attempts"],
    ["TransactionType", "Txn Type", "Debit/Credit", "Kind"],
    ["Channel", "Access Channel", "payment_channel"],
    ["CustomerOccupation", "Occupation", "Job Title"],
    ["Location", "City", "Transaction City", "Lieu"],
    ["AccountID", "Account Number", "acct_no"],
    ["DeviceID", "Terminal ID", "Kit"],
    ["TransactionDate", "Txn Date", "When"],
    ["TransactionID", "Txn ID", "Ref"],
    ["IP Address", "MerchantID", "PreviousTransactionDate"],
    ["Amount USD", "TransactionAmount", "Notes"],
    ["Logins", "Memo"],
]


def _headers(spark, folder):
    event = F.col("event_id")
    chosen = [
        F.element_at(
            F.array(*[F.lit(v) for v in slot]),
            (F.floor(event / (i + 1)) % len(slot) + 1).cast("int"),
        )
        for i, slot in enumerate(_SLOTS)
    ]
    return tables.table(spark, folder, "events").select(
        event.alias("file_id"), F.posexplode(F.array(*chosen)).alias("pos", "header")
    )


_HEADER_ROWS = "headers AS (" + " UNION ALL ".join(
    f"SELECT event_id AS file_id, CAST({i} AS INTEGER) AS pos, "
    f"[{', '.join(repr(v) for v in slot)}][CAST(floor(event_id / {i + 1}) AS BIGINT) % {len(slot)} + 1] AS header FROM events"
    for i, slot in enumerate(_SLOTS)
) + ")"
_ALIAS_ROWS = "alias(k, target, unit) AS (VALUES " + ", ".join(
    f"('{k}', '{c}', CAST({u} AS DOUBLE))" for k, (c, u) in schema.aliases().items()
) + ")"
_CANON = ", ".join(f"'{c}'" for c in schema.CANONICAL_COLUMNS)
_RESOLVED = f"""
keyed AS (SELECT *, regexp_replace(lower(header), '[^a-z0-9]', '', 'g') AS k, header IN ({_CANON}) AS canonical FROM headers),
claimed AS (SELECT keyed.*, unit, CASE WHEN canonical THEN header ELSE target END AS t FROM keyed LEFT JOIN alias USING (k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id, t ORDER BY canonical DESC, pos) AS claim FROM claimed),
resolved AS (SELECT file_id, pos, header, k,
   NOT canonical AND t IS NOT NULL AND claim = 1 AS renamed,
   CASE WHEN NOT canonical AND t IS NOT NULL AND claim = 1 THEN t ELSE header END AS resolved,
   CASE WHEN NOT canonical AND t IS NOT NULL AND claim = 1 THEN unit ELSE 1.0::DOUBLE END AS scale FROM ranked)"""


@query("prj1_match_key", sql(_HEADER_ROWS, """
SELECT header, regexp_replace(lower(header), '[^a-z0-9]', '', 'g') AS match_key, count(*) AS uses FROM headers GROUP BY ALL"""))
def header_match_key(spark, folder):
    return _headers(spark, folder).groupBy("header", match_key(F.col("header")).alias("match_key")).agg(
        F.count(F.lit(1)).alias("uses")
    )


@query("prj2_resolved_headers", sql(_HEADER_ROWS, _ALIAS_ROWS, _RESOLVED,
                                    "SELECT file_id, pos, header, resolved, renamed FROM resolved"))
def resolved_headers(spark, folder):
    return hd.resolve_headers(_headers(spark, folder)).select(
        "file_id", "pos", "header", "resolved", "renamed"
    )


@query("prj3_unit_conversion", sql(_HEADER_ROWS, _ALIAS_ROWS, _RESOLVED, """
scales AS (SELECT file_id, max(scale) AS scale FROM resolved WHERE resolved = 'TransactionDuration' GROUP BY file_id)""", """
SELECT event_id, round((10 + (event_id * 37) % 291) * coalesce(scale, 1.0), 6) AS seconds
FROM events LEFT JOIN scales ON file_id = event_id"""))
def unit_conversion(spark, folder):
    """Durations of every file, in seconds whatever unit its header names."""
    scales = (
        hd.resolve_headers(_headers(spark, folder)).filter("resolved = 'TransactionDuration'")
        .groupBy("file_id").agg(F.max("scale").alias("scale"))
    )
    cells = tables.table(spark, folder, "events").select(
        "event_id", (10 + (F.col("event_id") * 37) % 291).cast("string").alias("cell")
    )
    seconds = to_number(F.col("cell")) * F.coalesce("scale", F.lit(1.0))
    return cells.join(scales, F.col("file_id") == F.col("event_id"), "left").select(
        "event_id", rounded(seconds).alias("seconds")
    )


@query("prj4_alias_notes", sql(_HEADER_ROWS, _ALIAS_ROWS, _RESOLVED, """
SELECT file_id, string_agg('''' || header || ''' read as ' || resolved || CASE WHEN scale = 1 THEN ''
  ELSE ', converted to the unit the model was trained on (x60)' END, '|' ORDER BY pos) AS notes
FROM resolved WHERE renamed GROUP BY file_id"""))
def alias_notes(spark, folder):
    note = F.concat(
        F.lit("'"), F.col("header"), F.lit("' read as "), F.col("resolved"),
        F.when(F.col("scale") == 1.0, "").otherwise(
            ", converted to the unit the model was trained on (x60)"),
    )
    noted = hd.resolve_headers(_headers(spark, folder)).filter("renamed")
    in_order = F.sort_array(F.collect_list(F.struct("pos", note.alias("note"))))
    return noted.groupBy("file_id").agg(
        F.array_join(F.transform(in_order, lambda x: x["note"]), "|").alias("notes")
    )


def _listed(columns, present):
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN {'' if present else 'NOT '}list_contains(seen, '{c}') THEN '{c}' END" for c in columns
    ) + ")"


_SCORING = schema.SCORED_FIELDS + [schema.LABEL_COLUMN]
_IGNORED = ", ".join(f"'{c}'" for c in schema.IGNORED_COLUMNS)
_KNOWN = ", ".join(f"'{c}'" for c in _SCORING + schema.IGNORED_COLUMNS)
_CLASSIFIED = f"""
perfile AS (SELECT file_id, list(resolved) AS seen,
  coalesce(string_agg(header || '>' || resolved, '|' ORDER BY pos) FILTER (renamed), '') AS matched,
  coalesce(string_agg(header, '|' ORDER BY pos) FILTER (NOT renamed AND header IN ({_IGNORED})), '') AS ignored,
  coalesce(string_agg(header, '|' ORDER BY pos) FILTER (NOT renamed AND header NOT IN ({_KNOWN})), '') AS unknown
  FROM resolved GROUP BY file_id),
classified AS (SELECT file_id, matched, ignored, unknown, {_listed(schema.CRUCIAL_COLUMNS, True)} AS crucial,
  {_listed(schema.REQUIRED_COLUMNS, False)} AS missing, {_listed(schema.IDENTITY_COLUMNS, False)} AS synthesised,
  {_listed(_SCORING, True)} AS supplied FROM perfile)"""


def _classified(spark, folder):
    found = hd.classify_headers(hd.resolve_headers(_headers(spark, folder)))
    lists = ["crucial", "matched", "missing", "synthesised", "supplied", "ignored", "unknown"]
    return found.select(
        "file_id", *[F.array_join(c, "|").alias(c) for c in lists], "ok", "fillable"
    )


@query("prj5_column_report", sql(_HEADER_ROWS, _ALIAS_ROWS, _RESOLVED, _CLASSIFIED, """
SELECT *, crucial <> '' AND missing = '' AS ok, crucial <> '' AND missing <> '' AS fillable FROM classified"""))
def column_report(spark, folder):
    return _classified(spark, folder)


@query("prj6_crucial_gate", sql(_HEADER_ROWS, _ALIAS_ROWS, _RESOLVED, _CLASSIFIED, """
SELECT CAST(length(crucial) - length(replace(crucial, '|', '')) + CASE WHEN crucial = '' THEN 0 ELSE 1 END AS BIGINT) AS crucial_columns,
  crucial = '' AS refused, count(*) AS files FROM classified GROUP BY ALL"""))
def crucial_gate(spark, folder):
    counted = _classified(spark, folder).select(
        F.when(F.col("crucial") == "", 0).otherwise(F.size(F.split("crucial", r"\|")))
        .cast("long").alias("crucial_columns")
    )
    return counted.groupBy("crucial_columns", (F.col("crucial_columns") == 0).alias("refused")).agg(
        F.count(F.lit(1)).alias("files")
    )


@query("prj7_completeness_gate", sql(_HEADER_ROWS, _ALIAS_ROWS, _RESOLVED, _CLASSIFIED, """
SELECT CASE WHEN missing = '' THEN '' ELSE 'the file is missing ' || replace(missing, '|', ', ') END AS refusal,
  count(*) AS files FROM classified GROUP BY ALL"""))
def completeness_gate(spark, folder):
    refusal = F.when(F.col("missing") == "", "").otherwise(
        F.concat(F.lit("the file is missing "), F.replace("missing", F.lit("|"), F.lit(", "))))
    return _classified(spark, folder).groupBy(refusal.alias("refusal")).agg(
        F.count(F.lit(1)).alias("files")
    )


_DEFAULTS_SQL = "defaults AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in schema.CRUCIAL_COLUMNS
) + ", " + ", ".join(
    "CASE " + " ".join(
        f"WHEN count_if({c} = '{level}') >= greatest({', '.join(f'count_if({c} = {o!r})' for o in levels)}) THEN '{level}'"
        for level in levels
    ) + f" END AS {c}"
    for c, levels in schema.LEVELS.items()
) + ", (SELECT Location FROM txn GROUP BY Location ORDER BY count(*) DESC, Location LIMIT 1) AS Location FROM txn)"


@query("prj8_fill_from_training", sql(TXN, UPLOAD, _DEFAULTS_SQL, """
SELECT line, d.CustomerAge AS CustomerAge, d.AccountBalance AS AccountBalance, d.Channel AS Channel, d.Location AS Location,
  'CustomerAge missing from the file: filled with the training default (' || CAST(d.CustomerAge AS VARCHAR) || ')|'
  || 'Channel missing from the file: filled with the training default (''' || d.Channel || ''')|'
  || 'Location missing from the file: filled with the training default (''' || d.Location || ''')' AS warnings
FROM upload, defaults d""".replace("d.AccountBalance AS AccountBalance, ", "")))
def fill_from_training(spark, folder):
    """Uploads without age, channel and city: filled, and every row says so."""
    cells = uploads(spark, folder).drop("CustomerAge", "Channel", "Location")
    names = [c for c in cells.columns if c not in ("line", "upload_id")]
    header = hd.Header(names).check(may_fill=True)
    judged = up.judge_rows(cells, header, up.training_defaults(txn(spark, folder)), scope=["upload_id"])
    return judged.select(
        "line", "CustomerAge", "Channel", "Location", F.array_join("warnings", "|").alias("warnings")
    )


@query("prj9_identity_synthesis", sql(UPLOAD, """
SELECT line, 'CSV-A' || line AS AccountID, 'CSV-D' || line AS DeviceID, '2024-02-01 00:00:00' AS TransactionDate,
  CAST(3 AS INTEGER) AS notes FROM upload"""))
def identity_synthesis(spark, folder):
    cells = uploads(spark, folder).drop(*schema.IDENTITY_COLUMNS)
    header = hd.Header([c for c in cells.columns if c not in ("line", "upload_id")])
    judged = up.judge_rows(cells, header, now=F.lit("2024-02-01 00:00:00"), scope=["upload_id"])
    return judged.select(
        "line", "AccountID", "DeviceID", F.col("TransactionDate").cast("string").alias("TransactionDate"),
        F.size("warnings").alias("notes"),
    )


@query("prj10_label_synthesis", sql(UPLOAD, """
SELECT line, CASE WHEN line % 9 = 4 THEN 'row-' || line ELSE TransactionID END AS TransactionID FROM upload"""))
def label_synthesis(spark, folder):
    label = F.when(F.col("line") % 9 == 4, " n/A\t").otherwise(
        F.concat(F.lit("  "), F.col("TransactionID"), F.lit("\t")))
    cells = uploads(spark, folder).withColumn("TransactionID", label)
    return up.judge_rows(cells, _full_header()).select("line", "TransactionID")


@query("prj11_view_selection", feature_sql(
    "SELECT TransactionID, " + ", ".join(f"round({c}, 6) AS {c}" for c in schema.CONTINUOUS_FEATURES) + " FROM feat"))
def view_selection(spark, folder):
    return feature_table(spark, folder).select(
        "TransactionID", *[rounded(c).alias(c) for c in schema.CONTINUOUS_FEATURES]
    )


# ---- row validation ------------------------------------------------------

def _full_header():
    return hd.Header([schema.LABEL_COLUMN, *schema.SCORED_FIELDS])


_NULLS = ", ".join(f"'{t}'" for t in schema.NULL_TOKENS)


def _rules(group):
    """(condition, code, field, reason) of one group of checks, in order."""
    if group == "parse":
        for c in schema.SCORED_FIELDS:
            yield f"lower(trim({c})) IN ({_NULLS})", "empty", c, f"'{c} is empty'"
            if c in schema.CRUCIAL_COLUMNS:
                yield (f"TRY_CAST(trim({c}) AS DOUBLE) IS NULL", "number", c,
                       f"'{c} is not a number: ''' || trim({c}) || ''''")
    if group == "bounds":
        def num(c):
            return f"TRY_CAST(trim({c}) AS DOUBLE)"
        for c in ("TransactionAmount", "AccountBalance"):
            yield f"{num(c)} <= 0", "bounds", c, f"'{c} must be positive, got ' || printf('%g', {num(c)})"
        for c, (lo, hi), unit in (("CustomerAge", schema.AGE_RANGE, ""), ("TransactionDuration", schema.DURATION_RANGE, " seconds"),
                                  ("LoginAttempts", schema.LOGIN_RANGE, "")):
            yield (f"NOT {num(c)} BETWEEN {lo} AND {hi}", "bounds", c,
                   f"'{c} ' || printf('%g', {num(c)}) || ' is outside {lo}-{hi}{unit}'")
    if group == "levels":
        for c, levels in schema.LEVELS.items():
            inside = ", ".join(f"'{x}'" for x in levels)
            yield (f"trim({c}) NOT IN ({inside})", "level", c,
                   f"'{c} ''' || trim({c}) || ''' is not one of {', '.join(levels)}'")
    if group == "ids":
        for c, least in (("TransactionID", 4), ("AccountID", 1), ("DeviceID", 1)):
            yield f"regexp_matches(trim({c}), '\\s')", "identifier", c, f"'{c} contains whitespace: ''' || trim({c}) || ''''"
            yield (f"length(trim({c})) < {least}", "identifier", c,
                   f"'{c} is too short at ' || length(trim({c})) || ' characters (minimum {least})'")
            yield (f"length(trim({c})) > 64", "identifier", c,
                   f"'{c} is too long at ' || length(trim({c})) || ' characters (maximum 64)'")


def _case(groups, part):
    index = {"code": 1, "field": 2, "reason": 3}[part]
    rules = [r for g in groups for r in _rules(g)]
    shown = (lambda r: r[index]) if part == "reason" else (lambda r: f"'{r[index]}'")
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {shown(r)}" for r in rules) + " END"


_GROUPS = ["parse", "bounds", "levels", "ids"]
_JUDGED = f"""
checked AS (SELECT *, {_case(_GROUPS, 'code')} AS code0, {_case(_GROUPS, 'field')} AS field0, {_case(_GROUPS, 'reason')} AS reason0 FROM upload),
firsts AS (SELECT upload_id, TransactionID, min(line) AS first_line FROM checked WHERE code0 IS NULL GROUP BY ALL),
judged AS (SELECT c.*, 
  CASE WHEN code0 IS NOT NULL THEN code0 WHEN line > first_line THEN 'duplicate'
       WHEN TRY_CAST(TransactionDate AS TIMESTAMP) IS NULL THEN 'date' END AS code,
  CASE WHEN code0 IS NOT NULL THEN field0 WHEN line > first_line THEN 'TransactionID'
       WHEN TRY_CAST(TransactionDate AS TIMESTAMP) IS NULL THEN 'TransactionDate' END AS field,
  CASE WHEN code0 IS NOT NULL THEN reason0 WHEN line > first_line THEN 'duplicate TransactionID ''' || c.TransactionID || ''''
       WHEN TRY_CAST(TransactionDate AS TIMESTAMP) IS NULL THEN 'TransactionDate is not a timestamp: ''' || TransactionDate || '''' END AS reason
  FROM checked c LEFT JOIN firsts f ON f.upload_id = c.upload_id AND f.TransactionID = c.TransactionID)"""


def judged(spark, folder):
    return up.judge_rows(uploads(spark, folder), _full_header(), scope=["upload_id"])


def _group_check(groups):
    return sql(UPLOAD, f"""
SELECT line, {_case(groups, 'code')} AS code, {_case(groups, 'field')} AS field, {_case(groups, 'reason')} AS reason
FROM upload WHERE {_case(groups, 'code')} IS NOT NULL""")


def _first_of(frame, checks):
    failed = frame.withColumn("_check", up.first_failure(checks)).filter("_check is not null")
    return failed.select("line", up.describe(checks, F.col("_check")).alias("r")).select("line", "r.*")


_WIDTHS = """
texts AS (SELECT doc_id AS line, source || ',"' || lang || ',' || n_chars || '"' || repeat(',x', CAST(doc_id % 4 AS INTEGER)) AS text FROM documents)"""


@query("flt1_row_width", sql(_WIDTHS, """
SELECT line, 'width' AS code, 'expected 3 columns, found ' || (line % 4 + 2) AS reason FROM texts WHERE line % 4 <> 1"""))
def row_width(spark, folder):
    """Lines of two to five cells, one of them quoted with a comma inside."""
    extra = F.repeat(F.lit(",x"), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(
        F.col("source"), F.lit(',"'), F.col("lang"), F.lit(","), F.col("n_chars").cast("string"),
        F.lit('"'), extra,
    )
    lines = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("line"), text.alias("text"))
    return _first_of(lines, [up.width_check(count_cells(F.col("text")), 3)]).select("line", "code", "reason")


@query("flt2_null_tokens", sql(UPLOAD, f"""
SELECT line, lower(trim(TransactionAmount)) IN ({_NULLS}) AS amount_null FROM upload"""))
def null_tokens(spark, folder):
    return uploads(spark, folder).select("line", is_null_token(F.col("TransactionAmount")).alias("amount_null"))


@query("flt3_empty_cells", sql(UPLOAD, _JUDGED, "SELECT line, field, reason FROM judged WHERE code = 'empty'"))
def empty_cells(spark, folder):
    return up.rejected(judged(spark, folder)).filter("code = 'empty'").select("line", "field", "reason")


@query("flt4_number_parse", sql(UPLOAD, """
SELECT line, TRY_CAST(trim(CustomerAge) AS DOUBLE) AS age, TRY_CAST(trim(TransactionAmount) AS DOUBLE) AS amount,
  CASE WHEN TRY_CAST(trim(CustomerAge) AS DOUBLE) IS NULL THEN 'CustomerAge is not a number: ''' || trim(CustomerAge) || '''' END AS reason
FROM upload"""))
def number_parse(spark, folder):
    age = F.col("CustomerAge")
    checks = up.parse_checks(["CustomerAge"])
    return uploads(spark, folder).select(
        "line", to_number(age).alias("age"), to_number(F.col("TransactionAmount")).alias("amount"),
        up.describe(checks, up.first_failure(checks))["reason"].alias("reason"),
    )


@query("flt5_bounds", sql(UPLOAD, _JUDGED, "SELECT line, field, reason FROM judged WHERE code = 'bounds'"))
def bounds(spark, folder):
    return up.rejected(judged(spark, folder)).filter("code = 'bounds'").select("line", "field", "reason")


@query("flt6_levels", _group_check(["levels"]))
def levels(spark, folder):
    return _first_of(uploads(spark, folder), up.level_checks())


@query("flt7_identifiers", _group_check(["ids"]))
def identifiers(spark, folder):
    return _first_of(uploads(spark, folder), up.identifier_checks())


@query("flt8_duplicates", sql(UPLOAD, _JUDGED, "SELECT line, upload_id, TransactionID FROM judged WHERE code = 'duplicate'"))
def duplicates(spark, folder):
    return judged(spark, folder).filter("rejection.code = 'duplicate'").select(
        "line", "upload_id", "TransactionID"
    )


@query("flt9_late_refusals", sql(UPLOAD, _JUDGED, "SELECT line, reason FROM judged WHERE code = 'date'"))
def late_refusals(spark, folder):
    return up.rejected(judged(spark, folder)).filter("code = 'date'").select("line", "reason")


@query("flt10_split", sql(UPLOAD, _JUDGED, """
SELECT line, code IS NULL AS accepted, coalesce(code, '') AS code, coalesce(field, '') AS field, coalesce(reason, '') AS reason FROM judged"""))
def split(spark, folder):
    both = cut_lineage(judged(spark, folder))  # judged once, read twice
    ok = up.accepted(both).select(
        "line", F.lit(True).alias("accepted"), *[F.lit("").alias(c) for c in ("code", "field", "reason")])
    refused = up.rejected(both).select("line", F.lit(False).alias("accepted"), "code", "field", "reason")
    return ok.union(refused)


@query("flt11_unusual_but_allowed", sql(TXN, """
SELECT 'spends more than the balance' AS what, count(*) AS n FROM txn WHERE TransactionAmount > AccountBalance
UNION ALL SELECT 'logins above one', count(*) FROM txn WHERE LoginAttempts > 1
UNION ALL SELECT 'age 81 to 120', count(*) FROM txn WHERE CustomerAge + 40 BETWEEN 81 AND 120
UNION ALL SELECT 'rejected', count(*) FROM txn WHERE TransactionAmount <= 0"""))
def unusual_but_allowed(spark, folder):
    """Odd cities, ids and ages within the limits: the bounds must let all pass."""
    odd = txn(spark, folder).select(
        "*", F.monotonically_increasing_id().alias("line"),
    ).withColumn("CustomerAge", F.least(F.col("CustomerAge") + 40, F.lit(120))).withColumn(
        "Location", F.lit("Nowhere")).withColumn("TransactionID", F.concat(F.lit("#"), "TransactionID"))
    reason = up.first_failure([*up.bound_checks(), *up.level_checks(), *up.identifier_checks()])
    passed = odd.withColumn("r", reason).agg(
        F.count_if((F.col("TransactionAmount") > F.col("AccountBalance")) & F.col("r").isNull()).alias("a"),
        F.count_if((F.col("LoginAttempts") > 1) & F.col("r").isNull()).alias("b"),
        F.count_if(F.col("CustomerAge").between(81, 120) & F.col("r").isNull()
                   & (F.col("CustomerAge") < 121)).alias("c"),
        F.count_if(F.col("r").isNotNull()).alias("d"),
    )
    return passed.selectExpr(
        "stack(4, 'spends more than the balance', a, 'logins above one', b, 'age 81 to 120', c, 'rejected', d) as (what, n)"
    )


@query("flt12_typed_payload", sql(TXN, """
SELECT TransactionID, CASE WHEN CAST(right(TransactionID, 3) AS INTEGER) % 5 = 1 THEN 'unknown fields: Colour'
  WHEN CAST(right(TransactionID, 3) AS INTEGER) % 5 = 2 THEN 'missing fields: Channel'
  WHEN CAST(right(TransactionID, 3) AS INTEGER) % 5 = 3 THEN 'mistyped fields: CustomerAge' ELSE '' END AS refusal FROM txn"""))
def typed_payload(spark, folder):
    kind = F.substring("TransactionID", -3, 3).cast("int") % 5
    t = txn(spark, folder).withColumn("TransactionDate", F.col("TransactionDate").cast("string"))
    body = F.struct(
        *[F.col(c) for c in _CELLS if c not in ("Channel", "CustomerAge")],
        F.when(kind != 2, F.col("Channel")).alias("Channel"),
        F.when(kind == 3, F.lit("old")).otherwise(F.col("CustomerAge").cast("string")).alias("CustomerAge"),
        F.when(kind == 1, F.lit("red")).alias("Colour"),
    )
    texts = t.select(F.regexp_replace(
        F.to_json(body), '"CustomerAge":"(\\d+)"', '"CustomerAge":$1').alias("payload"),
        F.col("TransactionID").alias("id"))
    return up.parse_payloads(texts).select(
        F.col("id").alias("TransactionID"), F.coalesce("refusal", F.lit("")).alias("refusal"))


# ---- result log -----------------------------------------------------------

def results(spark, folder):
    """Scored rows of the log: every transaction with a verdict on its amount."""
    return txn(spark, folder).select(
        F.col("TransactionID").alias("transaction_id"),
        (F.col("TransactionDate") + F.expr("INTERVAL 3 SECONDS")).alias("scored_at"),
        (F.col("TransactionAmount") > 100).alias("is_anomaly"),
    )


RESULTS = """
results AS (SELECT TransactionID AS transaction_id, TransactionDate + INTERVAL 3 SECONDS AS scored_at,
  TransactionAmount > 100 AS is_anomaly FROM txn)"""


@query("snk1_result_append", sql(TXN, RESULTS, "SELECT transaction_id, is_anomaly FROM results"))
def result_append(spark, folder):
    """Two batches, one of them delivered twice: every result is kept once."""
    path = scratch_path(spark, "results")
    scored = results(spark, folder)
    early = F.col("scored_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    log.append_results(scored.filter(early), path, batch_id=0)
    log.append_results(scored.filter(~early), path, batch_id=1)
    log.append_results(scored.filter(~early), path, batch_id=1)
    return log.read_results(spark, path).select("transaction_id", "is_anomaly")


@query("snk2_recent_feed", sql(TXN, RESULTS, """
SELECT transaction_id, CAST(scored_at AS VARCHAR) AS scored_at FROM results ORDER BY results.scored_at DESC, transaction_id DESC LIMIT 50"""))
def recent_feed(spark, folder):
    """The feed read from the result log, newest days first: only the partitions it needs are scanned."""
    path = scratch_path(spark, "results")
    scored = results(spark, folder)
    early = F.col("scored_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    log.append_results(scored.filter(early), path, batch_id=0)
    log.append_results(scored.filter(~early), path, batch_id=1)
    return log.recent_in_log(spark, path).select(
        "transaction_id", F.col("scored_at").cast("string").alias("scored_at"))


@query("snk3_log_count", sql(TXN, RESULTS, "SELECT count(*) AS results FROM results"))
def log_count(spark, folder):
    return log.count_results(results(spark, folder))
