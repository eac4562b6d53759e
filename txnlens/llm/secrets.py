"""Secret scans over a blob ledger: a text is addressed by its content and scanned once per rule version."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,end:int>>"
_RUN = 256
LEDGER_SCHEMA = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates, leftmost and not overlapping; `holds`, on a candidate, keeps or drops it."""

    name: str
    pattern: str
    holds: str
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_ASSIGN_HEAD = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?"
)

# The first three are fixed by contract; the rest are this library's own. Their order breaks ties of start.
RULES = (
    Rule("assign", _ASSIGN_HEAD + "([A-Za-z0-9+/_.=-]+)", "^" + _ASSIGN_HEAD + "([A-Za-z0-9+/_.=-]{6,})$"),
    Rule("access", "AKIA[A-Z0-9]+", "^.{20,}$"),
    Rule("hex", "[0-9a-f]+", "^.{24,}$"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "^."),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "^.{30,}$"),
)
BASE = ("assign", "access", "hex")


def blob_id(text: Column) -> Column:
    """The SHA-256 of the text; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans (start, end) in code points of the candidates that hold."""
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), 1)
    gaps = F.split(text, rule.pattern, -1)
    pieces = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda hit, gap: F.struct(
        F.length(gap).alias("gap"), F.length(hit).alias("hit"), hit.rlike(rule.holds).alias("holds")))
    # Offsets add up inside runs of pieces, then over the runs, so that the work stays near linear.
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _RUN).cast("int")),
        lambda c: F.aggregate(F.slice(pieces, c * _RUN + 1, F.lit(_RUN)), _start("spans", _SPANS), _advance))
    offsets = F.aggregate(
        runs, _start("spans", "array<int>"),
        lambda done, run: F.struct((done["at"] + run["at"]).alias("at"),
                                   F.concat(done["spans"], F.array(done["at"])).alias("spans")),
        lambda done: done["spans"])
    counted = F.flatten(F.zip_with(runs, offsets, lambda run, at: F.transform(run["spans"], lambda s: F.struct(
        (s["start"] + at).alias("start"), (s["end"] + at).alias("end")))))
    # Most texts have no candidate that holds: one pass of the strict form decides.
    return F.when(text.rlike(_strict(rule)), counted).otherwise(F.array().cast(_SPANS))


def _start(name: str, kind: str) -> Column:
    return F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias(name))


def _advance(done: Column, piece: Column) -> Column:
    begin = (done["at"] + piece["gap"]).cast("int")
    end = (begin + piece["hit"]).cast("int")
    span = F.struct(begin.alias("start"), end.alias("end"))
    return F.struct(
        end.alias("at"),
        F.when(piece["holds"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))


def _strict(rule: Rule) -> str:
    """A pattern that occurs in every text where a candidate holds."""
    return {"assign": _ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]{6}", "access": "AKIA[A-Z0-9]{16}",
            "hex": "[0-9a-f]{24}"}.get(rule.name, rule.pattern)


def scan_blobs(texts: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, results): one row per distinct text with a (rule, version, spans) for every current rule.

    `texts` has blob and text. With a `ledger` (see `ledger_rows`) only the pairs of blob and rule
    version that it lacks are scanned, the others are read from it. `fresh` says how many were scanned.
    """
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        known = F.lit(None).cast("map<string,array<struct<start:int,end:int>>>")
        blobs = blobs.withColumn("known", known)
    else:
        wanted = [r.key for r in rules]
        seen = (
            ledger.withColumn("key", F.concat_ws("@", "rule", "version")).where(F.col("key").isin(wanted))
            .groupBy("blob").agg(F.map_from_entries(F.collect_set(F.struct("key", "spans"))).alias("known"))
        )
        blobs = blobs.join(seen, "blob", "left")
    results = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
            F.when(_lacks(r), spans_of(F.col("text"), r)).otherwise(F.try_element_at("known", F.lit(r.key))).alias("spans"),
            _lacks(r).alias("fresh"),
        )
        for r in rules
    ])
    return blobs.select("blob", results.alias("results"))


def _lacks(rule: Rule) -> Column:
    return F.coalesce(~F.map_contains_key("known", F.lit(rule.key)), F.lit(True))


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """New ledger entries of a scan, also for blobs without findings."""
    return scanned.select("blob", F.explode("results").alias("r")).where("r.fresh").select(
        "blob", "r.rule", "r.version", "r.spans")


def scan_paths(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` without text, with findings: array of (start, rank, rule, end), in order of start and rule.

    A document (path) gets the findings of its blob, so copies are scanned once. Null and empty texts
    have none. Rows are kept as they are, repeated ones too, with all their other columns (one named blob
    included); a findings column is replaced.
    """
    key = "blob"
    while key in docs.columns:
        key = f"_{key}"
    addressed = docs.drop("findings").withColumn(key, blob_id(F.col("text")))
    scanned = scan_blobs(addressed.select(F.col(key).alias("blob"), F.coalesce("text", F.lit("")).alias("text")),
                         ledger, rules)
    every = F.flatten(F.transform("results", lambda r: F.transform(r["spans"], lambda s: F.struct(
        s["start"].alias("start"), _rank(r["rule"], rules).alias("rank"), r["rule"].alias("rule"), s["end"].alias("end")))))
    hits = scanned.select(F.col("blob").alias(key), F.array_sort(every).alias("findings")).where(F.size("findings") > 0)
    none = F.array().cast("array<struct<start:int,rank:int,rule:string,end:int>>")
    return addressed.drop("text").join(hits, key, "left").withColumn("findings", F.coalesce("findings", none)).drop(key)


def _rank(name: Column, rules: tuple[Rule, ...]) -> Column:
    rank = F.lit(len(rules))
    for k, rule in enumerate(rules):
        rank = F.when(name == rule.name, F.lit(k)).otherwise(rank)
    return rank


def spelled(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ",")
