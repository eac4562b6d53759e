"""Quality rules with risk-controlled cutoffs.

Each rule compares one ratio of a document with a cutoff. Labelled documents choose the cutoffs: for a
stratum and a rule the cutoffs are tried from the mildest on, and one is certified while an exact
binomial test shows that it rejects at most a set share of good documents; the first failure ends the
sequence, so that the sequence as a whole errs with the probability of one test. Strata and rules share
the error probability, and the rules of a stratum share its allowed false rejections (Bonferroni both).
"""

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.words import text_slices

M = "_measures"
REPEAT_WORDS = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_stutters", "n_capitals", "n_bangs"]
# Rule -> (measure, measure it is divided by).
RATIOS = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "stutters": ("n_stutters", "n_words"),
    "capitals": ("n_capitals", "n_words"),
    "bangs": ("n_bangs", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}
CUTOFFS = (2.0, 1.5, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)
RISK = 0.02
ERROR = 0.05


def repeated_words(found: list[bytes], size: int = REPEAT_WORDS) -> int:
    """Words inside windows of `size` words that occur at least twice in the text."""
    n = len(found) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), dtype=np.int64, count=len(found))
    if len(number) == len(found):
        return 0
    # Windows are numbered exactly by pairing the numbers of their halves; `size` is a power of two.
    grams, width = ids, 1
    while width < size:
        pairs = grams[:-width] * np.int64(len(found) + 1) + grams[width:]
        _, grams, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        width *= 2
    edge = np.zeros(len(found) + 1, dtype=np.int64)
    at = np.flatnonzero(counts[grams] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()  # bytes split at ASCII white space only
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return (
        len(found),
        len(text) - blanks,
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(found),
        len(lines),
        sum(map(bytes.__eq__, found, found[1:])),
        sum(map(bytes.isupper, found)),
        text.count("!"),
    )


def _measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows = [measure_text(t) for part in text_slices(batch) for t in part]
        columns = np.array(rows, dtype=np.int64).reshape(-1, len(MEASURES)).T
        yield pa.StructArray.from_arrays([pa.array(c) for c in columns], MEASURES)


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with the measures of its whole texts as a struct `M`; null and empty texts measure 0 throughout."""
    measured = F.arrow_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))
    return docs.drop(M).withColumn(M, measured("text"))


def base_failed() -> Column:
    return (F.col(f"{M}.n_words") < 20) | (100 * F.col(f"{M}.n_repeat_words") > 30 * F.col(f"{M}.n_words"))


def ratio(rule: str) -> Column:
    part, whole = RATIOS[rule]
    return F.when(F.col(f"{M}.{whole}") > 0, F.col(f"{M}.{part}") / F.col(f"{M}.{whole}")).otherwise(F.lit(0.0))


def stratum(column: str = "lang") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def binomial_tail(rejected: int, good: int, risk: float) -> float:
    """P(X <= rejected) for X ~ Binomial(good, risk): the p-value of "more than `risk` of the good are rejected"."""
    if rejected >= good:
        return 1.0
    log_p, log_q = math.log(risk), math.log1p(-risk)
    terms = [
        math.lgamma(good + 1) - math.lgamma(k + 1) - math.lgamma(good - k + 1) + k * log_p + (good - k) * log_q
        for k in range(rejected + 1)
    ]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certify(counts: list[tuple[float, int, int]], good: int, risk: float, error: float) -> list[tuple[float, int, int]]:
    """The certified prefix of (cutoff, good rejected, bad rejected), mildest cutoff first."""
    kept = []
    for cutoff, wrong, right in counts:
        if binomial_tail(wrong, good, risk) > error:
            break
        kept.append((cutoff, wrong, right))
    return kept


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff, learned from all labelled rows of `measured` (doc_id, lang and the measures).

    A rule that no cutoff certifies, as in a stratum with few labels, is left out and rejects nothing.
    Of the certified cutoffs the one with the most bad less good rejections is taken, the mildest at
    ties. Labels without doc_id or quality are ignored; of several labels of a doc_id the worst counts.
    Documents that the base rule rejects are no evidence. One row per stratum, rule and level is collected.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.min("quality") > 0).alias("good"))
    known = measured.where(~base_failed()).join(marks, "doc_id")
    # The level of a ratio is the number of cutoffs it does not reach, from the mildest on.
    level = {r: sum((ratio(r) < c).cast("int") for c in CUTOFFS) for r in RATIOS}
    long = known.select(stratum().alias("stratum"), "good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), level[r].alias("level")) for r in RATIOS])).alias("x"))
    rows = long.groupBy("stratum", "x.rule", "x.level").agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).collect()
    tally: dict = defaultdict(lambda: np.zeros((len(CUTOFFS) + 1, 2), dtype=np.int64))
    for r in rows:
        tally[r["stratum"], r["rule"]][r["level"]] += (r["good"], r["bad"])
    strata = sorted({s for s, _ in tally})
    chosen: dict[str, dict[str, float]] = {}
    for s in strata:
        for rule in RATIOS:
            upto = np.cumsum(tally[s, rule], axis=0)
            counts = [(c, int(upto[k, 0]), int(upto[k, 1])) for k, c in enumerate(CUTOFFS)]
            passed = certify(counts, int(upto[-1, 0]), risk / len(RATIOS), error / (len(strata) * len(RATIOS)))
            best = max(passed, key=lambda x: (x[2] - x[1], x[0]), default=None)
            if best and best[2] > best[1]:
                chosen.setdefault(s, {})[rule] = best[0]
    return chosen


def verdict(cutoffs: dict[str, dict[str, float]]) -> Column:
    """True for a document that passes the base rule and the certified rules of its stratum."""
    bad = F.lit(False)
    for name, rules in sorted(cutoffs.items()):
        hit = F.lit(False)
        for rule, cutoff in rules.items():
            hit = hit | (ratio(rule) >= cutoff)
        bad = F.when(stratum() == name, hit).otherwise(bad)
    return ~base_failed() & ~bad


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that pass; all columns as they are. Measures twice, so that no text is shuffled."""
    cutoffs = calibrate(measure(docs.select("doc_id", "text", "lang")).drop("text"), labels)
    return measure(docs).where(verdict(cutoffs)).drop(M)
