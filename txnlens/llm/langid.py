"""Language identification: known words by log frequency, unknown ones by ever shorter character n-grams.

The model is fitted on a bounded sample of the labelled documents of every language and holds a bounded number
of words and n-grams, the most frequent of each language, so it can be sent to every task. A word of the model scores its log frequency in each language.
Any other word is read from the left: at each position the longest n-gram of the model is scored, from
MAX_GRAM characters down to one, discounted by BACKOFF for every step down.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.words import LETTERS

# Different texts of each language that are learned from, and entries of the model over all languages.
FIT_DOCS = 20_000
MODEL_WORDS = 100_000
MODEL_GRAMS = 100_000
MAX_GRAM = 5
BACKOFF = math.log(0.4)
_SMOOTH = 0.1
_CACHE_WORDS = 300_000
UNKNOWN = "und"


def _letters(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams(word: str) -> list[str]:
    """All n-grams of a word with its edges marked by blanks, one to MAX_GRAM characters."""
    marked = f" {word} "
    return [marked[i:i + n] for n in range(1, MAX_GRAM + 1) for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies, one column per language; unseen (word, language) pairs are smoothed."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def unseen(self, words: list[str]) -> np.ndarray:
        """The scores of words outside the model, one row each: the mean over the positions of the word."""
        get, ids, drops, sizes = self.grams.get, [], [], []
        for word in words:
            marked = f" {word} "
            end, before = len(marked), len(ids)
            for i in range(end - 1):
                for n in range(min(MAX_GRAM, end - i), 0, -1):
                    k = get(marked[i:i + n])
                    if k is not None:
                        ids.append(k)
                        drops.append(MAX_GRAM - n)
                        break
            sizes.append(len(ids) - before)
        out = np.zeros((len(words), len(self.langs)))
        if ids:
            logs = self.gram_logs[ids] + (np.array(drops) * BACKOFF)[:, None]
            sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
            ends = np.cumsum(sizes)
            lengths = np.array([len(w) + 1 for w in words])
            out = (sums[ends] - sums[ends - sizes]) / lengths[:, None]
        return out


class Scorer:
    """Scores texts with a model; words met before are looked up."""

    def __init__(self, model: Model):
        self.model = model
        self._start()

    def _start(self):
        self.places = dict(self.model.words)
        self.table = np.zeros((len(self.places) + _CACHE_WORDS, len(self.model.langs)))
        self.table[:len(self.places)] = self.model.word_logs

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, probability of it among the languages of the model)."""
        found = _letters(text)
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.langs))
        for at in range(0, len(found), 10_000):
            part = found[at:at + 10_000]
            if len(self.places) + len(part) > len(self.table):
                self._start()
            new = [w for w in dict.fromkeys(part) if w not in self.places]
            if new:
                first = len(self.places)
                self.table[first:first + len(new)] = self.model.unseen(new)
                self.places.update(zip(new, range(first, first + len(new)), strict=True))
            total += self.table[list(map(self.places.__getitem__, part))].sum(axis=0)
        best = int(np.argmax(total))
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def held_out() -> Column:
    """True for the third of documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for word in _letters(text):
                counts[lang, word] = counts.get((lang, word), 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "word", "n"])


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, dict[str, int]] = {}
        for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
            own = counts.setdefault(lang, {})
            get = own.get
            for gram in grams(word):
                own[gram] = get(gram, 0) + n
        yield pd.DataFrame([(lang, *x) for lang, own in counts.items() for x in own.items()], columns=["lang", "word", "n"])


def _share(hashed: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return hashed.cast("double") / F.lit(2.0**64) + 0.5


def _chosen(labelled: DataFrame, fit_docs: int) -> DataFrame:
    """lang and text of about `fit_docs` different texts of each language, those of the lowest hashes; all where there are no more."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("_h"))
    shares = rows.select("lang", "_h").distinct().groupBy("lang").agg((F.lit(float(fit_docs)) / F.count("*")).alias("_share"))
    # Copies of a text have one hash, so that a text counts once in a language.
    few = rows.join(F.broadcast(shares), "lang").where((F.col("_share") >= 1) | (_share(F.col("_h")) < F.col("_share")))
    return few.groupBy("lang", "_h").agg(F.first("text").alias("text")).select("lang", "text")


def _top(counts: DataFrame, most: int) -> DataFrame:
    """The `most` entries with the best place by count in any language; entries of one count share their places out by a hash."""
    before = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per language and different count: their number grows with the root of the counted words.
    levels = counts.groupBy("lang", "n").agg(F.count("*").alias("_here"))
    levels = levels.withColumn("_above", F.coalesce(F.sum("_here").over(before), F.lit(0)))
    place = F.col("_above") + F.col("_here") * _share(F.xxhash64("word"))
    placed = counts.join(F.broadcast(levels), ["lang", "n"]).groupBy("word").agg(F.min(place).alias("_place"))
    return placed.orderBy("_place", "word").limit(most).select("word")


def _table(counts: DataFrame, langs: list[str], most: int) -> tuple[dict[str, int], np.ndarray]:
    """The `most` entries that are most frequent in their languages, with their smoothed log frequency in each language."""
    rows = counts.join(_top(counts, most), "word").toPandas()
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    entries = {w: k for k, w in enumerate(sorted(set(rows["word"])))}
    matrix = np.zeros((len(entries), len(langs)))
    column = {lang: k for k, lang in enumerate(langs)}
    matrix[rows["word"].map(entries).to_numpy(dtype=np.int64), rows["lang"].map(column).to_numpy(dtype=np.int64)] = rows["n"]
    totals = np.array([sums.get(lang, 0) for lang in langs], dtype=np.float64)
    return entries, np.log((matrix + _SMOOTH) / (totals + _SMOOTH * (len(entries) + 1)))


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model from text and lang of the rows with a language: about `fit_docs` different texts of each, chosen by a hash of the text.

    A language with no more texts is learned from all of them. Copies of a text count once in a language.
    Rows without text or language are ignored; an empty table gives a model without languages.
    """
    counts = _chosen(labelled, fit_docs).mapInPandas(_count_words, "lang string, word string, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    shorter = counts.mapInPandas(_count_grams, "lang string, word string, n long")
    shorter = shorter.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    try:
        langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
        known, logs = _table(counts, langs, MODEL_WORDS)
        parts, part_logs = _table(shorter, langs, MODEL_GRAMS)
    finally:
        shorter.unpersist()
        counts.unpersist()
    return Model(langs, known, logs, parts, part_logs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score, from the whole text alone.

    A null text, or one without a letter, is `und` with score 0. Of equal scores the first language by
    code point wins. Columns of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in texts:
            yield pd.DataFrame([scorer.score(t) for t in batch], columns=["lang_pred", "score"])

    return docs.drop("lang_pred", "score").withColumn("_p", predict("text")).select(
        *[f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")], "_p.lang_pred", "_p.score")
