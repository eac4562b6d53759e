"""License scans by conditional compression.

Around every license term as many words are read on either side as the longest notice can cover, over line
breaks, blank lines and comment marks. They are taken in overlapping pieces of bounded size. The words of a
piece are compressed with zstandard, once alone and once with each license notice as a raw dictionary, at
the same parameters; the notice that saves most bytes explains most of the piece. Savings rank the notices
and settle ties. What is reported is decided by an exact word comparison alone, which lists what is missing
and what was added.
"""

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Usual short notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Words whose presence decides which license a notice names.
TELLING = frozenset("nc nd sa by cc mit bsd apache gnu lesser affero mozilla general".split())
MAX_DIFFERENT = 0.2
# Words a piece holds at most, and characters of a longer word that are compressed (no notice has such a word).
PIECE = 400
_LONG = 40
_WORD = re.compile(r"\w+")
# Words too common in prose to pick as anchors where the notice offers others.
_COMMON = frozenset("a an and as at by for in is it of on or the this to under with".split())


def anchors(templates: dict[str, str] = None) -> list[str]:
    """Words of which every wording the comparison can accept holds at least one, for some notice.

    A telling word may not be missing, so a notice with one is anchored by its longest uncommon telling word.
    Otherwise at most MAX_DIFFERENT of its words are missing, so one of any floor(MAX_DIFFERENT * n) + 1 of its
    distinct words is present: the longest uncommon ones are taken.
    """
    out = set()
    for text in (templates or TEMPLATES).values():
        wanted = [m.group().lower() for m in _WORD.finditer(text)]
        ranked = sorted(set(wanted), key=lambda w: (w in _COMMON, -len(w), w))
        telling = [w for w in ranked if _telling(w) and not w.isdigit()]
        out |= {telling[0]} if telling else set(ranked[:int(MAX_DIFFERENT * len(wanted)) + 1])
    return sorted(out)


def _telling(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word)


ANCHORS = r"(?i)\b(?:" + "|".join([*anchors(), "license"]) + r")\b"
_TERM = re.compile(ANCHORS)
LICENSE = ("array<struct<license:string,start:int,end:int,saved_bytes:int,share_saved:double,"
           "n_missing:int,n_added:int,missing:array<string>,added:array<string>>>")


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


# Words on either side of a term that a notice with all allowed additions and the slack of its place can cover.
REACH = int(max(len(_words(t)) for t in TEMPLATES.values()) * (1 + MAX_DIFFERENT)) + 6


@lru_cache(maxsize=1)
def _prepared():
    # Explicit values: with a level alone, zstandard picks others for a block with a dictionary than without.
    same = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=3, target_length=16, strategy=zstandard.STRATEGY_BTOPT)
    made = []
    for name, text in TEMPLATES.items():
        wanted = [w for w, _, _ in _words(text)]
        raw = zstandard.ZstdCompressionDict(" ".join(wanted).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, wanted, zstandard.ZstdCompressor(compression_params=same, dict_data=raw)))
    return zstandard.ZstdCompressor(compression_params=same), made


def _before(text: str, at: int) -> int:
    """Start of the REACH words that end before `at`, or of the word that `at` lies in the middle of, if they are fewer."""
    reach = 1024
    while True:
        low = max(0, at - reach)
        starts = [len(m.group()) + m.start() for _, m in zip(range(REACH + 2), _WORD.finditer(text[low:at][::-1]))]
        if low == 0 or len(starts) == REACH + 2:
            # The last of them may be cut at `low`.
            return at - starts[min(REACH, len(starts) - 1)] if starts else at
        reach *= 2


def pieces(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """The words, with their places, within REACH words of a term, in pieces of PIECE words that overlap by REACH."""
    terms = (m.start() for m in _TERM.finditer(text))
    term = next(terms, None)
    while term is not None:
        spans, fresh, left = [], 0, None
        for m in _WORD.finditer(text, _before(text, term)):
            spans.append((m.group().lower(), m.start(), m.end()))
            fresh += 1
            while term is not None and term < m.end():
                left, term = REACH + 1, next(terms, None)
            if len(spans) == PIECE:
                yield spans
                spans, fresh = spans[-REACH:], 0
            if left is not None:
                left -= 1
                if left < 0:
                    break
        if fresh:
            yield spans


def _places(found: list[str], wanted: list[str]) -> list[int]:
    """Starts at which most words of the notice stand in their place, or within two words of it."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(wanted):
        where.setdefault(w, []).append(j)
    votes = Counter(p - j for p, w in enumerate(found) for j in where.get(w, ()))
    need = max(1, (len(wanted) + 1) // 2)
    return [s for s in votes if sum(votes[s + d] for d in (-2, -1, 0, 1, 2)) >= need and votes[s] == max(votes[s + d] for d in (-2, -1, 0, 1, 2))]


def _difference(found: list[str], wanted: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the notice that are missing, words added between them, and the matched range of `found`."""
    steps = difflib.SequenceMatcher(None, wanted, found, autojunk=False).get_opcodes()
    same = [s for s in steps if s[0] == "equal"]
    if not same:
        return wanted, [], 0, 0
    low, high = same[0][3], same[-1][4]
    missing, added = [], []
    for tag, i, j, k, m in steps:
        if tag != "equal":
            missing += wanted[i:j]
            added += found[max(k, low):min(m, high)]
    return missing, added, low, high


def _possible(present: set[str], wanted: list[str]) -> bool:
    """False where the comparison cannot confirm the notice: too many of its words, or a telling one, occur nowhere."""
    absent = [w for w in wanted if w not in present]
    return len(absent) <= MAX_DIFFERENT * len(wanted) and not any(map(_telling, absent))


def scan_text(text: str | None) -> list[dict]:
    """The confirmed notices of a whole text, by place, without overlaps."""
    if not text or not _TERM.search(text):
        return []
    alone, made = _prepared()
    out = []
    for spans in pieces(text):
        found = [w for w, _, _ in spans]
        present = set(found)
        likely = [t for t in made if _possible(present, t[1])]
        if not likely:
            continue
        raw = " ".join(w[:_LONG] for w in found).encode("utf-8", "surrogatepass")
        plain = len(alone.compress(raw))
        ranked = sorted(((plain - len(c.compress(raw)), name, wanted) for name, wanted, c in likely), key=lambda x: (-x[0], x[1]))
        for saved, name, wanted in ranked:
            for start in _places(found, wanted):
                low = max(0, start - 2)
                missing, added, a, b = _difference(found[low:start + len(wanted) + 3], wanted)
                differ = len(missing) + len(added)
                if b <= a or differ > MAX_DIFFERENT * len(wanted) or any(map(_telling, missing + added)):
                    continue
                out.append({
                    "license": name, "start": spans[low + a][1], "end": spans[low + b - 1][2],
                    "saved_bytes": saved, "share_saved": saved / plain, "n_missing": len(missing),
                    "n_added": len(added), "missing": missing, "added": added})
    # Of overlapping notices the longest with the fewest differences stays.
    out.sort(key=lambda f: (f["start"] - f["end"] + 8 * (f["n_missing"] + f["n_added"]), -f["saved_bytes"], f["license"]))
    kept: list[dict] = []
    for f in out:
        if all(f["end"] <= k["start"] or f["start"] >= k["end"] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f["start"])


def _scanned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([scan_text(t) for t in batch])


def find_licenses(docs: DataFrame) -> DataFrame:
    """`docs` with licenses: name, span in code points, bytes saved and word differences of each notice.

    Whole texts are searched; null and empty texts have none. A column named licenses is replaced.
    """
    # Only texts with an anchor word leave the JVM.
    likely = F.when(F.col("text").rlike(ANCHORS), F.col("text"))
    return docs.drop("licenses").withColumn("licenses", F.pandas_udf(_scanned, LICENSE)(likely))
