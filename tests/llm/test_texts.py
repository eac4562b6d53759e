"""Quality rules, languages, secrets, licenses and benchmark leaks against plain versions."""

import math
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnlens.llm import decontaminate, langid, licenses, quality, secrets
from txnlens.llm.scratch import cut_lineage

ODD = [None, "", " ", "\n\n", "a", "a\tb\x0bc\x0cd\re\n", "é ü #$%", "\x00   x", "𝒳 y"]


def _measures(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    hit = {j for i in range(len(found) - 7) if windows[tuple(found[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(hit))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "a b c d e f g h", "\n", "#", "é", "\t", "A!"]), max_size=60))
def test_measures_of_small_texts(parts):
    text = " ".join(parts)
    assert quality.measure_text(text)[:5] == _measures(text)


def test_measures_of_odd_texts(docs_of):
    texts = [*ODD, "word " * 100_000, "\n".join(["same line here"] * 9)]
    got = quality.measure(docs_of(list(enumerate(texts)))).select("doc_id", f"{quality.M}.*").collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == {i: _measures(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("k", "n", "p"), [(0, 50, 0.02), (3, 80, 0.1), (10, 10, 0.5), (0, 1, 0.3)])
def test_binomial_tail(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.binomial_tail(k, n, p) == pytest.approx(exact)


def test_certified_cutoffs_err_as_seldom_as_promised():
    # True false-rejection rate just above the allowed risk at the second cutoff: certified in few samples.
    rng = random.Random(4)
    wrong = 0
    for _ in range(400):
        strict = sum(rng.random() < 0.05 for _ in range(300))
        passed = quality.certify([(1.0, 0, 0), (0.5, strict, 9)], 300, 0.04, 0.05)
        wrong += len(passed) == 2
    assert wrong / 400 < 0.08


def test_calibration_and_verdicts(spark, docs_of):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(2600):
        bad = i % 10 == 0
        text = " ".join(w + ("#" if bad else "") for w in rng.sample(words, 40))
        rows.append((i, text, "en" if i % 20 else None))
        labels.append((i, 0 if bad else 1, 0))
    docs = docs_of(rows)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    cutoffs = quality.calibrate(quality.measure(docs), marks)
    assert set(cutoffs) == {"en"} and set(cutoffs["en"]) == {"symbols"}
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, lang in rows if i % 10 or lang is None}
    none = quality.keep_good(docs_of([]), marks)
    assert none.count() == 0
    assert quality.calibrate(quality.measure(docs), marks.limit(0)) == {}


def test_languages(docs_of):
    rng = random.Random(8)
    sounds = {"aa": ["ba", "bo", "bi", "lu"], "bb": ["kre", "tzu", "vok", "nix"]}
    rows = []
    for i in range(400):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(12)), lang))
    docs = docs_of([*rows, (None, None, "aa"), (900, "12 34!", "aa"), (901, "", None), (902, "loBabi " * 40_000, None)])
    docs = docs.withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("NOT held_out"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (None, 900, 901)] == ["und"] * 3
    assert got[902]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 80 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    empty = langid.fit(docs.where("doc_id < 0"))
    assert {r["lang_pred"] for r in langid.identify(docs.limit(5), empty).collect()} == {"und"}


def test_rare_languages_are_learned_from_all_their_texts(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_WORDS", 40)
    monkeypatch.setattr(langid, "MODEL_GRAMS", 60)
    rng = random.Random(21)
    common = [f"{a}{b}" for a in ("ba", "lo", "mi", "du") for b in ("ra", "se", "ti", "no", "pu")]
    rows = [(i, " ".join(rng.choices(common, k=30)), "aa") for i in range(2000)]
    rows += [(3000 + i, f"kwyx zhuv {'qq' * (i + 1)}", "zz") for i in range(3)]
    rows += [(4000 + i, "copied gelt", "aa") for i in range(1000)]
    docs = docs_of(rows)
    model = langid.fit(docs, 200)
    assert model.langs == ["aa", "zz"]
    assert {"kwyx", "zhuv", "qq", "qqqq", "qqqqqq"} <= set(model.words)
    assert [r["lang_pred"] for r in langid.identify(docs_of([(1, "kwyx zhuv", None), (2, "bara lose", None)]), model).orderBy("doc_id").collect()] == ["zz", "aa"]
    # The copies count as one text: at most one of about 200 * 30 words.
    if "copied" in model.words:
        assert model.word_logs[model.words["copied"], 0] < math.log(2 / 3000)
    # The bound of a language holds, give or take chance.
    n = {r["lang"]: r["count"] for r in langid._chosen(docs, 200).groupBy("lang").count().collect()}
    assert 130 < n["aa"] < 270 and n["zz"] == 3


def test_a_copied_text_counts_once(docs_of):
    rows = [(i, f"bara lose w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}", "aa") for i in range(100)]
    model = langid.fit(docs_of([*rows, *[(1000 + i, "copied", "aa") for i in range(500)]]))
    assert model.word_logs[model.words["copied"], 0] < model.word_logs[model.words["bara"], 0] - 3


def test_words_and_grams_are_ranked_in_their_language(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_WORDS", 12)
    monkeypatch.setattr(langid, "MODEL_GRAMS", 40)
    letters = "abcdefghij"
    rows = [(i, " ".join(f"{a}{letters[i % 10]}{letters[i // 10 % 10]}{a} " * 3 for a in letters), "aa") for i in range(100)]
    model = langid.fit(docs_of([*rows, (500, "xyz xyz xyz uvw uvw ttt", "zz")]))
    assert {"xyz", "uvw", "ttt"} <= set(model.words) and len(model.words) == 12
    assert "xyz" in model.grams and len(model.grams) == 40


def test_unknown_words_back_off():
    model = langid.Model(["x"], {}, __import__("numpy").zeros((0, 1)), {" a": 0, "b": 1}, __import__("numpy").array([[-1.0], [-2.0]]))
    # " a" at the start (3 steps down from 5), nothing at "a", "b" at the third position (4 steps down).
    assert model.unseen(["ab"])[0, 0] == pytest.approx((-1.0 + 3 * langid.BACKOFF - 2.0 + 4 * langid.BACKOFF) / 3)


def _spans(text):
    kinds = [
        ("assign", re.compile(r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return [s for _, _, s in sorted(found)]


def test_secrets_against_plain(docs_of):
    rng = random.Random(9)
    parts = ["password", "Token", "API_KEY", "apikey", "\"", "'", " ", "=", ":", "abc", "abcdef", "==", "AKIA", "A" * 20,
             "0123456789abcdef" * 2, "é", "\n", "secret: ", "x.y/z+1", "ſecret=abcdefg", "𝒳"]
    texts = [*ODD, *["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(300)], ("f" * 30 + " ") * 2000]
    texts += texts[:40]
    found = secrets.scan_paths(docs_of(list(enumerate(texts))))
    base = F.filter("findings", lambda f: f["rule"].isin(list(secrets.BASE)))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", secrets.spelled(base).alias("s")).collect()}
    assert got == {i: ",".join(_spans(t)) for i, t in enumerate(texts)}
    assert secrets.scan_paths(docs_of([])).count() == 0


def test_ledger_scans_only_what_is_new(spark, docs_of):
    old, new = [(1, "token=abcdefgh"), (2, "nothing")], [(3, "token=abcdefgh"), (4, "secret=12345678"), (5, None)]

    def blobs(rows):
        return docs_of(rows).select(secrets.blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))

    ledger = cut_lineage(secrets.ledger_rows(secrets.scan_blobs(blobs(old))))
    assert ledger.count() == 2 * len(secrets.RULES)
    second = secrets.scan_blobs(blobs(old + new), ledger)
    fresh = cut_lineage(secrets.ledger_rows(second))
    assert fresh.count() == 2 * len(secrets.RULES)  # the blobs of rows 4 and 5
    raised = (secrets.Rule("assign", secrets.RULES[0].pattern, secrets.RULES[0].holds, 2), *secrets.RULES[1:])
    third = secrets.ledger_rows(secrets.scan_blobs(blobs(old + new), ledger.union(fresh), raised))
    assert {(r["rule"], r["version"]) for r in third.collect()} == {("assign", 2)} and third.count() == 4

    def spans(df):
        return sorted((r["doc_id"], r["s"]) for r in df.select("doc_id", secrets.spelled(F.col("findings")).alias("s")).collect())

    everything = docs_of(old + new)
    assert spans(secrets.scan_paths(everything, ledger.union(fresh))) == spans(secrets.scan_paths(everything))


def test_every_license_is_found_in_its_place(docs_of):
    filler = "Lorem ipsum dolor sit amet.\n"
    texts = [filler * 3 + t + "\n" + filler for t in licenses.TEMPLATES.values()]
    texts += [None, "", "We licensed a thing.", "copyright " * 3000, "Released under   the mit LICENSE.", "Licensed under CC BY-NC 3.0.",
              "a " * 20_000 + licenses.TEMPLATES["MIT"] + " b" * 20_000]
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(docs_of(list(enumerate(texts)))).collect()}
    for k, name in enumerate(licenses.TEMPLATES):
        assert [f["license"] for f in got[k]] == [name]
        span = texts[k][got[k][0]["start"]:got[k][0]["end"]]
        assert licenses.TEMPLATES[name].startswith(span) and got[k][0]["n_missing"] == got[k][0]["n_added"] == 0
    rest = [[f["license"] for f in got[k]] for k in range(len(licenses.TEMPLATES), len(texts))]
    assert rest == [[], [], [], [], ["MIT"], [], ["MIT"]]


def _prose(rng, size):
    words = []
    while size > 0:
        words.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))))
        size -= len(words[-1]) + 1
    return words


@pytest.mark.parametrize("size", [20_000, 100_000, 1_000_000])
def test_notices_in_long_lines_are_found(size):
    rng = random.Random(size)
    for name, notice in licenses.TEMPLATES.items():
        words = _prose(rng, size)
        at = rng.randint(0, len(words))
        text = " ".join([*words[:at], "zz", notice, "zz", *words[at:]])
        (found,) = licenses.scan_text(text)
        assert (found["license"], found["n_missing"], found["n_added"]) == (name, 0, 0)
        assert text[found["start"]:found["end"]] == notice.rstrip(".")


def test_notices_between_many_lines_with_terms_are_found():
    rng = random.Random(31)
    for name, notice in licenses.TEMPLATES.items():
        lines = [f"copyright {' '.join(_prose(rng, 40))}" for _ in range(400)]
        lines.insert(rng.randint(0, 400), notice)
        assert [f["license"] for f in licenses.scan_text("\n".join(lines))] == [name]


@pytest.mark.parametrize(("between", "width"), [("\n", 78), ("\n * ", 60), ("\n\n", 30), ("\r\n# ", 20), ("\n//\n// ", 1)])
def test_wrapped_notices_are_found_whole(docs_of, between, width):
    lines = [textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False) for t in licenses.TEMPLATES.values()]
    texts = ["int a;" + between + between.join(x) + between + "int b;" for x in lines]
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(docs_of(list(enumerate(texts)))).collect()}
    assert [[(f["license"], f["n_missing"], f["n_added"]) for f in got[k]] for k in range(len(texts))] == [[(n, 0, 0)] for n in licenses.TEMPLATES]


def test_pieces_hold_all_words_near_a_term():
    rng = random.Random(32)
    for _ in range(60):
        words = _prose(rng, rng.choice([10, 2000, 9000]))
        for _ in range(rng.choice([0, 1, 3, 200])):
            words.insert(rng.randint(0, len(words)), "license")
        text = rng.choice([" ", "\n\n", " " * 50]).join(words)
        near = {j for k, w in enumerate(words) if "licens" in w for j in range(k - licenses.REACH, k + licenses.REACH + 1)}
        spans = [m.span() for m in re.finditer(r"\w+", text)]
        parts = list(licenses.pieces(text))
        assert {spans[j] for j in near if 0 <= j < len(spans)} <= {x[1:] for p in parts for x in p}
        assert all(len(p) <= licenses.PIECE for p in parts)


def test_near_wording_is_listed():
    found = licenses.scan_text("Permission is hereby granted, free of cost, to any person obtaining a copy of this software and "
                               "associated documentation files (the \"Software\"), to deal in the Software without restriction")
    assert [(f["license"], f["missing"], f["added"]) for f in found] == [("MIT-text", ["charge"], ["cost"])]


def test_close_fingerprints_are_always_found():
    """The block tables give every entry within the radius, whatever bits differ."""
    import numpy as np

    rng = np.random.default_rng(2)
    items = decontaminate.Items([(k, " ".join(f"t{rng.integers(0, 9**6)}" for _ in range(40))) for k in range(30)])
    size, stride, owner, offset, prints, tables = items.classes[0]
    for _ in range(300):
        e = int(rng.integers(len(prints)))
        bits = rng.choice(64, size=decontaminate.RADIUS, replace=False)
        other = prints[e] ^ np.uint64(sum(1 << int(b) for b in bits))
        hits = set()
        for b, (first, entries) in enumerate(tables):
            v = int(decontaminate._block(np.array([other]), b)[0])
            hits |= set(entries[first[v]:first[v + 1]].tolist())
        assert e in hits


def test_leaks_against_plain(spark, docs_of):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 15, 20, 33, 59, 120, 300])]
    items += [(100, None), (101, "..."), (102, "")]
    rows = []
    for i in range(200):
        text = rng.choices(vocabulary, k=rng.choice([0, 10, 200, 900]))
        k, words = rng.choice(items[3:12])
        inside = words.split()
        if i % 4 == 1:
            inside = inside[:max(5, int(len(inside) * 0.93))]
        if i % 4 == 2 and len(inside) >= 100:
            inside[len(inside) // 2] = "other"
        if i % 4 != 3:
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in inside]
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (502, " ".join(vocabulary * 40) + " " + items[9][1]), (503, items[2][1]), (504, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], x["item_id"]): round(x["similarity"], 9) for r in decontaminate.find_leaks(docs_of(rows), benchmark, 5).collect()
           for x in r["leaks"] if x["item_id"] > 2}

    def bag(w):
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    want = {}
    for d, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        place = {}
        for i in range(len(w) - 4):
            place.setdefault(tuple(w[i:i + 5]), []).append(i)
        for k, t in items[3:12]:
            q = t.split()
            own = bag(q)
            starts = {p - j for j in range(len(q) - 4) for p in place.get(tuple(q[j:j + 5]), ())}
            for s in {max(0, min(x + y, max(0, len(w) - len(q)))) for x in starts for y in range(-3, 4)}:
                b = bag(w[s:s + len(q)])
                score = sum((own & b).values()) / sum((own | b).values())
                if score >= 0.8:
                    want[d, k] = max(want.get((d, k), 0), round(score, 9))
    assert got == want and len(want) > 120
    ones = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontaminate.find_leaks(docs_of(rows), benchmark).where("doc_id > 502").collect()}
    assert 2 in ones[503] and 0 in ones[504]
    assert decontaminate.find_leaks(docs_of([]), benchmark).count() == 0
    assert decontaminate.find_leaks(docs_of(rows[:3]), benchmark.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_items_without_id_are_found(spark, docs_of, monkeypatch):
    rng = random.Random(41)
    passages = [" ".join(rng.choices([f"v{i}" for i in range(3000)], k=30)) for _ in range(6)]
    benchmark = spark.createDataFrame([(None, passages[0]), (7, passages[1]), (None, passages[2]), (8, None), (0, passages[3])], "item_id long, text string")
    docs = docs_of([(1, f"aa {passages[0]} bb"), (2, " cc ".join(passages[:4])), (3, passages[4])])
    for most_words in (decontaminate.WORDS_PER_PASS, 45):
        monkeypatch.setattr(decontaminate, "WORDS_PER_PASS", most_words)
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.find_leaks(docs, benchmark).collect()}
        assert got == {1: [None], 2: [None, None, 0, 7], 3: []}


def test_blocks_of_items_are_bounded_by_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WORDS_PER_PASS", 10)
    benchmark = spark.createDataFrame([(k, "w " * n) for k, n in enumerate([4, 6, 1, 40, 2, 2, 2, 2])], "item_id long, text string")
    assert [[k for k, _ in b] for b in decontaminate._item_blocks(benchmark, 3)] == [[0, 1], [2], [3], [4, 5, 6], [7]]


@pytest.mark.parametrize("n_words", [300, 600])
def test_long_items_with_a_block_edited_in_a_row(n_words):
    """Recall of long items: one block replaced in a row, as large as exact similarity 0.8 allows, at any place
    of a document. Without the quarter windows 94 of 99 (300 words) and 122 of 133 (600 words) were found."""
    rng = np.random.default_rng(n_words + 7)
    found = tried = 0
    for _ in range(150):
        item = [f"w{rng.integers(0, 10**7)}" for _ in range(n_words)]
        block = max(1, int(n_words * rng.uniform(0.07, 0.11)))
        at = int(rng.integers(0, n_words - block))
        edited = item[:at] + [f"x{rng.integers(0, 10**7)}" for _ in range(block)] + item[at + block:]
        a, b = (Counter(decontaminate.shingles(decontaminate.word_hashes(t), 5).tolist()) for t in (item, edited))
        if decontaminate._similarity(a, b) < decontaminate.SIMILAR:
            continue
        pad = [f"p{rng.integers(0, 10**7)}" for _ in range(int(rng.integers(0, 700)))]
        tried += 1
        leaks = decontaminate.Items([(1, " ".join(item))]).leaks([" ".join(pad + edited + pad)])[0]
        found += any(i == 1 for i, *_ in leaks)
    assert tried >= 90
    assert found == tried


@pytest.mark.parametrize("text", ["Released under the MIT terms", "Licensed under CC BY 4.0 terms here",
                                  "Redistribution and use in source and binary forms, with or without modification, are "
                                  "permitted provided that the following conditions are satisfied"])
def test_accepted_wordings_need_no_other_term(text):
    """The filter is built from the notices: a wording the comparison accepts is never filtered out first."""
    alone = [f["license"] for f in licenses.scan_text(text)]
    assert alone and alone == [f["license"] for f in licenses.scan_text("Copyright me. " + text)][-len(alone):]


def test_every_notice_holds_an_anchor():
    import re as _re

    anchor = _re.compile(licenses.ANCHORS)
    for text in licenses.TEMPLATES.values():
        assert anchor.search(text)


def test_secrets_keep_a_column_named_blob(docs_of):
    docs = docs_of([(1, "token = abcdef123456"), (2, None)]).withColumns({"blob": F.lit("mine"), "_blob": F.lit(7)})
    out = secrets.scan_paths(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["blob"], r["_blob"], len(r["findings"])) for r in out] == [(1, "mine", 7, 1), (2, "mine", 7, 0)]
