"""Near duplicates against brute force; ProbMinHash against the exact similarity."""

import random
from collections import Counter

import numpy as np
import pytest

from txnlens.llm import graph, minhash
from txnlens.llm.words import words


def _bag(text):
    w = words(text)
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def _similar(a, b):
    """Probability Jaccard by its definition."""
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in keys) for x in a if x in b)


def _classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (_, a), (_, b) = rows[i], rows[j]
            if a is None or b is None:
                continue
            same = a == b if not words(a) or not words(b) else _similar(_bag(a), _bag(b)) >= 0.8
            if same:
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            ids[r] = min(d, ids.get(r, d))
    return sorted(((d, ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.choice([12, 60, 150])) for _ in range(12)]
    rows = []
    for i in range(130):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            text += text[:20]
        rows.append((i, " ".join(text)))
    # A chain: neighbours are similar, the ends are not.
    chain = rng.choices(vocabulary, k=200)
    for i in range(12):
        rows.append((200 + i, " ".join(chain[i * 8:i * 8 + 110])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, docs_of, seed):
    rows = _corpus(seed)
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs_of(rows)).collect()), key=repr)
    assert got == _classes(rows)


def test_odd_rows(docs_of):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, " ."), (6, "a b"), (7, "A  b!"), (8, "b a"), (None, "a b"), (9, "x"),
            (9, "x"), (9, "y z"), (None, "only here"), (10, "long " * 50_000), (11, "long " * 50_001)]
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs_of(rows)).collect()), key=repr)
    assert got == _classes(rows)
    assert minhash.near_duplicates(docs_of([])).count() == 0
    kept = minhash.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(((r["doc_id"], "-" if r["text"] is None else r["text"][:9]) for r in kept.collect()), key=repr) == sorted(
        [(1, "-"), (2, "-"), (3, ""), (5, " ."), (6, "a b"), (8, "b a"), (9, "x"), (9, "y z"), (None, "only here"), (10, "long long")], key=repr)


def test_registers_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 2**62, 400).astype(np.uint64)
    a, b = np.sort(keys[:300]), np.sort(keys[60:])
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    exact = minhash.prob_jaccard((a, wa), (b, wb))
    assert exact == pytest.approx(_similar(Counter(dict(zip(a.tolist(), wa.tolist()))), Counter(dict(zip(b.tolist(), wb.tolist())))))
    n = 4000
    both = minhash.prob_minhash(
        np.concatenate([a, b]), np.concatenate([wa, wb]).astype(float), np.repeat([0, 1], [len(a), len(b)]), 2, n)
    assert abs((both[0] == both[1]).mean() - exact) < 4 * (exact * (1 - exact) / n) ** 0.5
    # The other sets of a batch change nothing, nor does a common factor of the weights.
    alone = minhash.prob_minhash(a, 7.0 * wa, np.zeros(len(a), dtype=int), 1, n)
    assert (alone[0] == both[0]).all()


def test_bands_catch_what_they_should():
    assert minhash.miss_probability(0.8) < 1e-4


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [
        (rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(parent) if find(x) != x}
    got = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want


def test_groups_of_many_chunks_lose_no_link(spark, docs_of, monkeypatch):
    """Star groups cut into chunks of three members: near misses of the first leader still find each other."""
    monkeypatch.setattr(minhash, "_CHUNK", 3)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            text[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(text) + (" " + " ".join(text[:9]) if i % 7 == 0 else "")))
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs_of(rows)).collect()), key=repr)
    assert got == _classes(rows)
