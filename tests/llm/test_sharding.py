"""Sharding and mixing: exact sizes, whole content, exact distributions, reruns."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from txnlens.llm import mixing, sharding


@pytest.mark.parametrize(("good", "bad", "drawn"), [(3, 4, 5), (10, 2, 7), (1, 1, 1), (0, 5, 3), (5, 0, 2), (6, 6, 0)])
def test_hypergeometric_is_exact(good, bad, drawn):
    rng = np.random.default_rng(5)
    n = 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    for k in range(max(0, drawn - bad), min(good, drawn) + 1):
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    assert sum(seen.values()) == n


def test_hypergeometric_of_huge_sizes():
    rng = np.random.default_rng(1)
    x = sharding.hypergeometric(rng, 10**13, 9 * 10**13, 10**9)
    assert abs(x - 10**8) < 10 * 10**4


def test_matrix_margins():
    rows, room = [5, 0, 17, 30], sharding.shard_sizes(52, 7)
    matrix = sharding.communication_matrix(rows, room, 3)
    assert [sum(r) for r in matrix] == rows
    assert [sum(c) for c in zip(*matrix, strict=True)] == room


def _rows():
    return [(i % 40 if i % 7 else None, "same" if i % 3 == 0 else f"t{i}", "en", "s") for i in range(500)] + [(1, "same", "en", "s")] * 50


@pytest.mark.parametrize("cell_rows", [7, 10_000])
def test_shards_are_exact_and_whole(docs_of, cell_rows):
    df = docs_of(_rows()).repartition(5)
    out = sharding.shard_rows(df, 16, cell_rows=cell_rows)
    got = out.collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    key = ["doc_id", "text", "lang", "source", "n_chars", "size"]
    assert Counter(tuple(r[c] for c in key) for r in got) == Counter(tuple(r[c] for c in key) for r in df.collect())
    assert out.columns == [*df.columns, "shard", "slot"]


def test_shuffle_looks_uniform(spark):
    df = spark.range(0, 8000, 1, 4)
    got = sharding.shard_rows(df, 8).collect()
    table = np.zeros((4, 8))
    slots = np.zeros((4, 4))
    for r in got:
        table[r["id"] // 2000, r["shard"]] += 1
        slots[r["id"] // 2000, r["slot"] // 250] += 1
    assert ((table - 250) ** 2 / 250).sum() < 60
    assert ((slots - 500) ** 2 / 500).sum() < 40


def test_empty_table(docs_of):
    assert sharding.shard_rows(docs_of([])).count() == 0
    assert mixing.allot(docs_of([])).count() == 0


def _targets(sizes):
    """The plain loop: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        money = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else money * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] >= 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_targets(docs_of):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), "en", [None, "a", "b", "b", "b", "c", "ü", "d"][int(rng.integers(0, 8))])
            for i in range(900)] + [(2000, None, None, "a"), (2001, "", "en", "empty"), (5, "a b c", "en", "b"), (5, "a b c", "en", "b")]
    df = docs_of(rows)
    got = mixing.allot(df.drop("size"), shards=4, block_rows=20).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    assert {r["source"]: r["source_size"] for r in got} == dict(sizes)
    want = _targets(dict(sizes))
    taken, longest = Counter(), Counter()
    for r in got:
        assert len(r["draws"]) <= 3
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += len(r["draws"]) * r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 6 for s in want)
    again = mixing.allot(df.drop("size").repartition(3), shards=4, block_rows=20).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert {s for r in got for s in r["draws"]} <= set(range(4))


def test_quotas_are_split_exactly():
    quotas = [17, 0, 5, 300]
    out = mixing.split_quotas(quotas, 5, 1)
    assert [sum(c) for c in zip(*out, strict=True)] == quotas
    assert max(map(sum, out)) - min(map(sum, out)) <= 1


def test_mix_keeps_clashing_columns(docs_of):
    df = docs_of([(i, "a b c", "en", "s") for i in range(30)])
    out = mixing.draw_copies(df)
    assert set(df.columns) <= set(out.columns)
    assert {r["size"] for r in out.collect()} == {"extra"}
    slots = [r["slot"] for r in mixing.mix(df, shards=1).collect()]
    assert sorted(slots) == list(range(30))
