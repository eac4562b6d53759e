"""Centroid clustering: exact popcount dot products, and whole results against plain integer k-means."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from txnlens.llm import centroids
from txnlens.llm.queries import SQL


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-2**23, 2**23 - 1), min_size=64, max_size=64),
       st.lists(st.integers(-2**23, 2**23 - 1), min_size=64, max_size=64))
def test_popcount_dots_are_exact(x, c):
    bits = max(max(abs(v) for v in x + c).bit_length() + 1, 2)
    xp, cp = centroids.planes(np.array([x]), bits), centroids.planes(np.array([c]), bits)
    assert centroids.dots(xp, cp, bits)[0, 0] == sum(a * b for a, b in zip(x, c))
    assert centroids.unpack(xp, bits)[0].tolist() == x


def plain(rows, k=8, rounds=10):
    """Integer k-means with lists, as the contract words it."""
    kept = []
    for vec_id, emb in rows:
        if emb is None or len(emb) != 64 or any(v is None or not math.isfinite(v) for v in emb):
            continue
        kept.append((vec_id, [math.floor(float(np.float32(v)) * 1024) for v in emb]))
    if not kept:
        return {}
    def key(item):
        h = None if item[0] is None else hashlib.sha256(f"3:{item[0]}".encode()).hexdigest()
        return (h is None, h or "", item[1])
    cents = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        best = min(range(len(cents)), key=lambda j: (d[j], j))
        return best, d[best]

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        for j, vs in groups.items():
            cents[j] = [sum(col) // len(vs) for col in zip(*vs)]
    out = [(i, *nearest(v)) for i, v in kept]
    spread = {}
    for _, c, d in out:
        spread[c] = spread.get(c, 0) + d
    total = sum(spread.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, spread[c], total, sha[c]) for i, c, d in out), key=_key)


def fixture(rng, n):
    rows = []
    for i in range(n):
        rows.append((i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 64)]))
    rows += [(n, None), (n + 1, [0.1] * 63), (n + 2, [None] + [0.0] * 63), (n + 3, [float("nan")] + [0.0] * 63),
             (n + 4, [float("inf")] + [0.0] * 63), (None, [0.25] * 64), (7, rows[7][1]), (8, rows[3][1]),
             (n + 5, [0.5] * 64), (n + 6, [-0.5] * 64)]
    return rows


def run(spark, rows, **kw):
    # Extra columns whose names clash with the result's.
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"cluster": F.lit("x"), "_id": F.lit(1), "distance": F.lit(None)})
    out = centroids.cluster(df, **kw).collect()
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                   for r in out), key=_key)


def _key(t):
    return (t[0] is None, t[0] or 0, t[1:])


def test_against_plain_kmeans(spark):
    rows = fixture(np.random.default_rng(3), 300)
    got = run(spark, rows)
    want = plain(rows)
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert len(got) == 300 + 3 + 2


def test_fewer_vectors_than_centroids_and_ties(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [0.5] * 64)]
    got = run(spark, rows)
    assert sorted(got, key=_key) == sorted(plain(rows), key=_key)
    assert {g[1] for g in got} <= {0, 1, 2}


def test_empty_and_nothing_kept(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [1.0])]) == []


def test_huge_components_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1e9] * 64)])


def test_sql_matches_on_a_fixture(spark, tmp_path):
    rows = fixture(np.random.default_rng(5), 120)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "e"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(db.execute(SQL["op11_centroids"]).fetchall(), key=_key)
    assert [tuple(w) for w in want] == sorted(plain(rows), key=_key)
