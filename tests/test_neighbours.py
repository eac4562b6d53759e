"""Neighbour operators against brute force, with copies and forced small blocks."""

import numpy as np
import pytest

from txnlens.detectors.neighbourhood import DBSCAN, LocalOutlierFactor
from txnlens.operators import neighbours as nb


def _points(spark, n=200, copies=80, seed=3):
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(n, 3))
    far = rng.normal(6, 0.5, size=(20, 3))
    same = np.repeat(near[:1], copies, axis=0)  # one point holds a quarter of the rows
    data = np.vstack([near, far, same])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "id long, vector array<double>")


def _brute(data, k):
    far = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(far, order, axis=1)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 150)


def test_nearest_neighbours_are_exact(spark):
    data, df = _points(spark)
    found = nb.nearest_neighbours(df, df, 4, exclude_self=True).toPandas()
    order, far = _brute(data, 4)
    assert len(found) == 4 * len(data)
    found = found.sort_values(["id", "rank"])
    assert (found["neighbour_id"].to_numpy().reshape(-1, 4) == order).all()
    assert np.allclose(found["distance"].to_numpy().reshape(-1, 4), far)


def test_radius_leaves_far_rows_out(spark):
    data, df = _points(spark)
    found = nb.nearest_neighbours(df, df, 4, exclude_self=True, radius=0.6).toPandas()
    _, far = _brute(data, 4)
    assert len(found) == (far <= 0.6).sum()


def _lof(data, k):
    order, far = _brute(data, k)
    kdist = far[:, -1]
    lrd = 1 / (np.maximum(far, kdist[order]).mean(1) + 1e-10)
    return lrd[order].mean(1) / lrd


def test_lof_equals_its_definition(spark):
    data, df = _points(spark, copies=3)
    model = LocalOutlierFactor(k=5).fit(df)
    got = model.training.toPandas().sort_values("id")["score"].to_numpy()
    assert np.allclose(got, _lof(data, 5), rtol=1e-6)
    flags = model.training_flags().toPandas()["flag"].sum()
    assert flags == int(np.ceil(0.05 * len(data))) or abs(flags - 0.05 * len(data)) <= 1


def _dbscan(data, eps, least):
    close = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1)) <= eps
    core = close.sum(1) >= least
    label = np.arange(len(data))
    while True:
        new = np.where(close & core[None, :] & core[:, None], label[None, :], len(data)).min(1)
        new = np.minimum(label, new)
        if (new == label).all():
            break
        label = new
    noise = ~core & ~(close & core[None, :]).any(1)
    return core, noise, len(set(label[core]))


@pytest.mark.parametrize("eps", [0.5, 0.9])
def test_dbscan_core_noise_and_clusters(spark, eps):
    data, df = _points(spark)
    core, noise, clusters = _dbscan(data, eps, 5)
    model = DBSCAN(eps=eps, min_samples=5)
    model.learn(df)
    table = model.clusters().toPandas().sort_values("id")
    assert (table["is_core"].to_numpy() == core).all()
    assert ((table["cluster"] == "-1").to_numpy() == noise).all()
    assert table.loc[table["cluster"] != "-1", "cluster"].nunique() == clusters
    with pytest.raises(ValueError):
        DBSCAN(eps=1e-9, min_samples=200).learn(df)


def test_silhouette_matches_pairwise_means(spark):
    data, df = _points(spark, copies=2)
    from pyspark.sql import functions as F

    labelled = df.withColumn("cluster", (F.col("id") % 3).cast("string"))
    got = nb.silhouette(labelled, labelled, 1_000).toPandas().sort_values("id")["silhouette"].to_numpy()
    far = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    cluster = np.arange(len(data)) % 3
    for i in range(0, len(data), 37):
        own = cluster == cluster[i]
        a = far[i, own].sum() / (own.sum() - 1)
        b = min(far[i, cluster == c].mean() for c in range(3) if c != cluster[i])
        assert np.isclose(got[i], (b - a) / max(a, b))


def test_silhouette_of_rows_outside_the_sample(spark):
    rows = [(i, [float(i % 2) * 9 + i / 50], str(i % 2)) for i in range(20)] + [(99, [4.0], "alone")]
    points = spark.createDataFrame(rows, "id long, vector array<double>, cluster string")
    got = {r["id"]: r["silhouette"] for r in nb.silhouette(points, points.filter("id < 10"), 10).collect()}
    assert len(got) == 21 and got[99] == 0.0
    x = {i: v[0] for i, v, _ in rows}
    for i in range(20):
        own = [abs(x[i] - x[j]) for j in range(10) if j % 2 == i % 2 and j != i]
        other = [abs(x[i] - x[j]) for j in range(10) if j % 2 != i % 2]
        a, b = sum(own) / len(own), sum(other) / len(other)
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
    with pytest.raises(ValueError):
        nb.silhouette(points, points, 10)


def test_rows_written_and_shuffled_do_not_follow_the_cells(spark, monkeypatch):
    """Every query meets every cell here: it may travel once per block, not once per cell."""
    random = np.random.default_rng(11)
    x = random.normal(size=(9_000, 24))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    written, cut = [], nb.cut_lineage
    monkeypatch.setattr(nb, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    found = nb.nearest_neighbours(points, points, 3, exclude_self=True).filter("id % 300 = 0").collect()
    assert sum(df.count() for df in written) <= 5 * len(x)
    far = np.sqrt(((x[::300, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    far[np.arange(30), np.arange(0, 9_000, 300)] = np.inf
    assert {(r["id"], r["neighbour_id"], r["rank"]) for r in found} == {
        (300 * q, int(i), n + 1) for q, row in enumerate(far) for n, i in enumerate(row.argsort()[:3])}


def test_rows_without_distances_leave_the_others_right(spark):
    random = np.random.default_rng(5)
    x = random.normal(size=(400, 3))
    rows = [(i, [None if i % 7 == 3 and j == 1 else float(c) for j, c in enumerate(v)]) for i, v in enumerate(x)]
    rows += [(900, [float("nan"), 0.0, 0.0]), (901, [float("inf"), 0.0, 0.0])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    kept = [i for i in range(400) if i % 7 != 3]
    far = np.sqrt(((x[kept][:, None] - x[kept][None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    want = {(i, kept[j], n + 1) for i, row in zip(kept, far) for n, j in enumerate(row.argsort()[:4])}
    found = nb.nearest_neighbours(points, points, 4, exclude_self=True).collect()
    assert {(r["id"], r["neighbour_id"], r["rank"]) for r in found} == want
    np.fill_diagonal(far, 0.0)
    assert {(r["id"], r["n"]) for r in nb.count_within(points, 0.5).collect()} == set(zip(kept, (far <= 0.5).sum(axis=1).tolist()))


def test_full_silhouette_meets_every_row(spark, tmp_path):
    """More rows than the former sample held, over several blocks; rows without a label take no part."""
    from txnlens.catalog.models import silhouette

    random = np.random.default_rng(8)
    x = random.normal(size=(2_300, 4)).astype("float32")
    label = [None if i % 500 == 499 else 9 if i == 7 else i % 3 for i in range(len(x))]
    rows = [(i, [float(c) for c in v], k) for i, (v, k) in enumerate(zip(x, label))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r["silhouette"] for r in silhouette(spark, str(tmp_path)).collect()}
    x, kept = x.astype(float), np.array([k is not None for k in label])
    names = np.array([-1 if k is None else k for k in label])
    assert len(got) == len(x) and got[7] == 0.0 and got[499] is None
    for i in range(0, len(x), 97):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        same = kept & (names == names[i])
        a = far[same].sum() / (same.sum() - 1)
        b = min(far[names == k].mean() for k in set(names[kept]) - {names[i]})
        assert abs(got[i] - (b - a) / max(a, b)) < 2e-6


def test_boxes_pass_over_far_rows_of_a_block(monkeypatch):
    """Narrow vectors: few pairs are compared, and the nearest rows are those of all pairs."""
    random = np.random.default_rng(4)
    x = random.uniform(size=(30_000, 3))
    asked, pairs, measure = x[::300], [], nb._approximate
    monkeypatch.setattr(nb, "_approximate", lambda a, b: pairs.append(len(a) * len(b)) or measure(a, b))
    tiles = nb._Tiles(x, np.zeros(len(x)))
    query, row, far = nb._best_of_block(asked, np.full(len(asked), np.inf), tiles, 5)
    every = np.sqrt(((asked[:, None] - x[None]) ** 2).sum(axis=2))
    assert (row.reshape(-1, 5) == every.argsort(axis=1)[:, :5]).all()
    assert np.allclose(far.reshape(-1, 5), np.sort(every, axis=1)[:, :5])
    assert sum(pairs) < 0.25 * len(asked) * len(x)


def test_leaves_hold_every_row_once():
    x = np.repeat(np.random.default_rng(2).integers(0, 3, size=(4_000, 2)).astype(float), 2, axis=0)
    found = nb._leaves(x, 100)
    assert sorted(np.concatenate(found).tolist()) == list(range(len(x)))
    assert all(len(rows) <= 100 or (x[rows] == x[rows[0]]).all() for rows in found)
