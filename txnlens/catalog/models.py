"""Distance operators and detectors: KNN1, RNG1, NN1, DET1-13, AGG27-31, AGG34."""

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from txnlens import schema
from txnlens.catalog.base import feature_sql, features, query, rounded, sql
from txnlens.detectors import centres, isolation, neighbourhood, support
from txnlens.detectors.batches import score_with
from txnlens.detectors.robust import mahalanobis
from txnlens.detectors.roster import SCALER_OF, build_roster, scaled_rows
from txnlens.operators import neighbours as nb
from txnlens.operators import ranking
from txnlens.operators.quantiles import quantiles
from txnlens.operators.scaling import fit_scalers
from txnlens.sources.tables import vectors

# ---- distances over the embeddings -----------------------------------------

_PAIRS = """
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
far AS (SELECT a.id, b.id AS nid, list_distance(a.v, b.v) AS d FROM e a, e b),
others AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rk FROM far WHERE id <> nid)"""
_EPS = 1.18


@query("knn1_nearest_neighbours", sql(_PAIRS, """
SELECT id, nid AS neighbour_id, CAST(rk AS INTEGER) AS rank, round(d, 6) AS distance FROM others WHERE rk <= 5"""))
def nearest_neighbours(spark, folder):
    points = vectors(spark, folder)
    return nb.nearest_neighbours(points, points, 5, exclude_self=True).select(
        "id", "neighbour_id", "rank", rounded("distance").alias("distance"))


@query("rng1_rows_within_eps", sql(_PAIRS, f"SELECT id, count(*) AS n FROM far WHERE d <= {_EPS} GROUP BY id"))
def rows_within_eps(spark, folder):
    return nb.count_within(vectors(spark, folder), _EPS)


@query("nn1_nearest_centre", sql("e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)", """
SELECT a.id, round(min(list_distance(a.v, c.v)), 6) AS distance, CAST(arg_min(c.id, list_distance(a.v, c.v)) AS INTEGER) AS cluster
FROM e a, e c WHERE c.id < 8 GROUP BY a.id"""))
def nearest_centre(spark, folder):
    """Eight given centres, which are the vectors with the lowest ids."""
    points = vectors(spark, folder)
    given = [r["vector"] for r in points.filter("id < 8").orderBy("id").collect()]
    return centres.nearest_centre(points, given).select(
        "id", rounded("score").alias("distance"), "cluster")


_LOF = """
kd AS (SELECT id, max(d) AS kdist FROM {nb} WHERE rk <= 20 GROUP BY id),
lrd AS (SELECT n.id, 1.0 / (avg(greatest(n.d, kd.kdist)) + 1e-10) AS lrd FROM {nb} n JOIN kd ON kd.id = n.nid WHERE rk <= 20 GROUP BY n.id)"""


@query("det2_lof_training", sql(_PAIRS, _LOF.format(nb="others"), """
SELECT n.id, round(avg(b.lrd) / max(a.lrd), 6) AS score FROM others n JOIN lrd a ON a.id = n.id JOIN lrd b ON b.id = n.nid WHERE rk <= 20 GROUP BY n.id"""))
def lof_training(spark, folder):
    model = neighbourhood.LocalOutlierFactor(k=20)
    points = vectors(spark, folder)
    model.learn(points)
    return model.training_score(points).select("id", rounded("score").alias("score"))


@query("det3_lof_live", sql(_PAIRS, _LOF.format(nb="others"), """
seen AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS srk FROM far),
own AS (SELECT s.id, 1.0 / (avg(greatest(s.d, kd.kdist)) + 1e-10) AS lrd FROM seen s JOIN kd ON kd.id = s.nid WHERE srk <= 20 GROUP BY s.id)""", """
SELECT s.id, round(avg(b.lrd) / max(o.lrd), 6) AS score FROM seen s JOIN own o ON o.id = s.id JOIN lrd b ON b.id = s.nid WHERE srk <= 20 GROUP BY s.id"""))
def lof_live(spark, folder):
    """Every row scored as if unseen: it meets itself at distance 0."""
    model = neighbourhood.LocalOutlierFactor(k=20)
    points = vectors(spark, folder)
    model.learn(points)
    return model.score(points).select("id", rounded("score").alias("score"))


_CORE = f"""
core AS (SELECT id FROM far WHERE d <= {_EPS} GROUP BY id HAVING count(*) >= 5),
near AS (SELECT f.id, min(d) AS d FROM far f JOIN core c ON c.id = f.nid GROUP BY f.id)"""


@lru_cache(maxsize=4)
def _dbscan(spark, folder):
    model = neighbourhood.DBSCAN(eps=_EPS, min_samples=5)
    model.learn(vectors(spark, folder))
    return model


@query("det5_dbscan_core_and_noise", sql(_PAIRS, _CORE, f"""
SELECT e.id, c.id IS NOT NULL AS is_core, n.d > {_EPS} AS is_noise FROM e JOIN near n USING (id) LEFT JOIN core c USING (id)"""))
def dbscan_core_and_noise(spark, folder):
    return _dbscan(spark, folder).clusters().select(
        "id", "is_core", (F.col("cluster") == "-1").alias("is_noise"))


@query("det5_dbscan_summary", sql(_PAIRS, _CORE, f"""
links AS (SELECT f.id, f.nid FROM far f JOIN core a ON a.id = f.id JOIN core b ON b.id = f.nid WHERE d <= {_EPS})""", f"""
SELECT round(avg(CASE WHEN n.d > {_EPS} THEN 1 ELSE 0 END), 6) AS noise_rate,
  (WITH RECURSIVE reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.nid, r.root FROM reach r JOIN links l ON l.id = r.id WHERE r.root <= l.nid)
   SELECT count(*) FROM (SELECT id, min(root) AS root FROM reach GROUP BY id) WHERE id = root) AS clusters FROM near n"""))
def dbscan_summary(spark, folder):
    return _dbscan(spark, folder).noise_summary().select(
        rounded("noise_rate").alias("noise_rate"), "clusters")


@query("det6_dbscan_live_score", sql(_PAIRS, _CORE, "SELECT id, round(d, 6) + 0.0 AS score FROM near"))
def dbscan_live_score(spark, folder):
    return _dbscan(spark, folder).score(vectors(spark, folder)).select(
        "id", rounded("score").alias("score"))


@query("agg28_k_distance_curve", sql(_PAIRS, """
SELECT row_number() OVER (ORDER BY d DESC, id) - 1 AS place, round(d, 6) AS distance FROM others WHERE rk = 4"""))
def k_distance_curve(spark, folder):
    """Distance to the fifth nearest, the row itself counted as the first."""
    from txnlens.operators.ordered import Running, running

    points = vectors(spark, folder)
    fourth = nb.nearest_neighbours(points, points, 4, exclude_self=True).filter("rank = 4")
    ordered = running(
        fourth.select("id", "distance", (-F.col("distance")).alias("down")), [], ["down", "id"],
        {"place": Running("count")})
    return ordered.select((F.col("place") - 1).alias("place"), rounded("distance").alias("distance"))


@query("agg31_silhouette", sql(_PAIRS, """
per AS (SELECT f.id, a.label AS own, b.label AS other, avg(d) FILTER (f.id <> f.nid) AS m, count(*) AS size FROM far f JOIN e a ON a.id = f.id JOIN e b ON b.id = f.nid GROUP BY ALL),
ab AS (SELECT id, own, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b, max(size) FILTER (own = other) AS size FROM per GROUP BY ALL)""", """
SELECT id, own AS label, round(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM ab"""))
def silhouette(spark, folder):
    """All rows against all rows."""
    points = vectors(spark, folder).withColumnRenamed("label", "cluster")
    return nb.full_silhouette(points).select(
        "id", F.col("cluster").alias("label"), rounded("silhouette").alias("silhouette"))


@query("agg34_neighbour_graph", sql("""
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(vec_id || '#42'), vec_id LIMIT 260),
o AS (SELECT a.id, b.id AS nid, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rk FROM e a, e b WHERE a.id <> b.id)""",
  "SELECT id, nid AS neighbour_id FROM o WHERE rk <= 20"))
def neighbour_graph(spark, folder):
    nodes = ranking.uniform_sample(vectors(spark, folder), "id", schema.GRAPH_NODES, schema.SEED)
    return nb.nearest_neighbours(nodes, nodes, 20, exclude_self=True).select("id", "neighbour_id")


# ---- scoring with given parameters --------------------------------------------

_PAIR = "p AS (SELECT TransactionID AS id, UtilizationRatio AS x, TransactionAmount / 1e2 AS y FROM feat)"


def _pair(spark, folder):
    return features(spark, folder).select(
        F.col("TransactionID").alias("id"),
        F.array("UtilizationRatio", F.expr("TransactionAmount / 1e2")).alias("vector"))


@query("det1_forest_score_given_trees", feature_sql(_PAIR, """
h AS (SELECT id, CASE WHEN x < 0.2 THEN 1 + 2 * (ln(99) + 0.5772156649015329) - 2 * 99 / 100.0::DOUBLE ELSE CASE WHEN y < 1.5 THEN 2 + 1.0 ELSE 2.0 END END AS a,
  CASE WHEN y < 0.5 THEN 1 + 2 * (ln(59) + 0.5772156649015329) - 2 * 59 / 60.0::DOUBLE ELSE 1 + 2 * (ln(67) + 0.5772156649015329) - 2 * 67 / 68.0::DOUBLE END AS b FROM p)""", """
SELECT id, round(pow(2, -((a + b) / 2) / (2 * (ln(127) + 0.5772156649015329) - 2 * 127 / 128.0::DOUBLE)), 6) AS score FROM h"""))
def forest_score_given_trees(spark, folder):
    nodes = pd.DataFrame(
        [(0, 0, 0, 0.2, 1, 2, 128, 0), (0, 1, -1, 0.0, -1, -1, 100, 1), (0, 2, 1, 1.5, 3, 4, 3, 1),
         (0, 3, -1, 0.0, -1, -1, 2, 2), (0, 4, -1, 0.0, -1, -1, 1, 2),
         (1, 0, 1, 0.5, 1, 2, 128, 0), (1, 1, -1, 0.0, -1, -1, 60, 1), (1, 2, -1, 0.0, -1, -1, 68, 1)],
        columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    model = isolation.IsolationForest().use(nodes, 128)
    return model.score(_pair(spark, folder)).select("id", rounded("score").alias("score"))


@query("det4_svm_score_given_weights", feature_sql(_PAIR, """
SELECT id, round(0.4 - sqrt(2 / 3.0::DOUBLE) * (0.5 * cos(x * 0.7 - y * 0.2 + 0.1) - 0.25 * cos(x * -1.1 + y * 0.4 + 1.3) + 0.8 * cos(x * 0.3 + y * 0.9 + 2.2)), 6) AS score FROM p""".replace("\nSELECT", "\nSELECT")))
def svm_score_given_weights(spark, folder):
    machine = support.Machine(
        np.array([[0.7, -0.2], [-1.1, 0.4], [0.3, 0.9]]), np.array([0.1, 1.3, 2.2]),
        np.array([0.5, -0.25, 0.8]), 0.4)
    scored = score_with(_pair(spark, folder), machine, support.Machine.outlyingness)
    return scored.select("id", rounded("score").alias("score"))


@query("det7_mcd_distance_given_shape", feature_sql(_PAIR, """
SELECT id, round((0.5 * (x - 0.1) * (x - 0.1) - 2 * 0.05 * (x - 0.1) * (y - 0.6) + 0.2 * (y - 0.6) * (y - 0.6)) / (0.2 * 0.5 - 0.05 * 0.05), 5) + 0.0 AS score FROM p"""))
def mcd_distance_given_shape(spark, folder):
    model = (np.array([0.1, 0.6]), np.array([[0.2, 0.05], [0.05, 0.5]]))
    return score_with(_pair(spark, folder), model, mahalanobis).select("id", rounded("score", 5).alias("score"))


def _log_density(weight, mx, my, a, b, c):
    det = f"({a} * {c} - {b} * {b})"
    form = f"({c} * (x - {mx}) * (x - {mx}) - 2 * {b} * (x - {mx}) * (y - {my}) + {a} * (y - {my}) * (y - {my})) / {det}"
    return f"(ln({weight}) - 0.5 * ({form} + ln({det}) + 2 * ln(2 * pi())))"


@query("det8_gmm_score_given_mixture", feature_sql(_PAIR, f"""
d AS (SELECT id, {_log_density(0.7, 0.1, 0.5, 0.2, 0.05, 0.5)} AS l1, {_log_density(0.3, 0.6, 2.0, 0.9, -0.2, 1.4)} AS l2 FROM p)""", """
SELECT id, round(-(greatest(l1, l2) + ln(exp(l1 - greatest(l1, l2)) + exp(l2 - greatest(l1, l2)))), 5) AS score FROM d"""))
def gmm_score_given_mixture(spark, folder):
    mixture = centres.Mixture(
        np.array([0.7, 0.3]), np.array([[0.1, 0.5], [0.6, 2.0]]),
        np.array([[[0.2, 0.05], [0.05, 0.5]], [[0.9, -0.2], [-0.2, 1.4]]]), ridge=0.0)
    scored = score_with(_pair(spark, folder), mixture, centres.Mixture.negative_log_likelihood)
    return scored.select("id", rounded("score", 5).alias("score"))


@query("det9_kmeans_score_given_centres", feature_sql(_PAIR, """
SELECT id, round(least(sqrt((x - 0.1) * (x - 0.1) + (y - 0.4) * (y - 0.4)), sqrt((x - 0.5) * (x - 0.5) + (y - 1.9) * (y - 1.9)), sqrt((x - 2) * (x - 2) + (y - 4) * (y - 4))), 6) AS score FROM p"""))
def kmeans_score_given_centres(spark, folder):
    found = centres.nearest_centre(_pair(spark, folder), [[0.1, 0.4], [0.5, 1.9], [2.0, 4.0]])
    return found.select("id", rounded("score").alias("score"))


def _given_pca():
    return centres.PCA().use([0.2, 0.7], [[0.6, 0.8]], [0.9])


@query("det10_pca_error_given_axis", feature_sql(_PAIR, "z AS (SELECT *, (x - 0.2) * 0.6 + (y - 0.7) * 0.8 AS t FROM p)", """
SELECT id, round(((x - 0.2 - 0.6 * t) * (x - 0.2 - 0.6 * t) + (y - 0.7 - 0.8 * t) * (y - 0.7 - 0.8 * t)) / 2, 6) + 0.0 AS score FROM z"""))
def pca_error_given_axis(spark, folder):
    return _given_pca().score(_pair(spark, folder)).select("id", rounded("score").alias("score"))


@query("det13_plane_and_lift", feature_sql(_PAIR, "z AS (SELECT *, (x - 0.2) * 0.6 + (y - 0.7) * 0.8 AS t FROM p)", """
SELECT id, round(t, 6) + 0.0 AS pc1, 0.0::DOUBLE AS pc2, round(0.2 + 0.6 * t, 6) + 0.0 AS x, round(0.7 + 0.8 * t, 6) + 0.0 AS y FROM z"""))
def plane_and_lift(spark, folder):
    model = _given_pca()
    plane = model.project(_pair(spark, folder), 2)
    return plane.join(model.lift(plane), "id").select(
        "id", rounded("pc1").alias("pc1"), "pc2",
        rounded(F.col("vector")[0]).alias("x"), rounded(F.col("vector")[1]).alias("y"))


# ---- the fitted roster ----------------------------------------------------------

# Settings that keep a run at sf0.01 short; training uses the full ones by default.
SMALL = {
    "isolation_forest": {"trees": 50}, "one_class_svm": {"passes": 6}, "dbscan": {"eps": 1.5},
    "kmeans": {"starts": 3}, "gmm": {"iterations": 20},
}


@lru_cache(maxsize=4)
def scalers(spark, folder):
    return fit_scalers(features(spark, folder))


@lru_cache(maxsize=16)
def rows(spark, folder, scaler):
    return scaled_rows(features(spark, folder), scalers(spark, folder)[scaler]).persist()


@lru_cache(maxsize=32)
def fitted(spark, folder, name):
    return build_roster(SMALL)[name].fit(rows(spark, folder, SCALER_OF[name]))


def _fitted_query(name, key):
    @query(key)
    def scored(spark, folder):
        return fitted(spark, folder, name).training_flags().select(
            F.col("id").alias("TransactionID"), "score", "flag")

    return scored


for _name, _key in (
    ("isolation_forest", "det1_isolation_forest"), ("lof", "det2_lof"), ("one_class_svm", "det4_one_class_svm"),
    ("dbscan", "det6_dbscan"), ("mcd", "det7_mcd"), ("gmm", "det8_gmm"), ("kmeans", "det9_kmeans"),
):
    _fitted_query(_name, _key)


@query("det10_pca_reconstruction")
def pca_reconstruction(spark, folder):
    return _pca(spark, folder).training_flags().select(F.col("id").alias("TransactionID"), "score", "flag")


@lru_cache(maxsize=4)
def _pca(spark, folder):
    return centres.PCA().fit(rows(spark, folder, "standard"))


@query("agg27_scree")
def scree(spark, folder):
    return _pca(spark, folder).scree(spark)


@query("agg29_elbow")
def elbow(spark, folder):
    """Inertia over k on the reduced components, with fewer starts than a full run."""
    reduced = _pca(spark, folder).project(rows(spark, folder, "standard"))
    names = [c for c in reduced.columns if c != "id"]
    return centres.elbow(reduced.select("id", F.array(*names).alias("vector")), ks=range(2, 13, 5), starts=1)


@query("agg30_tree_shapes")
def tree_shapes(spark, folder):
    return fitted(spark, folder, "isolation_forest").tree_shapes(spark)


@query("agg30_mean_depth")
def mean_depth(spark, folder):
    return fitted(spark, folder, "isolation_forest").mean_depth(rows(spark, folder, "standard"))
