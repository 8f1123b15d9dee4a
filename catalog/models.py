"""Estimators on the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabloom.operators.metrics import reduction as dm
from tabloom.operators.models import bayes, cluster, decomposition, density, graphs, linear, margin, nearest, neural, trees
from tabloom.operators.models.base import Fitted
from tabloom.operators.neighbors import nearest as neighbor_join
from tabloom.operators.scaling import fit_scaler
from tabloom.operators.split import train_test

from .base import DIMENSIONS, F4, F5, F7, F8, duck_hash, embeddings, query, rd, rounded, rows, table, union

INPUTS = ["acctbal", "nation", "n_orders"]


def customers(spark, sf):
    frame = rows(spark, sf, F4)
    return fit_scaler(frame, "standard", INPUTS).apply(frame)


def parts(spark, sf):
    frame = rows(spark, sf, F5)
    return fit_scaler(frame, "standard", ["x1", "x2", "y"]).apply(frame)


def _scored(model: Fitted, frame, *keep: str):
    out = model.predict(frame)
    return out.select("id", *keep, *[c for c in out.columns if c == "prediction" or c.startswith("probability_")])


@query("m1_logistic_regression")
def m1(spark, sf):
    frame = customers(spark, sf)
    return _scored(linear.fit_logistic(frame, INPUTS, "label"), frame, "label")


@query("m1_logistic_multiclass")
def m1b(spark, sf):
    frame = customers(spark, sf)
    return _scored(linear.fit_logistic(frame, INPUTS, "label3", class_weight="balanced"), frame, "label3")


@query("m2_decision_tree_classifier")
def m2(spark, sf):
    frame = rows(spark, sf, F4)
    return _scored(trees.fit_tree_classifier(frame, INPUTS, "label", max_depth=8), frame, "label")


@query("m3_random_forest_classifier")
def m3(spark, sf):
    frame = rows(spark, sf, F4)
    return _scored(trees.fit_forest_classifier(frame, INPUTS, "label3", n_estimators=20, max_depth=8), frame, "label3")


@query("m4_gradient_boosting_classifier")
def m4(spark, sf):
    frame = rows(spark, sf, F4)
    return _scored(trees.fit_boosting_classifier(frame, INPUTS, "label", n_estimators=10), frame, "label")


@query("m4_gradient_boosting_multiclass")
def m4b(spark, sf):
    frame = rows(spark, sf, F4)
    return _scored(trees.fit_boosting_classifier(frame, INPUTS, "label3", n_estimators=4), frame, "label3")


@query("m5_xgboost_classifier")
def m5(spark, sf):
    frame = rows(spark, sf, F4)
    return _scored(trees.fit_xgboost_classifier(frame, INPUTS, "label", n_estimators=8), frame, "label")


@query("m6_lightgbm_classifier")
def m6(spark, sf):
    frame = rows(spark, sf, F4)
    return _scored(trees.fit_lightgbm_classifier(frame, INPUTS, "label", n_estimators=8), frame, "label")


@query("m7_catboost_classifier")
def m7(spark, sf):
    frame = rows(spark, sf, F4)
    return _scored(trees.fit_catboost_classifier(frame, [*INPUTS, "segment"], "label", iterations=8), frame, "label", "segment")


@query("m8_svm_linear")
def m8(spark, sf):
    frame = customers(spark, sf)
    return _scored(margin.fit_svm(frame, INPUTS, "label", kernel="linear", max_iter=15), frame, "label")


@query("m8_svm_rbf")
def m8b(spark, sf):
    frame = customers(spark, sf)
    return _scored(margin.fit_svm(frame, INPUTS, "label3", max_iter=10), frame, "label3")


@query("m8_svm_poly")
def m8c(spark, sf):
    frame = customers(spark, sf)
    return _scored(margin.fit_svm(frame, INPUTS, "label", kernel="poly", degree=3, max_iter=15), frame, "label")


_SMOOTH = "1e-9 * greatest((SELECT var_pop(acctbal) FROM p), (SELECT var_pop(nation) FROM p), (SELECT var_pop(n_orders) FROM p))"


@query(
    "m9_naive_bayes_parameters",
    f"WITH p AS ({F4}) " + union([
        f"SELECT label3 AS \"class\", {rd('count(*)::DOUBLE / (SELECT count(*) FROM p)')} AS prior, '{c}' AS feature, {rd(f'avg({c})', 4)} AS mean,"
        f" {rd(f'var_pop({c}) + {_SMOOTH}', 2)} AS variance FROM p GROUP BY label3" for c in INPUTS
    ]),
)
def m9(spark, sf):
    model = bayes.fit_naive_bayes(rows(spark, sf, F4), INPUTS, "label3")
    table = model.table(spark)
    return table.select(
        "class", (F.round("prior", 6) + 0.0).alias("prior"), "feature", (F.round("mean", 4) + 0.0).alias("mean"),
        (F.round("variance", 2) + 0.0).alias("variance"),
    )


_LOG = " ".join(
    f"- 0.5 * ln(2 * pi() * g.v_{c}) - power(p.{c} - g.m_{c}, 2) / (2 * g.v_{c})" for c in INPUTS
)


@query(
    "m9_naive_bayes_prediction",
    f"""WITH p AS ({F4}), g AS (SELECT label3, ln(count(*)::DOUBLE / (SELECT count(*) FROM p)) AS lp, """
    + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + {_SMOOTH} AS v_{c}" for c in INPUTS)
    + f""" FROM p GROUP BY label3),
    s AS (SELECT p.id, g.label3 AS c, g.lp {_LOG} AS l FROM p, g)
    SELECT id, c AS prediction FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY l DESC, c) AS n FROM s) q WHERE n = 1""",
)
def m9b(spark, sf):
    frame = rows(spark, sf, F4)
    return bayes.fit_naive_bayes(frame, INPUTS, "label3").predict(frame).select("id", "prediction")


_HASH = duck_hash("CAST(id AS VARCHAR)")
_NEAR = f"""WITH p AS ({F4}),
    tr AS (SELECT * FROM p WHERE {_HASH} < 3435973836.8), te AS (SELECT * FROM p WHERE {_HASH} >= 3435973836.8),
    d AS (SELECT te.id, tr.id AS other, tr.label3, sqrt(power(te.acctbal - tr.acctbal, 2) + power(te.nation - tr.nation, 2) + power(te.n_orders - tr.n_orders, 2)) AS d
          FROM te, tr),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS n FROM d)"""


@query(
    "m10_nearest_neighbors",
    f"""{_NEAR} SELECT id, label3 AS prediction FROM (
      SELECT id, label3, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label3) AS r FROM k WHERE n <= 5 GROUP BY id, label3) q WHERE r = 1""",
)
def m10(spark, sf):
    train, test = train_test(rows(spark, sf, F4), "id")
    return nearest.fit_nearest(train, INPUTS, "label3", "id").predict(test).select("id", "prediction")


@query(
    "m10_nearest_neighbors_weighted",
    f"""{_NEAR} SELECT id, {rd("sum(CASE WHEN label3 = 'high' THEN 1 / d ELSE 0 END) / sum(1 / d)")} AS probability_high
      FROM k WHERE n <= 7 GROUP BY id""",
)
def m10b(spark, sf):
    train, test = train_test(rows(spark, sf, F4), "id")
    model = nearest.fit_nearest(train, INPUTS, "label3", "id", n_neighbors=7, weights="distance")
    return rounded(model.predict(test).select("id", "probability_high"))


@query("m11_mlp_classifier")
def m11(spark, sf):
    frame = customers(spark, sf)
    return _scored(neural.fit_mlp_classifier(frame, INPUTS, "label3", "id", (32,), max_iter=60, learning_rate_init=0.01), frame, "label3")


def _line(model) -> list:
    return [(c, float(w)) for c, w in zip([*model.features, "intercept"], [*model.coefficients, model.intercept])]


def _lines(spark, model):
    return rounded(spark.createDataFrame(_line(model), "term string, weight double"), 5)


def _line_sql(slope: str) -> str:
    return (
        f"WITH p AS ({F5}), w AS (SELECT {slope} AS w, avg(x2) AS mx, avg(y) AS my FROM p)"
        f" SELECT 'x2' AS term, {rd('w', 5)} AS weight FROM w UNION ALL SELECT 'intercept', {rd('my - w * mx', 5)} FROM w"
    )


@query("m12_linear_regression", _line_sql("regr_slope(y, x2)"))
def m12(spark, sf):
    return _lines(spark, linear.fit_linear(rows(spark, sf, F5), ["x2"], "y"))


@query(
    "m12_linear_positive",
    f"WITH p AS ({F5}) SELECT 'x1' AS term, {rd('regr_slope(y, x1)', 5)} AS weight FROM p UNION ALL SELECT 'neg', CAST(0 AS DOUBLE)"
    f" UNION ALL SELECT 'intercept', {rd('regr_intercept(y, x1)', 5)} FROM p",
)
def m12b(spark, sf):
    # the second input runs against the target, so its weight stays at zero
    frame = rows(spark, sf, F5).withColumn("neg", -F.col("x2"))
    return _lines(spark, linear.fit_linear(frame, ["x1", "neg"], "y", positive=True))


@query("m13_ridge_regression", _line_sql("count(*) * covar_pop(y, x2) / (count(*) * var_pop(x2) + 50)"))
def m13(spark, sf):
    return _lines(spark, linear.fit_ridge(rows(spark, sf, F5), ["x2"], "y", alpha=50.0))


_SOFT = "sign(covar_pop(y, x2)) * greatest(abs(covar_pop(y, x2)) - {l1}, 0) / (var_pop(x2) + {l2})"


@query("m14_lasso_regression", _line_sql(_SOFT.format(l1=2, l2=0)))
def m14(spark, sf):
    return _lines(spark, linear.fit_lasso(rows(spark, sf, F5), ["x2"], "y", alpha=2.0))


@query("m15_elastic_net", _line_sql(_SOFT.format(l1=1.5, l2=1.5)))
def m15(spark, sf):
    return _lines(spark, linear.fit_elastic_net(rows(spark, sf, F5), ["x2"], "y", alpha=3.0, l1_ratio=0.5))


@query("m16_decision_tree_regressor")
def m16(spark, sf):
    frame = rows(spark, sf, F5)
    return _scored(trees.fit_tree_regressor(frame, ["x1", "x2"], "y", max_depth=8), frame, "y")


@query("m17_random_forest_regressor")
def m17(spark, sf):
    frame = rows(spark, sf, F5)
    return _scored(trees.fit_forest_regressor(frame, ["x1", "x2"], "y", n_estimators=20, max_depth=8), frame, "y")


@query("m18_gradient_boosting_regressor")
def m18(spark, sf):
    frame = rows(spark, sf, F5)
    return _scored(trees.fit_boosting_regressor(frame, ["x1", "x2"], "y", n_estimators=10), frame, "y")


@query("m19_xgboost_regressor")
def m19(spark, sf):
    frame = rows(spark, sf, F5)
    return _scored(trees.fit_xgboost_regressor(frame, ["x1", "x2"], "y", n_estimators=8), frame, "y")


@query(
    "m19_first_split",
    f"""WITH p AS ({F5}), m AS (SELECT avg(y) AS base FROM p), r AS (SELECT x1, y - base AS g FROM p, m),
    s AS (SELECT x1, sum(sum(g)) OVER (ORDER BY x1) AS gl, sum(count(*)) OVER (ORDER BY x1) AS nl FROM r GROUP BY x1),
    t AS (SELECT sum(g) AS g, count(*) AS n FROM r),
    b AS (SELECT x1 AS cut, gl, nl, g - gl AS gr, n - nl AS nr FROM s, t WHERE nl < n
      ORDER BY gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) DESC, x1 LIMIT 1)
    SELECT id, {rd("base + 0.3 * CASE WHEN x1 <= cut THEN gl / (nl + 1) ELSE gr / (nr + 1) END", 4)} AS prediction FROM p, m, b""",
)
def m19b(spark, sf):
    frame = rows(spark, sf, F5)
    model = trees.fit_xgboost_regressor(frame, ["x1"], "y", n_estimators=1, learning_rate=0.3, max_depth=1)
    return model.predict(frame).select("id", (F.round("prediction", 4) + 0.0).alias("prediction"))


@query("m20_lightgbm_regressor")
def m20(spark, sf):
    frame = rows(spark, sf, F5)
    return _scored(trees.fit_lightgbm_regressor(frame, ["x1", "x2"], "y", n_estimators=8), frame, "y")


@query("m21_support_vector_regression")
def m21(spark, sf):
    frame = parts(spark, sf)
    return _scored(margin.fit_svr(frame, ["x1", "x2"], "y", "id", max_iter=60), frame, "y")


@query("m22_mlp_regressor")
def m22(spark, sf):
    frame = parts(spark, sf)
    return _scored(neural.fit_mlp_regressor(frame, ["x1", "x2"], "y", "id", (32,), max_iter=60, learning_rate_init=0.01), frame, "y")


@query("m23_kmeans")
def m23(spark, sf):
    frame = embeddings(spark, sf)
    return cluster.fit_kmeans(frame, DIMENSIONS, 3, n_init=2, max_iter=50).predict(frame).select("vec_id", "cluster")


# three fixed starting centres
CENTERS = np.array([[0.1 * ((i + k) % 3 - 1) for i in range(8)] for k in range(3)])
_TO = [" + ".join(f"power({c} - ({v}), 2)" for c, v in zip(DIMENSIONS, center)) for center in CENTERS]
_ASSIGN = (
    f"CASE WHEN ({_TO[0]}) <= ({_TO[1]}) AND ({_TO[0]}) <= ({_TO[2]}) THEN 0 WHEN ({_TO[1]}) <= ({_TO[2]}) THEN 1 ELSE 2 END"
)


@query(
    "m23_kmeans_step",
    f"SELECT CAST({_ASSIGN} AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"{rd(f'avg({c})')} AS {c}" for c in DIMENSIONS)
    + f" FROM ({F7}) t GROUP BY 1",
)
def m23b(spark, sf):
    fitted = cluster.Centers(DIMENSIONS, centers=CENTERS)
    return rounded(cluster.update_centers(embeddings(spark, sf), fitted))


def _reach(eps: float, least: int, label: str) -> str:
    """Density clusters of the blob fixture over its distinct points."""
    return f"""
    WITH RECURSIVE p AS ({F8}),
    g AS (SELECT x, y, count(*) AS m, min(id) AS rep FROM p GROUP BY x, y),
    e AS (SELECT a.rep AS a, b.rep AS b, b.m FROM g a, g b WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= {eps}),
    core AS (SELECT a AS rep FROM e GROUP BY a HAVING sum(m) >= {least}),
    r(node, root) AS (SELECT rep, rep FROM core UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node JOIN core ON core.rep = e.b),
    c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
    k AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM c) q),
    l AS (SELECT c.node AS rep, k.cluster FROM c JOIN k ON k.root = c.root
          UNION ALL SELECT e.a, min(k.cluster) FROM e JOIN c ON c.node = e.b JOIN k ON k.root = c.root
          WHERE e.a NOT IN (SELECT rep FROM core) GROUP BY e.a)
    SELECT p.id, CAST(coalesce(l.cluster, -1) AS BIGINT) AS {label} FROM p JOIN g ON g.x = p.x AND g.y = p.y LEFT JOIN l ON l.rep = g.rep"""


@query("m24_dbscan", _reach(0.11, 17, "cluster"))
def m24(spark, sf):
    return rounded(density.dbscan(rows(spark, sf, F8), "id", ["x", "y"], 0.11, 17))


@query("m25_mixture_full")
def m25(spark, sf):
    frame = embeddings(spark, sf)
    return cluster.fit_mixture(frame, DIMENSIONS[:4], 3, "full", max_iter=30).predict(frame).drop("label", *DIMENSIONS)


@query("m25_mixture_diagonal")
def m25b(spark, sf):
    frame = embeddings(spark, sf)
    return cluster.fit_mixture(frame, DIMENSIONS[:4], 3, "diag", max_iter=15).predict(frame).drop("label", *DIMENSIONS)


# at distance 7 the three blobs and the row of isolated points are the four parts
@query("m26_single_linkage", _reach(7, 1, "cluster"))
def m26(spark, sf):
    return rounded(cluster.hierarchical(rows(spark, sf, F8), "id", ["x", "y"], 4, "single"))


@query("m26_ward_bisecting")
def m26b(spark, sf):
    return cluster.hierarchical(embeddings(spark, sf), "vec_id", DIMENSIONS, 3, "ward")


@query("m27_spectral")
def m27(spark, sf):
    return cluster.spectral(embeddings(spark, sf), "vec_id", DIMENSIONS, 3, max_iter=10)


_COV = f"WITH p AS ({F5}), m AS (SELECT var_samp(x1) AS a, covar_samp(x1, x2) AS b, var_samp(x2) AS c, avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM p)," \
    " q AS (SELECT *, (a + c + sqrt(power(a - c, 2) + 4 * b * b)) / 2 AS l1, (a + c - sqrt(power(a - c, 2) + 4 * b * b)) / 2 AS l2 FROM m)"


@query(
    "m28_pca_projection",
    # x2 has the larger variance, so its loading is the largest and made positive
    f"{_COV}, v AS (SELECT b / sqrt(b * b + power(l1 - a, 2)) AS v1, (l1 - a) / sqrt(b * b + power(l1 - a, 2)) AS v2, m1, m2 FROM q)"
    f" SELECT id, {rd('(x1 - m1) * v1 * sign(v2) + (x2 - m2) * abs(v2)', 5)} AS pc1 FROM p, v",
)
def m28(spark, sf):
    frame = rows(spark, sf, F5)
    return rounded(decomposition.fit_pca(frame, ["x1", "x2"], 2).transform(frame).select("id", "pc1"), 5)


@query(
    "v29_explained_variance",
    f"{_COV} SELECT CAST(1 AS BIGINT) AS component, {rd('l1 / (l1 + l2)')} AS variance_ratio, {rd('l1 / (l1 + l2)')} AS cumulative_variance, {rd('sqrt(l1 * (n - 1))', 4)} AS singular_value FROM q"
    f" UNION ALL SELECT 2, {rd('l2 / (l1 + l2)')}, CAST(1 AS DOUBLE), {rd('sqrt(l2 * (n - 1))', 4)} FROM q",
)
def v29(spark, sf):
    frame = rows(spark, sf, F5)
    table = rounded(dm.variance_explained(decomposition.fit_pca(frame, ["x1", "x2"], 2), spark))
    return table.withColumn("singular_value", F.round("singular_value", 4))


@query("v30_reconstruction_error")
def v30(spark, sf):
    frame = embeddings(spark, sf)
    return dm.reconstruction_error(frame, decomposition.fit_pca(frame, DIMENSIONS, 3))


@query("v30_reconstruction_histogram")
def v30b(spark, sf):
    frame = embeddings(spark, sf)
    return dm.reconstruction_histogram(frame, decomposition.fit_pca(frame, DIMENSIONS, 3))


@query("v32_component_loadings")
def v32(spark, sf):
    return dm.component_loadings(decomposition.fit_pca(embeddings(spark, sf), DIMENSIONS, 3), spark)


@query(
    "m29_discriminant",
    f"""WITH p AS ({F4}), g AS (SELECT label, count(*) AS n, avg(acctbal) AS a, avg(n_orders) AS b, var_pop(acctbal) AS va, covar_pop(acctbal, n_orders) AS vab,
      var_pop(n_orders) AS vb FROM p GROUP BY label),
    s AS (SELECT sum(n * va) / (sum(n) - 2) AS aa, sum(n * vab) / (sum(n) - 2) AS ab, sum(n * vb) / (sum(n) - 2) AS bb,
      sum(CASE label WHEN 1 THEN a ELSE -a END) AS da, sum(CASE label WHEN 1 THEN b ELSE -b END) AS db FROM g),
    w AS (SELECT (bb * da - ab * db) / (aa * bb - ab * ab) AS wa, (aa * db - ab * da) / (aa * bb - ab * ab) AS wb, aa, ab, bb FROM s),
    u AS (SELECT wa / sqrt(wa * wa * aa + 2 * wa * wb * ab + wb * wb * bb) AS wa, wb / sqrt(wa * wa * aa + 2 * wa * wb * ab + wb * wb * bb) AS wb FROM w),
    t AS (SELECT wa * f AS wa, wb * f AS wb FROM (SELECT *, CASE WHEN abs(wa) > abs(wb) THEN sign(wa) ELSE sign(wb) END AS f FROM u) z)
    SELECT id, {rd('(acctbal - (SELECT avg(acctbal) FROM p)) * wa + (n_orders - (SELECT avg(n_orders) FROM p)) * wb')} AS ld1 FROM p, t""",
)
def m29(spark, sf):
    frame = rows(spark, sf, F4)
    return rounded(decomposition.fit_discriminant(frame, ["acctbal", "n_orders"], "label").transform(frame).select("id", "ld1"))


@query("m29_discriminant_shrunk")
def m29b(spark, sf):
    frame = embeddings(spark, sf)
    fitted = decomposition.fit_discriminant(frame, DIMENSIONS, "label", 2, shrinkage="auto")
    return fitted.transform(frame).select("vec_id", "label", "ld1", "ld2")


@query(
    "v30_reconstruction_two_features",
    f"{_COV} " + union([
        f"SELECT '{n}' AS metric, {rd(e, 5)} AS value FROM q" for n, e in [
            ("reconstruction_error", "l2 * (n - 1) / n / 2"), ("reconstruction_rmse", "sqrt(l2 * (n - 1) / n / 2)"), ("mean_error", "l2 * (n - 1) / n"),
        ]
    ]),
)
def v30c(spark, sf):
    frame = rows(spark, sf, F5)
    return rounded(dm.reconstruction_error(frame, decomposition.fit_pca(frame, ["x1", "x2"], 1)), 5)


@query(
    "v32_loadings_two_features",
    f"{_COV}, v AS (SELECT b / sqrt(b * b + power(l1 - a, 2)) AS v1, (l1 - a) / sqrt(b * b + power(l1 - a, 2)) AS v2 FROM q)"
    f" SELECT CAST(1 AS BIGINT) AS component, 'x1' AS feature, {rd('v1 * sign(v2)')} AS loading FROM v UNION ALL SELECT 1, 'x2', {rd('abs(v2)')} FROM v",
)
def v32b(spark, sf):
    return rounded(dm.component_loadings(decomposition.fit_pca(rows(spark, sf, F5), ["x1", "x2"], 1), spark))


@query("m30_perplexity_graph")
def m30(spark, sf):
    return graphs.perplexity_graph(embeddings(spark, sf), "vec_id", DIMENSIONS, 10.0)


@query("m31_fuzzy_graph")
def m31(spark, sf):
    return graphs.fuzzy_graph(embeddings(spark, sf), "vec_id", DIMENSIONS, 15)


_PAIR = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DIMENSIONS)


@query(
    "m32_neighbor_join",
    f"""WITH p AS ({F7}), d AS (SELECT a.vec_id AS left_key, b.vec_id AS right_key, sqrt({_PAIR}) AS distance FROM p a, p b WHERE a.vec_id <> b.vec_id)
    SELECT left_key, right_key, {rd('distance')} AS distance, CAST(r AS BIGINT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY distance, right_key) AS r FROM d) q WHERE r <= 5""",
)
def m32(spark, sf):
    frame = embeddings(spark, sf)
    return rounded(neighbor_join(frame, frame, "vec_id", DIMENSIONS, 5, exclude_self=True))


@query(
    "m32_neighbor_join_cells",
    f"""WITH p AS ({F7}), d AS (SELECT a.vec_id AS left_key, b.vec_id AS right_key, abs(a.e1 - b.e1) + abs(a.e2 - b.e2) + abs(a.e3 - b.e3) AS distance
      FROM p a, p b WHERE a.vec_id <> b.vec_id)
    SELECT left_key, right_key, {rd('distance')} AS distance, CAST(r AS BIGINT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY distance, right_key) AS r FROM d) q WHERE r <= 3""",
)
def m32b(spark, sf):
    # no broadcast allowed: the pruned cell join answers
    frame = embeddings(spark, sf)
    return rounded(neighbor_join(frame, frame, "vec_id", DIMENSIONS[:3], 3, "manhattan", True, small_values=0))


_GAPS = " ".join(f"- 0.5 * ln(2 * pi() * v{i}) - power(x{i} - m{i}, 2) / (2 * v{i})" for i in (1, 2, 3))


@query(
    "m9_many_classes",
    f"""WITH p AS ({F5}), t AS (SELECT id, x1, x2, y AS x3, id % 1200 AS c FROM p),
    g AS (SELECT 0.01 * greatest(var_pop(x1), var_pop(x2), var_pop(x3)) AS extra FROM t),
    k AS (SELECT c, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM t)) AS prior,
      {", ".join(f"avg(x{i}) AS m{i}, var_pop(x{i}) + (SELECT extra FROM g) AS v{i}" for i in (1, 2, 3))} FROM t GROUP BY c),
    s AS (SELECT t.id, k.c, prior {_GAPS} AS l FROM t, k)
    SELECT id, arg_max(c, l) AS prediction FROM s GROUP BY id""",
)
def m9c(spark, sf):
    """Over a thousand classes: probabilities are one array, names come from a table."""
    frame = rows(spark, sf, F5).withColumn("c", F.col("id") % 1200)
    model = bayes.fit_naive_bayes(frame, ["x1", "x2", "y"], "c", var_smoothing=0.01)
    return rounded(model.predict(frame).select("id", "prediction"))


@query("m10_many_classes", f"SELECT id, 'part ' || id AS prediction FROM ({F5}) t")
def m10c(spark, sf):
    """As many classes as rows; with one neighbour every row finds its own."""
    frame = rows(spark, sf, F5).withColumn("name", F.concat(F.lit("part "), "id")).withColumn("x3", F.col("id").cast("double"))
    model = nearest.fit_nearest(frame, ["x1", "x2", "x3"], "name", "id", n_neighbors=1, weights="distance")
    return model.predict(frame).select("id", "prediction")


@query(
    "m31_projected_rows",
    f"SELECT vec_id AS src, CAST(15 AS BIGINT) AS n, {rd('log2(15)', 3)} AS total FROM embeddings WHERE vec_id % 2 = 1",
)
def m31b(spark, sf):
    """New vectors placed on the graph of kept ones: k weights each, which sum to log2(k)."""
    frame = table(spark, sf, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    )
    model = graphs.fit_fuzzy_projection(frame.where("vec_id % 2 = 0"), "vec_id", [f"e{i}" for i in range(64)], 15)
    edges = model.project(frame.where("vec_id % 2 = 1"))
    return rounded(edges.groupBy("src").agg(F.count("*").alias("n"), F.sum("w").alias("total")), 3)
