"""Metrics and chart tables over given predictions, labels and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators.metrics import classification as cm
from tabloom.operators.metrics import clustering as km
from tabloom.operators.metrics import reduction as dm
from tabloom.operators.metrics import regression as rm

from .base import DIMENSIONS, F6, F7, F8, duck_hash, embeddings, query, rd, rounded, rows, union

P = f"WITH p AS ({F6})"


def _metrics(pairs: list[tuple[str, str]], source: str) -> str:
    return union([f"SELECT '{n}' AS metric, {rd(e)} AS value FROM {source}" for n, e in pairs])


_BINARY = (
    "(SELECT sum(y_true * y_pred)::DOUBLE AS tp, sum((1 - y_true) * y_pred) AS fp, sum(y_true * (1 - y_pred)) AS fn,"
    " avg((y_true = y_pred)::INT) AS acc, count(DISTINCT y_true) AS k FROM p) q"
)


@query(
    "v1_binary_metrics",
    f"{P} " + _metrics([
        ("accuracy", "acc"), ("precision", "coalesce(tp / nullif(tp + fp, 0), 0)"), ("recall", "coalesce(tp / nullif(tp + fn, 0), 0)"),
        ("f1_score", "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"), ("num_classes", "k"),
    ], _BINARY),
)
def v1(spark, sf):
    return rounded(cm.classification_metrics(rows(spark, sf, F6), "y_true", "y_pred"))


_PER_CLASS = """
(SELECT sum(s * pr) / sum(s) AS pr, sum(s * re) / sum(s) AS re, sum(s * f) / sum(s) AS f, sum(h)::DOUBLE / sum(s) AS acc, count(*) AS k FROM (
  SELECT c, s, h, coalesce(h::DOUBLE / nullif(n, 0), 0) AS pr, coalesce(h::DOUBLE / nullif(s, 0), 0) AS re,
         coalesce(2.0 * h / nullif(s + n, 0), 0) AS f FROM (
    SELECT c, (SELECT count(*) FROM p WHERE c_true = c) AS s, (SELECT count(*) FROM p WHERE c_pred = c) AS n,
           (SELECT count(*) FROM p WHERE c_true = c AND c_pred = c) AS h FROM (SELECT DISTINCT c_true AS c FROM p) l) m) w) q
"""


@query(
    "v1_weighted_metrics",
    f"{P} " + _metrics([("accuracy", "acc"), ("precision", "pr"), ("recall", "re"), ("f1_score", "f"), ("num_classes", "k")], _PER_CLASS),
)
def v1b(spark, sf):
    return rounded(cm.classification_metrics(rows(spark, sf, F6), "c_true", "c_pred"))


_AUC = """SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, sum(pos) AS w FROM (
  SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {score} AS score, sum(({hit})::INT)::DOUBLE AS pos, sum((NOT ({hit}))::INT)::DOUBLE AS neg FROM p GROUP BY 1) g) h"""


@query("v2_binary_auc", f"{P} SELECT 'roc_auc' AS metric, {rd('auc')} AS value FROM (" + _AUC.format(score="score", hit="y_true = 1") + ") q")
def v2(spark, sf):
    return rounded(cm.roc_auc(rows(spark, sf, F6), "y_true", {1: "score"}))


# one score per class from the fixture: the class's own share of a hashed mark
THREE = f"SELECT id, c_true, (CAST(((id * (7 + 2 * 0)) % 89) AS DOUBLE) + CASE WHEN c_pred = 0 THEN 40 ELSE 0 END) / 130 AS s0," \
    f" (CAST(((id * (7 + 2 * 1)) % 89) AS DOUBLE) + CASE WHEN c_pred = 1 THEN 40 ELSE 0 END) / 130 AS s1," \
    f" (CAST(((id * (7 + 2 * 2)) % 89) AS DOUBLE) + CASE WHEN c_pred = 2 THEN 40 ELSE 0 END) / 130 AS s2 FROM ({F6}) f"
P3 = f"WITH p AS ({THREE})"


@query(
    "v2_multiclass_auc",
    f"{P3} SELECT 'roc_auc' AS metric, {rd('sum(auc * w) / sum(w)')} AS value FROM ("
    + union([_AUC.format(score=f"s{c}", hit=f"c_true = {c}") for c in range(3)]) + ") q",
)
def v2b(spark, sf):
    return rounded(cm.roc_auc(rows(spark, sf, THREE), "c_true", {c: f"s{c}" for c in range(3)}))


@query("v3_class_distribution", f'{P} SELECT CAST(c_true AS BIGINT) AS "class", CAST(count(*) AS BIGINT) AS n FROM p GROUP BY c_true')
def v3(spark, sf):
    return rounded(cm.class_distribution(rows(spark, sf, F6), "c_true"))


@query(
    "v4_confusion_matrix",
    f"{P}, l AS (SELECT DISTINCT c_true AS c FROM p UNION SELECT DISTINCT c_pred FROM p) SELECT CAST(a.c AS BIGINT) AS actual, CAST(b.c AS BIGINT) AS predicted,"
    " CAST((SELECT count(*) FROM p WHERE c_true = a.c AND c_pred = b.c) AS BIGINT) AS n FROM l a, l b",
)
def v4(spark, sf):
    return rounded(cm.confusion_matrix(rows(spark, sf, F6), "c_true", "c_pred"))


def _curve(score: str, hit: str, label: str, columns: str, last: str) -> str:
    return f"""
    SELECT {label} AS "class", score AS threshold, {columns} FROM (
      SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM (
        SELECT {score} AS score, sum(({hit})::INT)::DOUBLE AS pos, sum((NOT ({hit}))::INT)::DOUBLE AS neg FROM p GROUP BY 1) g) h
    UNION ALL SELECT {label}, NULL, {last}"""


ROC = f"{rd('fp / nn')} AS fpr, {rd('tp / np')} AS tpr"
PR = f"{rd('tp / (tp + fp)')} AS precision, {rd('tp / np')} AS recall"


@query("v5_roc_curve", f"{P} " + _curve("score", "y_true = 1", "CAST(1 AS BIGINT)", ROC, "CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)"))
def v5(spark, sf):
    return rounded(cm.roc_points(rows(spark, sf, F6), "y_true", {1: "score"}))


@query("v6_precision_recall_curve", f"{P} " + _curve("score", "y_true = 1", "CAST(1 AS BIGINT)", PR, "CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)"))
def v6(spark, sf):
    return rounded(cm.precision_recall_points(rows(spark, sf, F6), "y_true", {1: "score"}))


@query(
    "v7_multiclass_roc",
    f"{P3} " + union([_curve(rd(f"s{c}", 9), f"c_true = {c}", f"CAST({c} AS BIGINT)", ROC, "CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)") for c in range(3)]),
)
def v7(spark, sf):
    frame = rows(spark, sf, THREE)
    frame = frame.select("id", "c_true", *[F.round(f"s{c}", 9).alias(f"s{c}") for c in range(3)])
    points = cm.roc_points(frame, "c_true", {c: f"s{c}" for c in range(3)})
    return points.select(
        F.col("class").cast("bigint").alias("class"), "threshold", (F.round("fpr", 6) + 0.0).alias("fpr"), (F.round("tpr", 6) + 0.0).alias("tpr")
    )


@query("v8_probability_sample", f"{P} SELECT id, score, CAST(y_pred AS BIGINT) AS y_pred, CAST(y_true AS BIGINT) AS y_true FROM p ORDER BY id LIMIT 100")
def v8(spark, sf):
    return rounded(cm.probability_sample(rows(spark, sf, F6), "id", ["score", "y_pred", "y_true"]))


@query("v9_predicted_distribution", f'{P} SELECT CAST(c_pred AS BIGINT) AS "class", CAST(count(*) AS BIGINT) AS n FROM p GROUP BY c_pred')
def v9(spark, sf):
    return rounded(cm.class_distribution(rows(spark, sf, F6), "c_pred"))


@query(
    "v10_error_summary",
    f"{P} " + _metrics([("total_errors", "sum((y_true <> y_pred)::INT)"), ("error_rate", "avg((y_true <> y_pred)::INT)")], "p"),
)
def v10(spark, sf):
    return rounded(cm.error_summary(rows(spark, sf, F6), "y_true", "y_pred"))


@query(
    "v10_error_pairs",
    f"{P} SELECT CAST(c_true AS BIGINT) AS actual, CAST(c_pred AS BIGINT) AS predicted, CAST(count(*) AS BIGINT) AS n FROM p WHERE c_true <> c_pred GROUP BY 1, 2",
)
def v10b(spark, sf):
    return rounded(cm.error_pairs(rows(spark, sf, F6), "c_true", "c_pred"))


@query(
    "v11_regression_metrics",
    f"{P} " + _metrics([
        ("mse", "avg(power(r_true - r_pred, 2))"), ("rmse", "sqrt(avg(power(r_true - r_pred, 2)))"), ("mae", "avg(abs(r_true - r_pred))"),
        ("r2", "1 - avg(power(r_true - r_pred, 2)) / var_pop(r_true)"),
        ("explained_variance", "1 - var_pop(r_true - r_pred) / var_pop(r_true)"),
    ], "p") + f" UNION ALL SELECT 'mape', {rd('avg(abs(r_true - r_pred) / greatest(abs(r_true), 2.220446049250313e-16))', 4)} FROM p",
)
def v11(spark, sf):
    found = rm.regression_metrics(rows(spark, sf, F6), "r_true", "r_pred")
    digits = F.when(F.col("metric") == "mape", F.round("value", 4)).otherwise(F.round("value", 6))
    return found.select("metric", (digits + 0.0).alias("value"))


@query(
    "v12_value_statistics",
    f"{P} " + union([
        f"SELECT '{n}' AS series, {rd(f'avg({e})')} AS mean, {rd(f'stddev_pop({e})')} AS std, {rd(f'min({e})')} AS min, {rd(f'max({e})')} AS max FROM p"
        for n, e in [("residual", "r_true - r_pred"), ("prediction", "r_pred"), ("actual", "r_true")]
    ]),
)
def v12(spark, sf):
    return rounded(rm.value_statistics(rows(spark, sf, F6), "r_true", "r_pred"))


_SAMPLE = f"ORDER BY {duck_hash('CAST(id AS VARCHAR)')}, id LIMIT 1000"


@query("v13_prediction_sample", f"{P} SELECT id, {rd('r_true')} AS actual, {rd('r_pred')} AS predicted FROM p {_SAMPLE}")
def v13(spark, sf):
    return rounded(rm.prediction_sample(rows(spark, sf, F6), "id", "r_true", "r_pred"))


@query("v13_diagonal", f"{P} SELECT {rd('min(r_true)')} AS line_start, {rd('max(r_true)')} AS line_end FROM p")
def v13b(spark, sf):
    return rounded(rm.diagonal(rows(spark, sf, F6), "r_true"))


@query("v14_residual_sample", f"{P} SELECT id, {rd('r_pred')} AS predicted, {rd('r_true - r_pred')} AS residual FROM p {_SAMPLE}")
def v14(spark, sf):
    return rounded(rm.residual_sample(rows(spark, sf, F6), "id", "r_true", "r_pred"))


def _histogram(series: str, expression: str, source: str = "p", where: str = "true", bins: int = 30) -> str:
    return f"""
    SELECT '{series}' AS series, CAST(b AS BIGINT) AS bin, {rd(f'lo + (hi - lo) * (b - 1) / {bins}')} AS bin_start,
           {rd(f'lo + (hi - lo) * b / {bins}')} AS bin_end,
           CAST((SELECT count(*) FROM (SELECT {expression} AS v FROM {source}) x WHERE {where}
             AND least(floor(CAST({bins} AS DOUBLE) * (v - lo) / (hi - lo)) + 1, {bins}) = b) AS BIGINT) AS n
    FROM (SELECT min({expression}) AS lo, max({expression}) AS hi FROM {source}) e, range(1, {bins + 1}) r(b) WHERE {where}"""


@query("v15_residual_histogram", f"{P} " + _histogram("residual", "r_true - r_pred"))
def v15(spark, sf):
    return rounded(rm.residual_histogram(rows(spark, sf, F6), "r_true", "r_pred"))


@query("v16_error_histogram", f"{P} " + _histogram("abs_error", "abs(r_true - r_pred)"))
def v16(spark, sf):
    return rounded(rm.error_histogram(rows(spark, sf, F6), "r_true", "r_pred"))


@query(
    "v16_error_center",
    f"{P}, z AS (SELECT bool_or(r_true = 0) AS z FROM p) " + _metrics([
        ("residual_mean", "avg(r_true - r_pred)"), ("residual_std", "stddev_pop(r_true - r_pred)"), ("mean_error", "avg(abs(r_true - r_pred))"),
        ("median_error", "median(abs(r_true - r_pred))"),
        ("mean_pct_error", "CASE WHEN (SELECT z FROM z) THEN NULL ELSE avg((r_true - r_pred) / nullif(r_true, 0) * 100) END"),
        ("median_pct_error", "CASE WHEN (SELECT z FROM z) THEN NULL ELSE median((r_true - r_pred) / nullif(r_true, 0) * 100) END"),
    ], "p"),
)
def v16b(spark, sf):
    return rounded(rm.error_center(rows(spark, sf, F6), "r_true", "r_pred"))


_RANK = "CAST(floor(CAST(i * (SELECT count(*) - 1 FROM p) AS DOUBLE) / 99) AS BIGINT)"


@query(
    "v17_quantile_pairs",
    f"{P}, s AS (SELECT r_true - r_pred AS r, row_number() OVER (ORDER BY r_true - r_pred) - 1 AS k FROM p)"
    f" SELECT CAST(i AS BIGINT) AS point, {rd('r')} AS sample FROM range(0, 100) g(i) JOIN s ON s.k = {_RANK}",
)
def v17(spark, sf):
    return rounded(rm.quantile_pairs(rows(spark, sf, F6), "r_true", "r_pred").select("point", "sample"))


# shifted by one so that no true value is zero
SHIFTED = f"SELECT id, r_true + 1 AS t, r_pred + 1 AS q FROM ({F6}) f"


@query("v18_percentage_histogram", f"WITH p AS ({SHIFTED}) " + _histogram("pct_error", "(t - q) / nullif(t, 0) * 100"))
def v18(spark, sf):
    return rounded(rm.percentage_histogram(rows(spark, sf, SHIFTED), "t", "q"))


@query(
    "v19_interval_analysis",
    f"""{P}, e AS (SELECT min(r_true) AS lo, max(r_true) AS hi FROM p),
    b AS (SELECT floor(CAST(10 AS DOUBLE) * (r_true - lo) / (hi - lo)) AS bin, r_true AS y, r_true - r_pred AS r, lo, hi FROM p, e)
    SELECT CAST(bin AS BIGINT) AS bin, {rd('max(lo) + bin * (max(hi) - max(lo)) / 10')} AS bin_start,
           {rd('max(lo) + (bin + 1) * (max(hi) - max(lo)) / 10')} AS bin_end, CAST(count(*) AS BIGINT) AS n, {rd('avg(abs(r))')} AS mae,
           CASE WHEN count(*) > 1 THEN CASE WHEN var_pop(y) > 0 THEN {rd('1 - avg(r * r) / var_pop(y)', 4)} WHEN avg(r * r) > 0 THEN 0 ELSE 1 END END AS r2
    FROM b WHERE bin < 10 GROUP BY bin""",
)
def v19(spark, sf):
    found = rm.interval_analysis(rows(spark, sf, F6), "r_true", "r_pred")
    return rounded(rounded(found).withColumn("r2", F.round("r2", 4)))


E = f"WITH p AS ({F7})"
_DIST = "sqrt(" + " + ".join(f"power(a.{c} - b.{c}, 2)" for c in DIMENSIONS) + ")"
_SILHOUETTE = f"""{E}, d AS (SELECT a.vec_id, a.label, b.label AS other, sum({_DIST}) AS total, count(*) AS m FROM p a, p b GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(CASE WHEN label = other AND m > 1 THEN total / (m - 1) END) AS a, min(CASE WHEN label <> other THEN total / m END) AS b
      FROM d GROUP BY 1, 2),
v AS (SELECT vec_id, label, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM s)"""


@query("v20_silhouette_samples", f"{_SILHOUETTE} SELECT vec_id, CAST(label AS BIGINT) AS label, {rd('s')} AS silhouette FROM v")
def v20(spark, sf):
    return rounded(km.silhouette_samples(embeddings(spark, sf), "vec_id", DIMENSIONS, "label"))


@query("v20_silhouette_score", f"{_SILHOUETTE} " + _metrics([("silhouette_score", "avg(s)"), ("avg_score", "avg(s)")], "v"))
def v20b(spark, sf):
    return rounded(km.silhouette_score(embeddings(spark, sf), "vec_id", DIMENSIONS, "label"))


_SQUARED = _SILHOUETTE.replace(_DIST, _DIST[len("sqrt"):])


@query("v20_silhouette_squared", f"{_SQUARED} SELECT vec_id, CAST(label AS BIGINT) AS label, {rd('s')} AS silhouette FROM v")
def v20c(spark, sf):
    return rounded(km.silhouette_samples(embeddings(spark, sf), "vec_id", DIMENSIONS, "label", "squared"))


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in DIMENSIONS)
_CENTERS = f"{E}, c AS (SELECT label, count(*) AS n, {_MEANS} FROM p GROUP BY label)"


@query(
    "v21_davies_bouldin",
    f"{_CENTERS}, s AS (SELECT a.label, avg({_DIST}) AS s FROM p a JOIN c b ON a.label = b.label GROUP BY a.label),"
    f" w AS (SELECT a.label, max((sa.s + sb.s) / {_DIST}) AS w FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label"
    f" JOIN s sb ON sb.label = b.label GROUP BY a.label) SELECT 'davies_bouldin_score' AS metric, {rd('avg(w)')} AS value FROM w",
)
def v21(spark, sf):
    return rounded(km.davies_bouldin(embeddings(spark, sf), DIMENSIONS, "label"))


_BETWEEN = " + ".join(f"power({c} - (SELECT avg({c}) FROM p), 2)" for c in DIMENSIONS)
_WITHIN = " + ".join(f"var_pop({c})" for c in DIMENSIONS)


@query(
    "v22_calinski_harabasz",
    f"{_CENTERS}, w AS (SELECT sum(n * v) AS w, sum(n) AS n, count(*) AS k FROM (SELECT label, count(*) AS n, {_WITHIN} AS v FROM p GROUP BY label) q),"
    f" b AS (SELECT sum(n * ({_BETWEEN})) AS b FROM c) SELECT 'calinski_harabasz_score' AS metric, {rd('b * (n - k) / (w * (k - 1))')} AS value FROM w, b",
)
def v22(spark, sf):
    return rounded(km.calinski_harabasz(embeddings(spark, sf), DIMENSIONS, "label"))


B = f"WITH p AS ({F8})"


@query("v23_cluster_sizes", f"{B} SELECT CAST(blob AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY blob")
def v23(spark, sf):
    return rounded(km.cluster_sizes(rows(spark, sf, F8), "blob"))


@query("v23_cluster_counts", f"{B} " + _metrics([("n_clusters", "count(DISTINCT blob)"), ("n_noise_points", "sum((blob = -1)::INT)")], "p"))
def v23b(spark, sf):
    return rounded(km.cluster_counts(rows(spark, sf, F8), "blob"))


@query(
    "v24_intra_cluster_distances",
    f"{B}, c AS (SELECT blob, avg(x) AS x, avg(y) AS y FROM p WHERE blob <> -1 GROUP BY blob), d AS (SELECT p.blob, sqrt(power(p.x - c.x, 2) + power(p.y - c.y, 2)) AS d"
    f" FROM p JOIN c ON c.blob = p.blob) SELECT CAST(blob AS BIGINT) AS cluster, {rd('avg(d)')} AS mean, {rd('stddev_pop(d)')} AS std, {rd('min(d)')} AS min,"
    f" {rd('max(d)')} AS max FROM d GROUP BY blob HAVING count(*) > 1",
)
def v24(spark, sf):
    return rounded(km.intra_cluster_distances(rows(spark, sf, F8), ["x", "y"], "blob"))


@query("v25_cluster_centers", f"{E} " + union([f"SELECT CAST(label AS BIGINT) AS cluster, '{c}' AS feature, {rd(f'avg({c})')} AS center FROM p GROUP BY label" for c in DIMENSIONS]))
def v25(spark, sf):
    return rounded(km.cluster_centers(embeddings(spark, sf), DIMENSIONS, "label"))


@query("v25_inter_center_distances", f"{_CENTERS} SELECT CAST(a.label AS BIGINT) AS cluster, CAST(b.label AS BIGINT) AS other, {rd(_DIST)} AS distance FROM c a, c b")
def v25b(spark, sf):
    return rounded(km.inter_center_distances(embeddings(spark, sf), DIMENSIONS, "label"))


@query("v26_projection_sample")
def v26(spark, sf):
    return km.projection_sample(embeddings(spark, sf), "vec_id", DIMENSIONS, "label")


@query(
    "v26_plane_sample",
    f"{B} SELECT id, {rd('x')} AS x, {rd('y')} AS y, CAST(blob AS BIGINT) AS blob FROM p ORDER BY {duck_hash('CAST(id AS VARCHAR)')}, id LIMIT 1000",
)
def v26c(spark, sf):
    return rounded(km.projection_sample(rows(spark, sf, F8), "id", ["x", "y"], "blob"))


@query("v26_plane_centers", f"{B} SELECT CAST(blob AS BIGINT) AS cluster, {rd('avg(x)')} AS x, {rd('avg(y)')} AS y FROM p GROUP BY blob")
def v26d(spark, sf):
    return rounded(km.projected_centers(rows(spark, sf, F8), ["x", "y"], "blob"))


@query("v26_projected_centers")
def v26b(spark, sf):
    return km.projected_centers(embeddings(spark, sf), DIMENSIONS, "label")


@query(
    "v27_cluster_feature_statistics",
    f"{E} " + union([
        f"SELECT CAST(label AS BIGINT) AS cluster, '{c}' AS feature, {rd(f'avg({c})')} AS mean, {rd(f'stddev_pop({c})')} AS std, {rd(f'min({c})')} AS min, {rd(f'max({c})')} AS max FROM p GROUP BY label"
        for c in DIMENSIONS
    ]),
)
def v27(spark, sf):
    return rounded(km.cluster_feature_statistics(embeddings(spark, sf), DIMENSIONS, "label"))


REDUCED = DIMENSIONS[:3]


@query(
    "v28_reduction_summary",
    f"{E} " + _metrics([("original_dimensions", "count(*) * 0 + 8"), ("reduced_dimensions", "count(*) * 0 + 3"), ("dimension_reduction_ratio", "count(*) * 0 + 3 / 8.0"), ("n_samples", "count(*)")], "p"),
)
def v28(spark, sf):
    return rounded(dm.reduction_summary(embeddings(spark, sf), DIMENSIONS, REDUCED))


@query(
    "v28_component_statistics",
    f"{E} " + union([f"SELECT '{c}' AS component, {rd(f'avg({c})')} AS mean, {rd(f'stddev_pop({c})')} AS std, {rd(f'min({c})')} AS min, {rd(f'max({c})')} AS max FROM p" for c in REDUCED]),
)
def v28b(spark, sf):
    return rounded(dm.component_statistics(embeddings(spark, sf), REDUCED))


@query(
    "v31_scatter",
    f"{E} SELECT vec_id, {rd('e1')} AS x, {rd('e2')} AS y, CAST(0 AS DOUBLE) AS z FROM p ORDER BY {duck_hash('CAST(vec_id AS VARCHAR)')}, vec_id LIMIT 1000",
)
def v31(spark, sf):
    return rounded(dm.scatter(embeddings(spark, sf), "vec_id", DIMENSIONS[:2]))


@query("v33_component_histograms", f"{E} " + union([_histogram(c, c) for c in DIMENSIONS]))
def v33(spark, sf):
    return rounded(dm.component_histograms(embeddings(spark, sf), DIMENSIONS))


@query(
    "v34_component_correlation",
    f"{E} " + union([f"SELECT '{a}' AS component, '{b}' AS other, {rd('1' if a == b else f'corr({a}, {b})')} AS correlation FROM p" + (" HAVING count(*) > 0" if a == b else "") for a in REDUCED for b in REDUCED]),
)
def v34(spark, sf):
    return rounded(dm.component_correlation(embeddings(spark, sf), REDUCED))


@query(
    "v35_spectrum_total",
    f"{E} SELECT 'total_variance' AS metric, {rd(' + '.join(f'var_samp({c})' for c in DIMENSIONS))} AS value FROM p",
)
def v35(spark, sf):
    return rounded(dm.spectrum_totals(embeddings(spark, sf), DIMENSIONS, 2).where("metric = 'total_variance'"))


_EIGEN = (
    "(SELECT (a + c + sqrt(power(a - c, 2) + 4 * b * b)) / 2 AS l1, (a + c - sqrt(power(a - c, 2) + 4 * b * b)) / 2 AS l2"
    " FROM (SELECT var_samp(e1) AS a, covar_samp(e1, e2) AS b, var_samp(e2) AS c FROM p) m) q"
)


@query("v35_eigenvalue_spectrum", f"{E} SELECT CAST(1 AS BIGINT) AS position, {rd('l1', 8)} AS eigenvalue FROM {_EIGEN} UNION ALL SELECT 2, {rd('l2', 8)} FROM {_EIGEN}")
def v35b(spark, sf):
    return rounded(dm.eigenvalue_spectrum(embeddings(spark, sf), DIMENSIONS[:2]), 8)
