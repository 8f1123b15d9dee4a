"""Training, tuning, scoring, registry and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabloom.operators import scoring
from tabloom.operators.encoding import AutoEncoding, fit_encoder
from tabloom.operators.metrics.regression import regression_metrics
from tabloom.operators.missing import Filler, fit_filler
from tabloom.operators.models import linear
from tabloom.operators.models.catalog import feature_importance, fit_named
from tabloom.operators.scaling import Scaler, fit_scaler
from tabloom.operators.tuning import Real, Whole, bayesian_search, grid_search, random_search
from tabloom.functions.names import rename_to
from tabloom.plans import lineage
from tabloom.plans.prepare import fit_preparation
from tabloom.plans.store import Store, predict_registered
from tabloom.plans.train import run_pipeline, train_model
from tabloom.sources import files, registry
from tabloom.sources.shared import shared_folder

from .base import F1, F2, F4, F5, F8, F9, MODELS, PREDICTIONS, duck_hash, query, rd, rounded, rows, table, union

INPUTS = ["acctbal", "nation", "n_orders"]


def flagship(spark, sf):
    """Nulls filled, target-encoded, split, one linear fit, regression metrics."""
    frame = rows(spark, sf, F1).select("id", "price", "priority", "cust", F.col("y").alias("target"))
    done = train_model(
        frame, "id", "linear_regression", "target", ["price", "priority", "cust"], missing="median",
        encoding=[{"column_name": "priority", "encoding_method": "target"}], scale="standard",
    )
    return done.metrics


_SPLIT = f"CASE WHEN {duck_hash('CAST(id AS VARCHAR)')} < 3435973836.8 THEN 1 ELSE 0 END"


@query(
    "flagship_linear_metrics",
    f"""WITH t AS ({F1}), s AS (SELECT id, price, y, {_SPLIT} AS train FROM t),
    f AS (SELECT id, coalesce(price, (SELECT median(price) FROM s WHERE train = 1)) AS price, y, train FROM s),
    m AS (SELECT regr_slope(y, price) AS w, regr_intercept(y, price) AS b FROM f WHERE train = 1),
    p AS (SELECT y, b + w * price AS q FROM f, m WHERE train = 0)
    """ + union([
        f"SELECT '{n}' AS metric, {rd(e, 4)} AS value FROM p" for n, e in [
            ("mse", "avg(power(y - q, 2)) / 1e6"), ("rmse", "sqrt(avg(power(y - q, 2)))"), ("mae", "avg(abs(y - q))"),
            ("r2", "1 - avg(power(y - q, 2)) / var_pop(y)"), ("explained_variance", "1 - var_pop(y - q) / var_pop(y)"),
            ("mape", "avg(abs(y - q) / abs(y))"),
        ]
    ]),
)
def flagship_check(spark, sf):
    frame = rows(spark, sf, F1).select("id", "price", F.col("y").alias("target"))
    done = train_model(frame, "id", "linear_regression", "target", ["price"], missing="median", scale="standard")
    six = regression_metrics(done.scored, "target", "prediction")
    scale = F.when(F.col("metric") == "mse", F.col("value") / 1e6).otherwise(F.col("value"))
    return rounded(six.select("metric", scale.alias("value")), 4)


@query("t7_train_classifier")
def t7(spark, sf):
    return train_model(
        rows(spark, sf, F4).drop("label3"), "id", "random_forest_classifier", "label",
        parameters={"n_estimators": 20, "max_depth": 6}, scale="standard",
    ).metrics


@query("t7_train_regressor")
def t7b(spark, sf):
    return train_model(rows(spark, sf, F5), "id", "ridge_regression", "y", scale="standard", scale_target=True).metrics


@query("t8_feature_importance")
def t8(spark, sf):
    model = fit_named("random_forest_classifier", rows(spark, sf, F4), INPUTS, "label", "id", n_estimators=20, max_depth=6)
    return feature_importance(model, spark)


@query(
    "t8_linear_importance",
    f"WITH p AS ({F5}) SELECT 'x2' AS feature, {rd('abs(regr_slope(y, x2))')} AS importance FROM p",
)
def t8b(spark, sf):
    return rounded(feature_importance(linear.fit_linear(rows(spark, sf, F5), ["x2"], "y"), spark))


def _steps(spark, sf):
    """Fill, encode and scale fitted on the orders fixture."""
    frame = rows(spark, sf, F1)
    filler = fit_filler(frame, "mean", ["price", "priority"])
    filled = filler.apply(frame)
    coder = fit_encoder(filled, "target", "priority", "y")
    coded = coder.apply(filled)
    return frame, [filler, coder, fit_scaler(coded, "standard", ["price", "priority"])]


_MODE = "(SELECT priority FROM t WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)"
_CODED = f"""WITH t AS ({F1}), f AS (SELECT id, coalesce(price, (SELECT avg(price) FROM t)) AS price, coalesce(priority, {_MODE}) AS filled, priority AS raw, y FROM t),
c AS (SELECT filled AS k, avg(y) AS v FROM f GROUP BY filled), e AS (SELECT f.id, f.price, f.raw, c.v FROM f JOIN c ON c.k = f.filled)"""


@query(
    "r2_apply_components",
    f"{_CODED} SELECT id, {rd('(price - (SELECT avg(price) FROM e)) / (SELECT stddev_pop(price) FROM e)')} AS price,"
    f" {rd('(v - (SELECT avg(v) FROM e)) / (SELECT stddev_pop(v) FROM e)')} AS priority FROM e",
)
def r2(spark, sf):
    frame, steps = _steps(spark, sf)
    return rounded(scoring.Preparation(steps).apply(frame).select("id", "price", "priority"))


@query(
    "t9_training_order",
    # encoding comes first here, so a missing category takes the overall mean
    f"{_CODED} SELECT id, {rd('(price - (SELECT avg(price) FROM e)) / (SELECT stddev_pop(price) FROM e)')} AS price,"
    f" {rd('(CASE WHEN raw IS NULL THEN (SELECT avg(y) FROM t) ELSE v END - (SELECT avg(v) FROM e)) / (SELECT stddev_pop(v) FROM e)')} AS priority FROM e",
)
def t9(spark, sf):
    frame, steps = _steps(spark, sf)
    only_price = Filler("mean", {"price": steps[0].values["price"]})
    ordered = scoring.Preparation([only_price, *steps[1:]]).reordered([type(steps[1]), AutoEncoding, Filler, Scaler])
    return rounded(ordered.apply(frame).select("id", "price", "priority"))


@query(
    "c18_preparation_history",
    "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'fill_mean', 'price,priority'), (1, 'encode_target', 'priority'), (2, 'scale_standard', 'price,priority'))"
    " v(position, operation, columns) WHERE (SELECT count(*) FROM orders) > 0",
)
def c18(spark, sf):
    _, steps = _steps(spark, sf)
    return rounded(scoring.Preparation(steps).history(spark))


@query("h1_grid_search")
def h1(spark, sf):
    found = grid_search(
        rows(spark, sf, F4), "decision_tree_classifier", INPUTS, "label", "id", {"max_depth": [2, 4], "min_samples_leaf": [1]}, cv=3
    )
    return found.trials


@query("h2_random_search")
def h2(spark, sf):
    found = random_search(rows(spark, sf, F4), "naive_bayes", INPUTS, "label3", "id", n_iter=3, cv=3, scoring="f1")
    return found.trials


@query("h3_bayesian_search")
def h3(spark, sf):
    found = bayesian_search(
        rows(spark, sf, F5), "ridge_regression", ["x1", "x2"], "y", "id", {"alpha": Real(0.01, 1000.0), "fit_intercept": [True, False]},
        n_iter=5, cv=2, warmup=3,
    )
    return found.trials


@query("h8_tuning_history")
def h8(spark, sf):
    book = registry.Registry(spark, f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}")
    for n in (1, 2):
        found = random_search(
            rows(spark, sf, F4), "naive_bayes", INPUTS, "label", "id", {"var_smoothing": Real(1e-10, 1e-8)}, n_iter=n, cv=2
        )
        book.append("tuning", [found.history_row()])
    return registry.newest(book.table("tuning")).select("algorithm", "method", "best_parameters", "best_score", "trials")


@query(
    "r1_match_columns",
    "SELECT o_orderkey AS id, o_totalprice AS \"Total Price\", o_custkey AS \"cust_key (raw)\" FROM orders",
)
def r1(spark, sf):
    frame = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("Total_Price"), F.col("o_custkey").alias("CustKey raw")
    )
    return rename_to(frame, ["id", "Total Price", "cust_key (raw)"])


@query(
    "r3_align_columns",
    f"SELECT id, coalesce(cust, 0) AS cust, CAST(0 AS DOUBLE) AS absent, coalesce(price, 0) AS price FROM ({F1}) t",
)
def r3(spark, sf):
    return scoring.align(rows(spark, sf, F1), ["cust", "absent", "price"], ["id"])


def _bundle(spark, sf):
    return train_model(
        rows(spark, sf, F4).drop("label3"), "id", "logistic_regression", "label", scale="standard", parameters={"max_iter": 50}
    )


@query("r4_predict_probabilities")
def r4(spark, sf):
    frame = rows(spark, sf, F4).withColumnRenamed("n_orders", "N Orders")
    return _bundle(spark, sf).bundle.score(frame)


@query("s10_batch_prediction")
def s10(spark, sf):
    scored = _bundle(spark, sf).bundle.score(rows(spark, sf, F4))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    files.write_dataset(scored, path, "csv")
    return files.read_dataset(spark, path)


@query(
    "r5_inverse_prediction",
    "SELECT p_partkey AS id, p_brand AS brand, " + rd("p_retailprice") + " AS prediction FROM part",
)
def r5(spark, sf):
    frame = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("y")
    )
    scaler = fit_scaler(frame, "minmax", ["y"], role="target")
    coder = fit_encoder(frame, "label", "brand")
    scored = coder.apply(scaler.apply(frame)).withColumnRenamed("y", "prediction")
    numbers = scoring.restore(scored, "prediction", scaler, target="y")
    return rounded(scoring.restore(numbers, "brand", encoder=coder).select("id", "brand", "prediction"))


@query(
    "r6_prediction_history",
    f"SELECT id, model_id, input_dataset_id FROM ({PREDICTIONS}) p WHERE model_id = 4 ORDER BY id DESC LIMIT 50",
)
def r6(spark, sf):
    return registry.newest(rows(spark, sf, PREDICTIONS), "id", 50, model_id=4)


@query(
    "r6_prediction_summary",
    f"SELECT CAST(count(*) AS BIGINT) AS rows, {rd('avg(x2)')} AS mean, {rd('min(x2)')} AS min, {rd('max(x2)')} AS max FROM ({F5}) t",
)
def r6b(spark, sf):
    return rounded(scoring.prediction_summary(rows(spark, sf, F5).withColumn("prediction", F.col("x2"))))


_LOWER = "(SELECT quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) FROM t)"
_UPPER = "(SELECT quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) FROM t)"


@query(
    "l1_declared_run",
    f"""WITH t AS (SELECT id, type, price, size, constant FROM ({F2}) f), o AS (SELECT id, type, greatest(least(price, {_UPPER}), {_LOWER}) AS price, size, constant FROM t),
    c AS (SELECT type, count(*) AS n FROM o GROUP BY type)
    SELECT {rd('o.price')} AS price, {rd('o.size')} AS size, CAST(c.n AS DOUBLE) AS type, o.id FROM o JOIN c ON c.type = o.type""",
)
def l1(spark, sf):
    frame = rows(spark, sf, F2).select("id", "type", "price", "size", "constant")
    done = run_pipeline(spark, [
        {"step": "source", "key": "id"},
        {"step": "outliers", "method": "iqr", "action": "clip", "threshold": 1.5, "columns": ["price"]},
        {"step": "preprocess", "encoding": [{"column_name": "type", "encoding_method": "frequency"}]},
        {"step": "select", "method": "variance", "threshold": 0.0, "columns": ["price", "size", "constant"]},
    ], frame)
    return rounded(done["df"].select("price", "size", "type", "id"))


@query("l1_declared_training")
def l1b(spark, sf):
    done = run_pipeline(spark, [
        {"step": "source", "key": "id", "target": "label"},
        {"step": "preprocess", "missing": "median"},
        {"step": "tune", "method": "random", "algorithm": "decision_tree_classifier", "space": {"max_depth": Whole(2, 6)}, "n_iter": 2, "cv": 2},
        {"step": "train", "algorithm": "decision_tree_classifier", "scale": "standard"},
    ], rows(spark, sf, F4).drop("label3", "segment"))
    return done["training"].metrics


_STATUS = ["F", "O", "P"]


@query(
    "l2_preparation_bundle",
    f"""WITH t AS (SELECT id, status, price, cust, y FROM ({F1}) f), m AS (SELECT id, status, coalesce(price, (SELECT median(price) FROM t)) AS price,
      coalesce(cust, (SELECT median(cust) FROM t)) AS cust, y FROM t)
    SELECT id, """ + ", ".join(f"CASE WHEN status = '{s}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"status_{s}\"" for s in _STATUS)
    + ", " + ", ".join(rd(f"({c} - (SELECT min({c}) FROM m)) / ((SELECT max({c}) FROM m) - (SELECT min({c}) FROM m))") + f" AS {c}" for c in ("price", "cust"))
    + ", y FROM m",
)
def l2(spark, sf):
    frame = rows(spark, sf, F1).select("id", "status", "price", "cust", "y")
    return rounded(fit_preparation(frame, "id", "y", missing="median", scale="minmax").df)


@query(
    "l4_lineage_roots",
    f"SELECT CAST(id AS BIGINT) AS id, CAST(id - id % 5 AS BIGINT) AS root, CAST(id % 5 AS BIGINT) AS depth FROM ({F9}) t",
)
def l4(spark, sf):
    return rounded(lineage.lineage_roots(rows(spark, sf, F9)))


@query(
    "l4_inherited_components",
    f"""WITH RECURSIVE d AS ({F9}), path(id, up, depth) AS (SELECT id, source_dataset_id, 0 FROM d WHERE id = 14
      UNION ALL SELECT d.id, d.source_dataset_id, path.depth + 1 FROM d JOIN path ON d.id = path.up)
    SELECT CAST(path.id AS BIGINT) AS dataset_id, c.c_custkey AS position, CAST(path.depth AS BIGINT) AS depth
    FROM path JOIN customer c ON c.c_nationkey = path.id""",
)
def l4b(spark, sf):
    path = lineage.lineage_path(rows(spark, sf, F9), 14)
    steps = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset_id"), F.col("c_custkey").alias("position"))
    return rounded(lineage.inherited_components(path, steps)).select("dataset_id", "position", "depth")


# predictions that all read an original dataset
ON_SOURCES = "SELECT c_custkey AS id, c_nationkey - c_nationkey % 5 AS input_dataset_id FROM {customer}"


@query(
    "l5_unused_derived",
    f"""WITH d AS ({F9}), m AS ({MODELS}), p AS ({ON_SOURCES}) SELECT CAST(id AS BIGINT) AS id, name FROM d WHERE source_dataset_id IS NOT NULL
      AND id NOT IN (SELECT dataset_id FROM m) AND id NOT IN (SELECT input_dataset_id FROM p)
      AND id NOT IN (SELECT source_dataset_id FROM d WHERE source_dataset_id IS NOT NULL)""",
)
def l5(spark, sf):
    used = rows(spark, sf, ON_SOURCES)
    return rounded(registry.unused_derived(rows(spark, sf, F9), rows(spark, sf, MODELS), used).select("id", "name"))


@query(
    "l6_orphan_predictions",
    f"WITH m AS ({MODELS}), p AS ({PREDICTIONS}) SELECT id, CAST(model_id AS BIGINT) AS model_id FROM p WHERE model_id NOT IN (SELECT id FROM m)",
)
def l6(spark, sf):
    return rounded(registry.orphan_predictions(rows(spark, sf, PREDICTIONS), rows(spark, sf, MODELS)).select("id", "model_id"))


FILES = """SELECT concat('/models/', c_nationkey, '/', c_name, '.bin') AS path, concat('/models/', c_nationkey) AS folder,
    CAST(c_custkey * 60 AS DOUBLE) AS modified FROM {customer}"""


@query(
    "l7_unreferenced_files",
    f"""WITH f AS ({FILES}) SELECT path, folder, modified FROM f WHERE 90000 - modified >= 3600
      AND folder NOT IN (SELECT '/models/' || n_nationkey FROM nation WHERE n_regionkey = 1)
      AND split_part(path, '/', 4) NOT IN (SELECT c_name || '.bin' FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def l7(spark, sf):
    found = rows(spark, sf, FILES)
    used = rows(spark, sf, "SELECT concat('/other/', c_name, '.bin') AS path FROM {customer} WHERE c_mktsegment = 'BUILDING'")
    live = rows(spark, sf, "SELECT concat('/models/', n_nationkey) AS folder FROM {nation} WHERE n_regionkey = 1")
    return registry.unreferenced_files(found, used, live, 90000.0)


@query(
    "l8_deletable_datasets",
    f"""WITH d AS ({F9}), m AS ({MODELS}), p AS ({PREDICTIONS}), c AS (SELECT id, (SELECT count(*) FROM m WHERE dataset_id = d.id) AS a,
      (SELECT count(*) FROM p WHERE input_dataset_id = d.id) AS b FROM d)
    SELECT CAST(id AS BIGINT) AS id, CAST(a AS BIGINT) AS model_uses, CAST(b AS BIGINT) AS prediction_uses, a + b = 0 AS deletable FROM c""",
)
def l8(spark, sf):
    return rounded(registry.can_delete(rows(spark, sf, F9), rows(spark, sf, MODELS), rows(spark, sf, PREDICTIONS)))


@query("l8_newest_datasets", f"SELECT CAST(id AS BIGINT) AS id, name FROM ({F9}) t ORDER BY id DESC LIMIT 10")
def l8b(spark, sf):
    return rounded(registry.newest(rows(spark, sf, F9), "id", 10).select("id", "name"))


@query(
    "r2_reloaded_components",
    f"{_CODED} SELECT id, {rd('(price - (SELECT avg(price) FROM e)) / (SELECT stddev_pop(price) FROM e)')} AS price,"
    f" {rd('(v - (SELECT avg(v) FROM e)) / (SELECT stddev_pop(v) FROM e)')} AS priority FROM e",
)
def r2b(spark, sf):
    """Components written by one session and applied by another."""
    frame, steps = _steps(spark, sf)
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    Store(spark, folder).save("orders", scoring.Preparation(steps))
    again = Store(spark.newSession(), folder).load("orders")
    return rounded(again.apply(frame).select("id", "price", "priority"))


_RAW = """SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS DOUBLE) AS size, CAST(7 AS DOUBLE) AS constant,
    CASE WHEN p_partkey % 97 = 0 THEN p_retailprice * 20 WHEN p_partkey % 31 = 0 THEN NULL ELSE p_retailprice END AS price,
    CAST(3 AS DOUBLE) * p_size + CAST(0.05 AS DOUBLE) * p_retailprice AS y FROM {part}"""


@query(
    "l1_declared_scoring",
    f"""WITH raw AS ({_RAW}), t AS (SELECT id, size, y, coalesce(price, (SELECT median(price) FROM raw)) AS price FROM raw),
    p AS (SELECT id, y, greatest(least(price, {_UPPER}), {_LOWER}) * size AS v, {_SPLIT} AS train FROM t),
    m AS (SELECT regr_slope(y, v) AS w, regr_intercept(y, v) AS b FROM p WHERE train = 1)
    SELECT id, {rd('b + w * v', 4)} AS prediction FROM p, m""",
)
def l1c(spark, sf):
    """Raw rows scored by the bundle of a run that fills, clips, multiplies, selects, scales and fits."""
    frame = rows(spark, sf, _RAW)
    done = run_pipeline(spark, [
        {"step": "source", "key": "id", "target": "y"},
        {"step": "preprocess", "missing": "median", "encoding": [{"column_name": "brand", "encoding_method": "frequency"}]},
        {"step": "outliers", "method": "iqr", "action": "clip", "threshold": 1.5, "columns": ["price"]},
        {"step": "polynomial", "columns": ["price", "size"], "interaction_only": True},
        {"step": "select", "method": "variance", "threshold": 1e6},
        {"step": "train", "algorithm": "linear_regression", "scale": "standard", "scale_target": True},
    ], frame)
    return rounded(done["training"].bundle.score(frame).select("id", "prediction"), 4)


@query(
    "s10_registered_prediction",
    f"""WITH p AS (SELECT id, x2, y, {_SPLIT} AS train FROM ({F5}) f),
    m AS (SELECT regr_slope(y, x2) AS w, regr_intercept(y, x2) AS b FROM p WHERE train = 1)
    SELECT id, {rd('b + w * x2', 4)} AS prediction, count(*) OVER () AS row_count FROM p, m""",
)
def s10b(spark, sf):
    """A model trained, kept and registered, then loaded by its id to score a dataset."""
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    book, store = registry.Registry(spark, f"{folder}/registry"), Store(spark, f"{folder}/models")
    frame = rows(spark, sf, F5).select("id", "x2", "y")
    model = train_model(frame, "id", "linear_regression", "y", scale="standard").register(book, "parts", store=store)
    predict_registered(book, store, model, frame, f"{folder}/scored", "parts")
    entry = book.table("predictions").select("path", "row_count").first()
    return rounded(spark.read.parquet(entry.path).select("id", "prediction", F.lit(entry.row_count).alias("row_count")), 4)


@query(
    "t7_train_clustering",
    f"""WITH t AS ({F8}), c AS (SELECT blob, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) + var_pop(y) AS v FROM t WHERE blob >= 0 GROUP BY blob),
    g AS (SELECT avg(x) AS gx, avg(y) AS gy FROM t WHERE blob >= 0)
    SELECT 'n_clusters' AS metric, CAST((SELECT count(*) FROM c) AS DOUBLE) AS value
    UNION ALL SELECT 'n_noise', CAST((SELECT count(*) FROM t WHERE blob < 0) AS DOUBLE)
    UNION ALL SELECT 'calinski_harabasz_score', {rd('sum(n * (power(mx - gx, 2) + power(my - gy, 2))) * (sum(n) - count(*)) / (sum(n * v) * (count(*) - 1))', 4)} FROM c, g""",
)
def t7c(spark, sf):
    """Clusters by name, with their scores."""
    done = train_model(rows(spark, sf, F8).drop("blob"), "id", "dbscan", parameters={"eps": 1.0, "min_samples": 3})
    return rounded(done.metrics.where("metric IN ('n_clusters', 'n_noise', 'calinski_harabasz_score')"), 4)


@query(
    "t7_train_reduction",
    f"""WITH p AS ({F5}), c AS (SELECT count(*) AS n, var_samp(x1) AS a, covar_samp(x1, x2) AS b, var_samp(x2) AS d FROM p),
    e AS (SELECT n, (a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b) AS big, (a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b) AS small FROM c)
    SELECT 'explained_variance_ratio' AS metric, {rd('big / (big + small)')} AS value FROM e
    UNION ALL SELECT 'n_samples', CAST(n AS DOUBLE) FROM e
    UNION ALL SELECT 'reconstruction_error', {rd('small * (n - 1) / n / 2')} FROM e""",
)
def t7d(spark, sf):
    """A reduction by name, with its scores."""
    done = train_model(rows(spark, sf, F5).drop("y"), "id", "pca", parameters={"n_components": 1})
    return rounded(done.metrics.where("metric IN ('explained_variance_ratio', 'n_samples', 'reconstruction_error')"))
