"""Keeping models and preparations, declared runs on raw rows, and training without a target."""

import datetime
import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.construct import Products
from tabloom.operators.encoding import fit_encoder
from tabloom.operators.models.catalog import CLASSIFIERS, REGRESSORS, fit_named
from tabloom.operators.outliers import fit_isolation_forest, fit_treatment
from tabloom.operators.scoring import Preparation, needed
from tabloom.plans.store import Store, load_registered, predict_registered
from tabloom.plans.train import run_pipeline, train_model
from tabloom.sources.registry import Registry
from tabloom.sources.shared import settle

FAST = {
    "random_forest_classifier": {"n_estimators": 4}, "random_forest_regressor": {"n_estimators": 4},
    "gradient_boosting_classifier": {"n_estimators": 2}, "gradient_boosting_regressor": {"n_estimators": 2},
    "xgboost_classifier": {"n_estimators": 2}, "xgboost_regressor": {"n_estimators": 2},
    "lightgbm_classifier": {"n_estimators": 2}, "lightgbm_regressor": {"n_estimators": 2},
    "catboost_classifier": {"iterations": 2}, "svm_classifier": {"max_iter": 5, "components": 20},
    "svr": {"max_iter": 10, "components": 20}, "mlp_classifier": {"max_iter": 5}, "mlp_regressor": {"max_iter": 5},
}


@pytest.fixture(scope="module")
def points(spark):
    df = spark.range(240).select(
        "id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("name"), (F.col("id") % 3).alias("label"),
    )
    return settle(df.withColumn("y", 2 * F.col("a") - F.col("b") + F.col("id") % 5), "points")


def values(df, key="id"):
    return [tuple(r) for r in df.orderBy(key).collect()]


@pytest.mark.parametrize("name", sorted(CLASSIFIERS | REGRESSORS))
def test_every_model_comes_back(spark, points, tmp_path, name):
    """A model loaded by another session predicts what the fitted one does."""
    label = "label" if name in CLASSIFIERS else "y"
    model = fit_named(name, points, ["a", "b"], label, "id", **FAST.get(name, {}))
    Store(spark, str(tmp_path)).save(name, model)
    again = Store(spark.newSession(), str(tmp_path)).load(name)
    assert type(again) is type(model) and again.notes == model.notes
    assert values(again.predict(points)) == values(model.predict(points))


def test_text_columns_of_a_kept_boosting(spark, points, tmp_path):
    model = fit_named("catboost_classifier", points, ["a", "name"], "label", "id", iterations=2)
    store = Store(spark, str(tmp_path))
    store.save("m", model)
    assert values(store.load("m").predict(points)) == values(model.predict(points))


@pytest.mark.parametrize("method", ["label", "onehot", "ordinal", "target", "frequency", "binary", "hash"])
def test_encoders_come_back(spark, points, tmp_path, method):
    coder = fit_encoder(points, method, "name", "y")
    store = Store(spark, str(tmp_path))
    store.save("coder", coder)
    assert values(store.load("coder").apply(points)) == values(coder.apply(points))


def test_plain_values(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    value = {
        "n": None, "f": [1.5, math.inf, -math.inf], 3: ("x", True), "d": datetime.date(2020, 2, 29),
        "t": datetime.datetime(2020, 1, 2, 3, 4, 5, 6), "m": decimal.Decimal("1.20"), "b": b"\x00\xff", "i": np.int64(7), "e": {},
    }
    store.save("v", value)
    assert store.load("v") == value
    store.save("a", [np.arange(6).reshape(2, 3), np.array([]), np.array([np.nan, 1.0])])
    first, empty, gap = store.load("a")
    assert first.tolist() == [[0, 1, 2], [3, 4, 5]] and empty.shape == (0,) and math.isnan(gap[0]) and gap[1] == 1.0


def test_versions_and_broken_saves(spark, points, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.versions("m") == []
    with pytest.raises(ValueError, match="no version"):
        store.load("m")
    assert [store.save("m", n) for n in (10, 20, 30)] == [1, 2, 3]
    assert (store.load("m"), store.load("m", 1)) == (30, 10)
    broken = points.select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.save("m", [1, broken])
    assert store.versions("m") == [1, 2, 3] and store.load("m") == 30


def test_what_cannot_be_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for value in (object(), {1, 2}, np.array([object()])):
        with pytest.raises(TypeError, match="cannot be kept"):
            store.save("m", value)
    assert store.versions("m") == []


def test_a_manifest_names_listed_kinds_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store._commit("m", '{"parts": "p", "arrays": 0, "value": {"model": 0, "class": "os:system"}}')
    with pytest.raises(ValueError, match="pyspark.ml"):
        store.load("m")
    store._commit("m", '{"parts": "p", "arrays": 0, "value": {"kind": "Popen", "fields": {}}}')
    with pytest.raises(KeyError):
        store.load("m")


def test_registered_model_scores_a_dataset(spark, points, tmp_path):
    book, store = Registry(spark, f"{tmp_path}/book"), Store(spark, f"{tmp_path}/kept")
    done = train_model(points.drop("label"), "id", "ridge_regression", "y", missing="mean", scale="standard")
    model = done.register(book, "points", store=store)
    path = f"{tmp_path}/scored.csv"
    predict_registered(book, store, model, points.drop("y", "label"), path, "points", "csv")
    row = book.table("predictions").first()
    assert (row.model_id, row.input_dataset_id, row.path, row.row_count) == (model, "points", path, 240)
    found = {int(r.id): float(r.prediction) for r in spark.read.option("header", True).csv(path).collect()}
    assert found == pytest.approx({r.id: r.prediction for r in done.bundle.score(points).collect()})
    with pytest.raises(ValueError, match="not kept"):
        load_registered(book, store, "other")
    bare = train_model(points.select("id", "a", "b"), "id", "dbscan", parameters={"eps": 2.0})
    with pytest.raises(ValueError, match="no model"):
        bare.register(book, "points", store=store)


def raw(spark):
    return spark.range(400).select(
        "id", F.when(F.col("id") % 50 == 0, 1000.0).when(F.col("id") % 41 == 0, None).otherwise((F.col("id") % 37).cast("double")).alias("a"),
        (F.col("id") * 5 % 13).cast("double").alias("b"), F.concat(F.lit("k"), F.col("id") % 4).alias("kind"),
        F.lit(1.0).alias("same"), F.concat(F.lit("class "), (F.col("id") * 5 % 13 > 6).cast("int")).alias("goal"),
        (3.0 * (F.col("id") % 37) + (F.col("id") * 5 % 13)).alias("y"),
    )


def test_run_restores_a_target_scaled_before_training(spark):
    """Two scalings of the target, one in a step of its own and one in training, are both undone."""
    frame = raw(spark).drop("goal")
    done = run_pipeline(spark, [
        {"step": "source", "key": "id", "target": "y"},
        {"step": "preprocess", "missing": "median", "scale": "minmax", "scale_target": True},
        {"step": "outliers", "columns": ["a"], "action": "replace_median"},
        {"step": "train", "algorithm": "linear_regression", "scale": "standard", "scale_target": True},
    ], frame)
    error = done["training"].bundle.score(frame).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert error < 20  # y reaches 120; before, errors were in other units altogether
    shown = {r.metric: r.value for r in done["training"].metrics.collect()}
    assert shown["actual_max"] > 50 and shown["mae"] < 20


def test_run_gives_back_class_names(spark):
    frame = raw(spark).drop("y")
    done = run_pipeline(spark, [
        {"step": "source", "key": "id", "target": "goal"},
        {"step": "preprocess", "missing": "mean", "encoding": [
            {"column_name": "goal", "encoding_method": "label"}, {"column_name": "kind", "encoding_method": "onehot"}]},
        {"step": "select", "method": "variance"},
        {"step": "train", "algorithm": "decision_tree_classifier", "parameters": {"max_depth": 4}},
    ], frame)
    scored = done["training"].bundle.score(frame)
    assert scored.where("goal = prediction").count() == 400
    assert scored.columns[: len(frame.columns)] == frame.columns
    # a column that selection dropped is not asked for
    assert "same" not in done["training"].bundle.required and "kind" in done["training"].bundle.required


def test_removed_rows_are_still_scored(spark):
    frame = raw(spark).drop("goal", "kind", "same")
    spec = [
        {"step": "source", "key": "id", "target": "y"}, {"step": "preprocess", "missing": "mean"},
        {"step": "outliers", "columns": ["a"], "action": "remove"}, {"step": "train", "algorithm": "linear_regression"},
    ]
    done = run_pipeline(spark, spec, frame)
    assert done["df"].count() == 392 and done["training"].bundle.score(frame).where("prediction IS NOT NULL").count() == 400


def test_absent_columns_are_reported(spark):
    frame = raw(spark).drop("goal", "kind")
    done = run_pipeline(spark, [
        {"step": "source", "key": "id", "target": "y"}, {"step": "preprocess", "missing": "mean"},
        {"step": "polynomial", "columns": ["a", "b"]}, {"step": "train", "algorithm": "linear_regression"},
    ], frame)
    bundle = done["training"].bundle
    found = [(r.check_name, r.column_name) for r in bundle.findings(frame.drop("a")).where("level = 'error'").collect()]
    assert found == [("missing_column", "a")]
    assert bundle.score(frame.drop("a")).count() == 400  # an absent column counts as missing


def test_needed_columns():
    steps = [Products(["a", "b"], 2), ]
    assert needed(steps, ["a b", "c", "b^2"]) == {"a", "b", "c"}


def test_treatments_of_new_rows(spark, points, tmp_path):
    odd = points.select("id", F.when(F.col("id") == 3, 500.0).otherwise(F.col("a")).alias("a"))
    for action, value in (("clip", None), ("replace_mean", None), ("replace_median", 8.0), ("remove", 500.0)):
        fitted = fit_treatment(odd, "iqr", action, 1.5, ["a"])
        store = Store(spark, f"{tmp_path}/{action}")
        store.save("t", Preparation([fitted]))
        new = {r.id: r.a for r in store.load("t").apply(odd).collect()}
        assert new[3] == (value if value is not None else new[3]) and (new[3] < 100 or action == "remove")
        assert fitted.treat(odd).count() == (239 if action == "remove" else 240)
    forest = fit_isolation_forest(points, "id", ["a", "b"], contamination=0.1)
    store.save("forest", forest)
    assert values(store.load("forest").score(points, "id")) == values(forest.score(points, "id"))


@pytest.mark.parametrize("name, options, new", [
    ("kmeans", {"n_clusters": 3, "n_init": 1}, True), ("gmm", {"n_components": 2}, True), ("hierarchical", {"n_clusters": 2}, False),
    ("dbscan", {"eps": 2.0}, False), ("spectral", {"n_clusters": 2}, False),
])
def test_clusters_by_name(spark, points, tmp_path, name, options, new):
    done = train_model(points.select("id", "a", "b"), "id", name, parameters={**options, "odd": 1}, scale="standard")
    assert done.scored.count() == 240 and "cluster" in done.scored.columns and "odd ignored: 1" in done.notes
    shown = {r.metric: r.value for r in done.metrics.collect()}
    assert shown["n_clusters"] >= 1 and shown["n_noise"] == done.scored.where("cluster < 0").count()
    assert (done.bundle is not None) == new
    if new:
        store = Store(spark, str(tmp_path))
        store.save("c", done.bundle)
        again = {r.id: r.cluster for r in store.load("c").score(points).collect()}
        assert again == {r.id: r.cluster for r in done.scored.collect()}


def test_reductions_by_name(spark, points):
    done = train_model(points.select("id", "a", "b", "label"), "id", "lda", "label", parameters={"n_components": 1})
    assert done.bundle.score(points).columns[-1] == "ld1" and done.bundle.required == ["a", "b"]
    with pytest.raises(ValueError, match="lda needs a target"):
        train_model(points.select("id", "a", "b"), "id", "lda")
    graph = train_model(points.select("id", "a", "b"), "id", "umap", parameters={"n_neighbors": 4})
    assert graph.bundle is None and {r.metric for r in graph.metrics.collect()} == {"n_edges"}
    with pytest.raises(ValueError, match="unknown algorithm"):
        train_model(points, "id", "no_such", "y")
