"""Columns with many categories and targets with many classes, on both sides of the old limits."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators.encoding import WIDE_ONE_HOT, fit_auto_encoding, fit_encoder
from tabloom.operators.models.base import WIDE_CLASSES, widths
from tabloom.operators.models.bayes import fit_naive_bayes
from tabloom.operators.models.catalog import fit_named
from tabloom.operators.models.linear import fit_logistic
from tabloom.operators.models.nearest import fit_nearest
from tabloom.operators.models.trees import DEEPEST, fit_tree_classifier, fit_tree_regressor
from tabloom.plans.store import Store
from tabloom.plans.train import train_model
from tabloom.sources.shared import settle


def categories(spark, n, rows=None):
    rows = rows or 2 * n
    return spark.range(rows).select(
        "id", F.format_string("c%06d", F.col("id") % n).alias("kind"), (F.col("id") % 7).cast("double").alias("x"),
        ((F.col("id") % n) % 5 + F.col("id") % 3).cast("double").alias("y"),
    )


@pytest.mark.parametrize("n", [WIDE_ONE_HOT, WIDE_ONE_HOT + 1])
def test_both_sides_of_wide_columns(spark, n):
    df = categories(spark, n)
    coder = fit_encoder(df, "onehot", "kind")
    assert coder.sparse == (n > WIDE_ONE_HOT)
    out = coder.apply(df)
    assert len(out.columns) == (4 if coder.sparse else 3 + n)
    if coder.sparse:
        assert widths(out, ["kind_onehot"]) == [n] and out.columns == ["id", "kind_onehot", "x", "y"]
        row = out.where("id = 3").select(vector_to_array("kind_onehot").alias("v")).first().v
        assert (row.index(1.0), sum(row), len(row)) == (3, 1.0, n)
    back = coder.invert(out).where("id IN (3, 700)").select("id", "kind").collect()
    assert {tuple(r) for r in back} == {(3, "c000003"), (700, "c000700")}


def test_sparse_unseen_null_and_strict(spark):
    fit = categories(spark, 30)
    coder = fit_encoder(fit, "onehot", "kind", sparse=True)
    new = spark.createDataFrame([(1, "c000002"), (2, "other"), (3, None)], "id long, kind string")
    rows = {r.id: list(r.v) for r in coder.apply(new).select("id", vector_to_array("kind_onehot").alias("v")).collect()}
    assert rows[1].index(1.0) == 2 and sum(rows[1]) == 1 and sum(rows[2]) == sum(rows[3]) == 0 and len(rows[3]) == 30
    strict = fit_encoder(fit, "onehot", "kind", sparse=True, handle_unknown="error")
    with pytest.raises(Exception, match="unseen category"):
        strict.apply(new).collect()


def test_no_category_at_all(spark):
    df = spark.createDataFrame([(1, None)], "id long, kind string")
    assert fit_encoder(df, "onehot", "kind", sparse=True).apply(df).columns == ["id"]


def test_automatic_encoding_has_no_errors(spark):
    found = fit_auto_encoding(categories(spark, 1500), [{"column_name": "id", "encoding_method": "none"}], "y")
    assert found.errors == [] and [e.sparse for e in found.encoders] == [True]


@pytest.mark.parametrize("algorithm, parameters", [
    ("logistic_regression", {"max_iter": 5}), ("decision_tree_classifier", {"max_depth": 3}), ("mlp_classifier", {"max_iter": 1, "hidden_layer_sizes": [4]}),
    ("svm_classifier", {"kernel": "linear", "max_iter": 3}), ("ridge_regression", {}), ("lasso_regression", {"alpha": 0.001, "max_iter": 20}),
    ("gradient_boosting_regressor", {"n_estimators": 2}), ("svr", {"max_iter": 2, "components": 10}),
])
def test_1500_categories_train(spark, tmp_path, algorithm, parameters):
    df = categories(spark, 1500, 3000)
    target = "y"
    if "class" in algorithm or algorithm == "logistic_regression":
        df, target = df.withColumn("goal", (F.col("y") > 2).cast("int")).drop("y"), "goal"
    df = settle(df, "wide")
    done = train_model(df, "id", algorithm, target, parameters=parameters, scale="standard")
    assert set(done.bundle.features) == {"kind_onehot", "x"}
    assert done.scored.where("prediction IS NULL").count() == 0 and done.scored.count() > 400
    shown = {r.feature for r in done.importance.collect()}
    assert shown in (set(), {"kind_onehot", "x"})
    store = Store(spark, str(tmp_path))
    store.save("m", done.bundle)
    again = store.load("m").score(df.where("id < 50").drop(target))
    assert [r.prediction for r in again.orderBy("id").collect()] == pytest.approx(
        [r.prediction for r in done.bundle.score(df.where("id < 50").drop(target)).orderBy("id").collect()]
    )
    assert done.bundle.score(df.where("id < 9").drop("kind")).count() == 9  # the column is missing altogether


def test_100000_categories_train(spark):
    df = settle(categories(spark, 100_000, 200_000), "wide")
    done = train_model(df, "id", "ridge_regression", "y", parameters={"alpha": 1e-3})
    coder = next(s for s in done.bundle.preparation.steps if hasattr(s, "encoders")).encoders[0]
    assert coder.sparse and coder.size > 90_000 and coder.names is None
    r2 = {r.metric: r.value for r in done.metrics.collect()}["r2"]
    assert r2 > 0.1  # a category has one other row to learn from, and a fifth of the test rows none


def test_columns_only_estimators_say_so(spark):
    df = categories(spark, 1200)
    for name in ("naive_bayes", "knn_classifier"):
        with pytest.raises(ValueError, match="takes no vector columns"):
            train_model(df.withColumn("goal", F.col("id") % 2).drop("y"), "id", name, "goal")


def many(spark, n, each=2):
    """Classes at points of their own, ``each`` rows a class."""
    return settle(spark.range(n * each).select(
        "id", (F.col("id") % n).alias("c"), ((F.col("id") % n) % 40).cast("double").alias("a"),
        F.floor((F.col("id") % n) / 40).cast("double").alias("b"),
    ), "many")


@pytest.mark.parametrize("n", [WIDE_CLASSES, 1500])
def test_naive_bayes_with_many_classes(spark, n):
    df = many(spark, n)
    model = fit_naive_bayes(df, ["a", "b"], "c", var_smoothing=1e-4)
    out = model.predict(df)
    assert out.where("prediction = c").count() == 2 * n
    if n > WIDE_CLASSES:
        assert out.columns == [*df.columns, "prediction", "probabilities"]
        p = np.array(out.where("id = 7").first().probabilities)
        gaps = [((np.array([7.0, 0.0]) - m) ** 2 / (2 * np.array(v))).sum() for m, v in zip(model.means, model.variances)]
        want = np.exp(-np.array(gaps))
        assert p == pytest.approx(want / want.sum(), abs=1e-9)
    else:
        assert f"probability_{n - 1}" in out.columns


@pytest.mark.parametrize("n", [WIDE_CLASSES, 1500])
@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbours_with_many_classes(spark, n, weights):
    df = many(spark, n)
    out = fit_nearest(df, ["a", "b"], "c", "id", n_neighbors=2, weights=weights).predict(df)
    assert out.where("prediction = c").count() == 2 * n


def test_neighbour_votes_keep_rows_with_gaps(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (2, 1.0, "y"), (3, 1.2, "y")], "id long, a double, c string")
    new = spark.createDataFrame([(7, 0.1), (8, None), (9, 1.0)], "id long, a double")
    for weights, share in (("uniform", 1 / 3), ("distance", None)):
        rows = {r.id: r for r in fit_nearest(df, ["a"], "c", "id", n_neighbors=3, weights=weights).predict(new).collect()}
        assert rows[8].prediction is None and rows[8].probability_x is None and len(rows) == 3
        assert rows[9].prediction == "y" and rows[9].probability_x + rows[9].probability_y == pytest.approx(1)
        if share:
            assert rows[7].probability_x == pytest.approx(share)
        else:
            assert rows[7].prediction == "x" and rows[9].probability_y == 1.0


def test_logistic_with_many_classes(spark):
    df = many(spark, 1500, 1)
    out = fit_logistic(df, ["a", "b"], "c", max_iter=2).predict(df)
    assert out.columns[-2:] == ["prediction", "probabilities"]
    row = out.first()
    assert len(row.probabilities) == 1500 and sum(row.probabilities) == pytest.approx(1) and 0 <= row.prediction < 1500


def test_trees_with_many_classes(spark):
    df = many(spark, 1500, 1)
    out = fit_tree_classifier(df, ["a", "b"], "c", max_depth=4).predict(df)
    assert out.columns[-2:] == ["prediction", "probabilities"] and out.select("prediction").distinct().count() > 4


def test_training_with_many_classes(spark):
    df = many(spark, 1100, 3)
    done = train_model(df, "id", "knn_classifier", "c", parameters={"n_neighbors": 1}, test_size=0.3)
    shown = {r.metric: r.value for r in done.metrics.collect()}
    assert shown["accuracy"] > 0.8 and not any(k.startswith("roc_auc") for k in shown)


def test_a_cut_depth_is_noted(spark):
    df = many(spark, 20)
    assert fit_tree_regressor(df, ["a"], "b", max_depth=DEEPEST).notes == {}
    assert fit_tree_regressor(df, ["a"], "b", max_depth=49).notes == {"max_depth": "30 instead of 49"}
    assert "max_depth" in fit_named("random_forest_classifier", df, ["a"], "c", "id", n_estimators=1, max_depth=31).notes


def test_ordered_statistics_hide_the_own_target(spark):
    from tabloom.operators.encoding import ordered_target

    df = spark.range(300).select(
        "id", F.when(F.col("id") % 50 == 9, None).otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("kind"),
        (F.col("id") * 7 % 11).cast("double").alias("y"),
    )
    mean = df.agg(F.avg("y")).first()[0]
    coded = {r.id: r.kind for r in ordered_target(df, "kind", "y", "id").collect()}
    changed = {r.id: r.kind for r in ordered_target(df.withColumn("y", F.col("y") + F.when(F.col("id") == 5, 0.0).otherwise(0.0)), "kind", "y", "id").collect()}
    assert coded == changed and len(coded) == 300
    assert all(coded[i] == pytest.approx(mean) for i in range(9, 300, 50))
    firsts = [c for i, c in coded.items() if i % 50 != 9 and c == pytest.approx(mean)]
    assert len(firsts) >= 3  # the first row of each category has nothing before it
    alone = spark.createDataFrame([(i, f"c{i}", float(i)) for i in range(20)], "id long, kind string, y double")
    assert {r.kind for r in ordered_target(alone, "kind", "y", "id").collect()} == {9.5}  # plain means would give y away
    assert ordered_target(alone.unionAll(alone), "kind", "y").count() == 40
    assert ordered_target(alone.where("false"), "kind", "y", "id").count() == 0


def test_known_rows_project_to_their_own_weights(spark, tmp_path):
    from tabloom.operators.models.graphs import fit_fuzzy_projection, fuzzy_graph

    r = np.random.default_rng(3)
    rows = [(i, *map(float, v)) for i, v in enumerate(r.normal(size=(60, 3)))] + [(99, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    model = fit_fuzzy_projection(df, "id", ["a", "b", "c"], 6)
    store = Store(spark, str(tmp_path))
    store.save("graph", model)
    want = {(x.src, x.dst): x.w for x in fuzzy_graph(df, "id", ["a", "b", "c"], 6, symmetric=False).collect()}
    for m in (model, store.load("graph")):
        assert {(x.src, x.dst): x.w for x in m.project(df).collect()} == pytest.approx(want)
    new = spark.createDataFrame([(500, 0.1, 0.2, 0.3), (501, 9.0, 9.0, 9.0), (502, None, 1.0, 1.0)], df.schema)
    got = {}
    for x in model.project(new).collect():
        got.setdefault(x.src, []).append(x.w)
    assert set(got) == {500, 501} and all(len(w) == 6 and sum(w) == pytest.approx(np.log2(6), abs=1e-6) for w in got.values())


def test_neighbours_with_more_classes_than_a_broadcast_holds(spark, monkeypatch):
    from functools import partial

    from tabloom.operators.lookup import lookup
    from tabloom.operators.models import base
    from tabloom.operators.models import nearest as module

    monkeypatch.setattr(base, "lookup", partial(lookup, rows=1000))
    monkeypatch.setattr(module, "lookup", partial(lookup, rows=1000), raising=False)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 1000, raising=False)
    df = many(spark, 1300).withColumn("c", F.concat(F.lit("c "), F.col("c"))).unionByName(
        spark.createDataFrame([(9000, None, 3.0, 3.0)], "id long, c string, a double, b double").where("id < 0")
    )
    model = fit_nearest(df, ["a", "b"], "c", "id", n_neighbors=1, weights="distance")
    out = model.predict(df)
    assert out.where("prediction = c").count() == 2600
    assert out.columns == [*df.columns, "prediction", "probabilities"]
    row = out.where("id = 1250").first()
    assert len(row.probabilities) == 1300 and row.probabilities[sorted(f"c {i}" for i in range(1300)).index("c 1250")] == 1.0


def test_shards_of_a_kernel_map_hold_the_features(spark):
    from tabloom.operators.models import margin, neural

    df = spark.range(500).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") / 17 - F.col("b") / 5)
    space = margin.fit_kernel_map(df, ["a", "b"], "rbf", 0.1, 3, 50, 1)
    net, s = neural.Network([50, 1], "identity", "epsilon", 0.1), neural.Settings(max_iter=10)
    x = F.array("a", "b")
    narrow, shards, count = neural.pack(df, "id", x, [F.col("y")], 50, 1000, space)
    wide, *same = neural.pack(df, "id", margin.mapped(df, space, ["a", "b"]), [F.col("y")], 50, 1000)
    assert same == [shards, count] and count == 500
    assert narrow.agg(F.sum(F.length("xs"))).first()[0] == 500 * 2 * 8
    assert neural.train(narrow, shards, net, s, space)[0] == pytest.approx(neural.train(wide, shards, net, s)[0], abs=1e-9)
