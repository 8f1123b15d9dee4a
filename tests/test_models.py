"""Estimators against closed forms, invariants and known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators.models import bayes, cluster, decomposition, graphs, linear, margin, nearest, neural, trees
from tabloom.operators.models.catalog import fit_named
from tabloom.operators.models.matrices import covariance
from tabloom.operators.selection import by_elimination, by_importance
from tabloom.operators.tuning import GRIDS, Real, Whole, bayesian_search, draw, grid_search, random_search
from tabloom.plans.lineage import lineage_roots
from tabloom.sources.registry import Registry

RNG = np.random.default_rng(7)
N = 400
X = np.column_stack([RNG.normal(0, 1, N), RNG.normal(2, 3, N), RNG.uniform(-1, 1, N)])
Y = X @ [1.5, -2.0, 0.5] + 3 + RNG.normal(0, 0.3, N)
CLASS = np.where(X[:, 0] + 0.3 * X[:, 1] > 1.0, "yes", "no")
THREE = np.where(X[:, 0] > 0.6, 2, np.where(X[:, 0] > -0.6, 1, 0))
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    pdf = pd.DataFrame(X, columns=FEATURES).assign(id=range(N), y=Y, k=CLASS, t=THREE, text=[f"t{i % 5}" for i in range(N)])
    return spark.createDataFrame(pdf).repartition(4).cache()


def accuracy(scored, label):
    return scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]


def test_penalised_lines(df):
    centred, goal = X - X.mean(0), Y - Y.mean()
    want = np.linalg.solve(centred.T @ centred + 5 * np.eye(3), centred.T @ goal)
    assert np.allclose(linear.fit_ridge(df, FEATURES, "y", 5.0).coefficients, want, atol=1e-8)
    for alpha, ratio in [(0.2, 1.0), (0.4, 0.3)]:
        w = np.zeros(3)
        for _ in range(3000):
            for j in range(3):
                rest = goal - centred @ w + centred[:, j] * w[j]
                rho = centred[:, j] @ rest / N
                w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / ((centred[:, j] ** 2).mean() + alpha * (1 - ratio))
        model = linear.fit_lasso(df, FEATURES, "y", alpha) if ratio == 1 else linear.fit_elastic_net(df, FEATURES, "y", alpha, ratio)
        assert np.allclose(model.coefficients, w, atol=1e-5)


def test_non_negative_weights(df):
    model = linear.fit_linear(df, FEATURES, "y", positive=True)
    assert model.coefficients[1] == 0.0 and min(model.coefficients) >= 0
    plain = linear.fit_linear(df, ["a", "c"], "y")
    assert np.allclose([model.coefficients[0], model.coefficients[2]], plain.coefficients, atol=1e-6)


def test_logistic_gradient_vanishes(df):
    model = linear.fit_logistic(df, FEATURES, "k", C=0.5, tol=1e-10)
    w, b = model.model.coefficients.toArray(), model.model.intercept
    p = 1 / (1 + np.exp(-(X @ w + b)))
    gap = p - (CLASS == "yes")
    assert np.abs(X.T @ gap + w / 0.5).max() < 0.05 and abs(gap.sum()) < 0.05
    scored = model.predict(df)
    assert accuracy(scored, "k") > 0.9
    assert scored.where("abs(probability_no + probability_yes - 1) > 1e-9").count() == 0


def test_naive_bayes_equals_numpy(df):
    model = bayes.fit_naive_bayes(df, FEATURES, "t")
    logs = []
    for k in range(3):
        part = X[THREE == k]
        var = part.var(0) + 1e-9 * X.var(0).max()
        logs.append(math.log(len(part) / N) - 0.5 * (np.log(2 * np.pi * var) + (X - part.mean(0)) ** 2 / var).sum(1))
    got = model.predict(df).orderBy("id").toPandas()
    assert list(got.prediction) == list(np.argmax(logs, axis=0))


def test_neighbor_votes(df):
    for settings in ({}, {"small_values": 0, "tile_rows": 100}):
        model = nearest.fit_nearest(df, FEATURES, "t", "id", 1, **settings)
        assert accuracy(model.predict(df), "t") == 1.0  # each row is its own neighbour
    model = nearest.fit_nearest(df, FEATURES, "t", "id", 15, "distance", p=1)
    scored = model.predict(df)
    assert scored.where("abs(probability_0 + probability_1 + probability_2 - 1) > 1e-9").count() == 0


def test_trees_and_boosting(df):
    for name in ("decision_tree_classifier", "random_forest_classifier", "gradient_boosting_classifier", "lightgbm_classifier"):
        extra = {"n_estimators": 5} if name != "decision_tree_classifier" else {}
        model = fit_named(name, df, FEATURES, "k", "id", max_depth=4, **extra)
        assert accuracy(model.predict(df), "k") > 0.85, name
        assert sum(model.importances().values()) == pytest.approx(1.0)
    many = trees.fit_boosting_classifier(df, FEATURES, "t", n_estimators=3).predict(df)
    assert accuracy(many, "t") > 0.9
    assert many.where("abs(probability_0 + probability_1 + probability_2 - 1) > 1e-9").count() == 0
    coded = trees.fit_catboost_classifier(df, ["a", "text"], "t", iterations=3, depth=3)
    assert coded.notes["l2_leaf_reg"] == "ignored: 3.0"
    assert coded.predict(df).where("text not like 't%'").count() == 0
    with pytest.raises(ValueError, match="encoded first: text"):
        trees.fit_tree_classifier(df, ["a", "text"], "t")


def test_kernel_maps():
    x = RNG.normal(0, 1, (30, 3))
    poly = margin.KernelMap("poly", 0.5, 3, 3)
    assert np.allclose(poly(x) @ poly(x).T, (0.5 * x @ x.T) ** 3)
    wide = np.random.default_rng(0)
    rbf = margin.KernelMap("rbf", 0.3, 3, 3, wide.normal(0, math.sqrt(0.6), (3, 20000)), wide.uniform(0, 2 * math.pi, 20000))
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(rbf(x) @ rbf(x).T - np.exp(-0.3 * gap)).max() < 0.05


def test_support_vectors(df):
    model = margin.fit_svm(df, FEATURES, "k", kernel="linear", max_iter=20)
    assert accuracy(model.predict(df), "k") > 0.9
    line = margin.fit_svr(df, FEATURES, "y", "id", C=10.0, kernel="linear", max_iter=300)
    assert np.abs(line.weights - [1.5, -2.0, 0.5]).max() < 0.15
    with pytest.raises(ValueError, match="sigmoid"):
        margin.fit_svm(df, FEATURES, "k", kernel="sigmoid")


def test_network_on_one_and_many_shards(df):
    for shard_values in (4_000_000, 300):
        model = neural.fit_mlp_classifier(
            df, FEATURES, "k", "id", (16,), max_iter=25, learning_rate_init=0.02, shard_values=shard_values
        )
        assert accuracy(model.predict(df), "k") > 0.9
        assert model.loss_curve[-1] < model.loss_curve[0]


def test_network_gradient():
    rng = np.random.default_rng(1)
    for loss, y in (("softmax", rng.integers(0, 3, (20, 1)).astype(float)), ("squared", rng.normal(0, 1, (20, 1)))):
        net = neural.Network([4, 5, 3 if loss == "softmax" else 1], "tanh", loss)
        flat, x = net.start(0), rng.normal(0, 1, (20, 4))
        _, g = net.gradient(flat, x, y, 0.1)
        for i in range(0, net.length, 7):
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            slope = (net.gradient(up, x, y, 0.1)[0] - net.gradient(down, x, y, 0.1)[0]) / 2e-6
            assert g[i] == pytest.approx(slope, abs=1e-5)


def test_principal_components(df):
    full = decomposition.fit_pca(df, FEATURES, 3)
    assert np.allclose(full.vectors.T @ full.vectors, np.eye(3), atol=1e-10)
    assert np.allclose(sorted(full.variance), sorted(np.linalg.eigvalsh(np.cov(X.T))))
    assert full.reconstruction_errors(df).agg(F.max("error")).first()[0] < 1e-18
    white = decomposition.fit_pca(df, FEATURES, 2, whiten=True)
    row = white.transform(df).agg(F.var_samp("pc1"), F.var_samp("pc2"), F.avg("pc1")).first()
    assert np.allclose(row, [1, 1, 0], atol=1e-9)


def test_wide_covariance(spark):
    wide = np.random.default_rng(2).normal(5, 1, (200, 20))
    frame = spark.createDataFrame(pd.DataFrame(wide, columns=[f"w{i}" for i in range(20)]))
    assert np.allclose(covariance(frame, frame.columns).matrix, np.cov(wide.T))


def test_discriminant_scale(df):
    shown = decomposition.fit_discriminant(df, FEATURES, "t", 2).transform(df).toPandas()
    within = sum(((g[["ld1", "ld2"]] - g[["ld1", "ld2"]].mean()).T @ (g[["ld1", "ld2"]] - g[["ld1", "ld2"]].mean())) for _, g in shown.groupby("t"))
    assert np.allclose(within / (N - 3), np.eye(2), atol=1e-8)


@pytest.mark.parametrize("shape", ["full", "tied", "diag", "spherical"])
def test_mixtures_find_two_heaps(spark, shape):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal([0, 0], 0.5, (150, 2)), rng.normal([6, 6], 0.5, (50, 2))])
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(200)))
    model = cluster.fit_mixture(frame, ["a", "b"], 2, shape, max_iter=30)
    assert np.allclose(sorted(model.weights), [0.25, 0.75], atol=0.02)
    scored = model.predict(frame)
    assert scored.where("abs(probability_0 + probability_1 - 1) > 1e-9").count() == 0
    assert sorted(r["count"] for r in scored.groupBy("cluster").count().collect()) == [50, 150]


def test_bandwidths(df):
    conditional = graphs.perplexity_graph(df, "id", FEATURES, 12.0, symmetric=False)
    entropy = conditional.groupBy("src").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("h"))
    low, high = entropy.agg(F.min("h"), F.max("h")).first()
    assert low == pytest.approx(math.log(12), abs=1e-6) and high == pytest.approx(math.log(12), abs=1e-6)
    sums = graphs.fuzzy_graph(df, "id", FEATURES, 8, symmetric=False).groupBy("src").agg(F.sum("w").alias("s"))
    low, high = sums.agg(F.min("s"), F.max("s")).first()
    assert low == pytest.approx(3.0, abs=1e-6) and high == pytest.approx(3.0, abs=1e-6)
    union = graphs.fuzzy_graph(df, "id", FEATURES, 8)
    assert union.where("src >= dst or w > 1 + 1e-12 or w < 0").count() == 0


def test_selection_by_forest(df):
    picked = by_importance(df, "k", 1, columns=FEATURES, trees=5)
    assert picked.selected in (["a"], ["b"])
    ranks = by_elimination(df, "y", 1, FEATURES, trees=5)
    assert ranks.selected == ["b"] and sorted(ranks.scores.values()) == [1.0, 2.0, 3.0]


def test_searches(df):
    grid = grid_search(df, "decision_tree_classifier", FEATURES, "k", "id", {"max_depth": [1, 5]}, cv=2, parallelism=2)
    assert grid.best_parameters == {"max_depth": 5} and grid.trials.count() == 2
    wide = random_search(df, "naive_bayes", FEATURES, "t", "id", {"var_smoothing": Real(1e-9, 1e-6)}, 2, 2, "roc_auc")
    assert 0.9 < wide.best_score <= 1.0
    found = bayesian_search(df, "ridge_regression", FEATURES, "y", "id", {"alpha": Real(0.0, 5000.0)}, 6, 2, warmup=3)
    assert found.trials.count() == 6 and found.best_score > 0.8
    assert len(GRIDS) == 22
    space = {"n": Whole(2, 4), "r": Real(0, 1), "c": ["x", "y"]}
    drawn = [draw(space, np.random.default_rng(i)) for i in range(40)]
    assert {d["n"] for d in drawn} == {2, 3} and {d["c"] for d in drawn} == {"x", "y"}


def test_long_lineage(spark):
    rows = [(i, i - 1 if i % 700 else None) for i in range(1400)] + [(9000, 8999)]
    frame = spark.createDataFrame(rows, "id long, source_dataset_id long")
    got = {r.id: (r.root, r.depth) for r in lineage_roots(frame).collect()}
    assert got[699] == (0, 699) and got[1399] == (700, 699) and got[9000] == (9000, 0)


def test_registry_is_append_only(spark, tmp_path):
    book = Registry(spark, str(tmp_path))
    assert book.table("models").count() == 0
    book.append("models", [{"dataset_id": "d", "algorithm": "x"}])
    book.append("models", [{"dataset_id": "d", "algorithm": "y"}])
    assert sorted(r.algorithm for r in book.table("models").collect()) == ["x", "y"]


def test_shrunk_within_covariance(df):
    want = np.zeros((3, 3))
    for k in range(3):
        z = X[THREE == k]
        scale = z.std(0)
        z = (z - z.mean(0)) / scale
        n, d = z.shape
        cov = z.T @ z / n
        mu = np.trace(cov) / d
        delta = ((cov**2).sum() - 2 * mu * np.trace(cov) + d * mu**2) / d
        beta = min(1 / (d * n) * (((z**2).T @ (z**2)).sum() / n - (cov**2).sum()), delta)
        cov = (1 - beta / delta) * cov + beta / delta * mu * np.eye(d)
        want += n * cov * np.outer(scale, scale)
    assert np.allclose(decomposition.shrunk_within(df, FEATURES, "t"), want / N, atol=1e-9)
