"""Second-order boosting against split searches by hand and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators.models import histogram
from tabloom.operators.models.histogram import Growth, fit_boosted_trees
from tabloom.operators.models.trees import fit_lightgbm_classifier, fit_lightgbm_regressor, fit_xgboost_classifier, fit_xgboost_regressor

N = 300
DRAW = np.random.default_rng(3)
A, B = DRAW.integers(0, 40, N).astype(float), DRAW.normal(0, 1, N)
Y = np.sin(A / 6) + 0.7 * B + DRAW.normal(0, 0.1, N)


@pytest.fixture(scope="module")
def df(spark):
    pdf = pd.DataFrame({"id": range(N), "a": A, "b": B, "y": Y, "k": np.where(Y > 0.2, "yes", "no"), "t": np.digitize(Y, [-0.3, 0.5])})
    return spark.createDataFrame(pdf).repartition(3).cache()


def brute_tree(x, g, h, rule, gone):
    """Split one leaf at a time over all cuts of all features; gives the value of every row."""

    def score(rows):
        held = max(abs(g[rows].sum()) - rule.alpha, 0.0)
        return held**2 / (h[rows].sum() + rule.penalty)

    def best(rows):
        found = (rule.min_gain, None, None)
        for j in range(x.shape[1]):
            missing = rows & gone[:, j]
            for v in np.unique(x[rows & ~gone[:, j], j]):
                for extra in ([True, False] if missing.any() else [False]):
                    left = rows & (((x[:, j] <= v) & ~gone[:, j]) | (missing if extra else False))
                    right = rows & ~left
                    if min(left.sum(), right.sum()) < max(rule.min_rows, 1) or min(h[left].sum(), h[right].sum()) < rule.min_weight:
                        continue
                    gain = score(left) + score(right) - score(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, left, right)
        return found

    leaves = [(np.ones(len(x), bool), 0)]
    while rule.leaves is None or len(leaves) < rule.leaves:
        options = [(*best(rows), i) for i, (rows, depth) in enumerate(leaves) if rule.max_depth < 1 or depth < rule.max_depth]
        options = [o for o in options if o[1] is not None]
        if not options:
            break
        _, left, right, i = max(options, key=lambda o: o[0])
        depth = leaves.pop(i)[1] + 1
        leaves += [(left, depth), (right, depth)]
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = rule.value(g[rows].sum(), h[rows].sum())
    return out


def scores(model, df, column="prediction"):
    return np.array([r[0] for r in model.predict(df).orderBy("id").select(column).collect()])


@pytest.mark.parametrize(
    "rule",
    [
        Growth(rate=0.3, max_depth=3, penalty=1.0),
        Growth(rate=0.3, max_depth=-1, leaves=7, penalty=0.0, min_weight=1e-3, min_rows=20),
        Growth(rate=1.0, max_depth=4, penalty=2.0, alpha=3.0, min_gain=1.5, min_weight=10.0),
    ],
)
def test_equals_brute_force(df, rule):
    model = fit_boosted_trees(df, ["a", "b"], "y", key="id", n_estimators=2, rule=rule, max_bins=N)
    x, want = np.column_stack([A, B]), np.full(N, Y.mean())
    for _ in range(2):
        want = want + brute_tree(x, want - Y, np.ones(N), rule, np.zeros(x.shape, bool))
    assert np.allclose(scores(model, df), want, atol=1e-6)


def test_logistic_equals_brute_force(df):
    rule = Growth(rate=0.5, max_depth=-1, leaves=5, min_weight=1.0)
    model = fit_boosted_trees(df, ["a", "b"], "k", "classification", "id", 2, rule, max_bins=N)
    yes = (Y > 0.2).astype(float)
    x, m = np.column_stack([A, B]), np.full(N, math.log(yes.mean() / (1 - yes.mean())))
    for _ in range(2):
        p = 1 / (1 + np.exp(-m))
        m = m + brute_tree(x, p - yes, p * (1 - p), rule, np.zeros(x.shape, bool))
    assert np.allclose(scores(model, df, "probability_yes"), 1 / (1 + np.exp(-m)), atol=1e-6)


def test_one_cut_equals_sql(spark, df):
    """One round of depth one: the cut that a SQL split search finds, and the leaf that the penalty gives."""
    df.createOrReplaceTempView("boost_rows")
    best = spark.sql("""
        WITH r AS (SELECT a, y - avg(y) OVER () AS g FROM boost_rows), t AS (SELECT sum(g) AS g, count(*) AS n FROM r),
        s AS (SELECT DISTINCT a, sum(g) OVER (ORDER BY a) AS gl, count(*) OVER (ORDER BY a) AS nl FROM r)
        SELECT a, gl, nl FROM s, t WHERE nl < n
        ORDER BY gl * gl / (nl + 4) + (t.g - gl) * (t.g - gl) / (n - nl + 4) DESC LIMIT 1""").first()
    model = fit_boosted_trees(df, ["a"], "y", n_estimators=1, rule=Growth(rate=1.0, max_depth=1, penalty=4.0))
    after = min(v for v in A if v > best.a)
    assert model.cut[0] == (best.a + after) / 2
    assert model.value[model.left[0]] == pytest.approx(best.gl / (best.nl + 4), abs=1e-6)
    bare = fit_boosted_trees(df, ["a"], "y", n_estimators=1, rule=Growth(rate=1.0, max_depth=1, penalty=4.0, alpha=2.0))
    assert abs(bare.value[bare.left[0]]) == pytest.approx((abs(best.gl) - 2.0) / (best.nl + 4), abs=1e-6)


def test_gaps_go_to_the_better_side(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 10), 5.0 if i % 3 == 0 or i % 10 > 6 else 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    rule = Growth(rate=1.0, max_depth=1, penalty=0.0)
    model = fit_boosted_trees(df, ["x"], "y", n_estimators=1, rule=rule)
    assert np.allclose(scores(model, df), [r[2] for r in rows], atol=1e-6)
    only = spark.createDataFrame([(i, None if i % 2 else 1.0, float(i % 2)) for i in range(20)], "id int, x double, y double")
    again = fit_boosted_trees(only, ["x"], "y", n_estimators=1, rule=rule)
    assert np.allclose(scores(again, only), [i % 2 for i in range(20)], atol=1e-6)
    assert again.predict(spark.createDataFrame([(1, float("nan"))], "id int, x double")).first().prediction == pytest.approx(1.0)


def test_does_not_depend_on_the_layout(df):
    options = dict(features=["a", "b"], label="t", task="classification", key="id", n_estimators=3, subsample=0.7, colsample=0.5)
    one = fit_boosted_trees(df.coalesce(1), **options)
    many = fit_boosted_trees(df.repartition(7, "b"), **options)
    for name in ("feature", "cut", "left", "right", "value", "sides"):
        assert np.array_equal(getattr(one, name), getattr(many, name))
    shares = np.array(scores(one, df, F.array(*[f"probability_{i}" for i in range(3)])).tolist())
    assert np.allclose(shares.sum(axis=1), 1)


def test_many_leaves_take_several_passes_and_spark_picks_the_feature(df, monkeypatch):
    rule = Growth(rate=0.5, max_depth=4)
    want = fit_boosted_trees(df, ["a", "b"], "y", n_estimators=3, rule=rule)
    monkeypatch.setattr(histogram, "HISTOGRAM_CELLS", 2000)
    monkeypatch.setattr(histogram, "COLLECTED", 1)
    monkeypatch.setattr(histogram, "REPLAYED", 2)
    found = fit_boosted_trees(df, ["a", "b"], "y", n_estimators=3, rule=rule)
    assert np.array_equal(found.feature, want.feature) and np.allclose(found.value, want.value, atol=1e-9)


def test_cuts_of_many_values(spark):
    df = spark.range(5000).select(F.col("id"), F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double"), F.lit(7.0)).alias("_x"))
    wide, few, none = histogram.find_cuts(df, 3, 50)
    assert 40 <= len(wide) <= 49 and np.all(np.diff(wide) > 50)
    assert few.tolist() == [0.5, 1.5] and none.tolist() == []


def test_settings_of_the_libraries(df):
    leafwise = fit_lightgbm_regressor(df, ["a", "b"], "y", n_estimators=1, num_leaves=6)
    assert (leafwise.feature < 0).sum() == 6
    assert fit_lightgbm_regressor(df, ["a", "b"], "y", n_estimators=1, num_leaves=6, max_depth=1).feature.tolist().count(-1) == 2
    mild = fit_xgboost_regressor(df, ["a", "b"], "y", n_estimators=1, reg_lambda=50.0)
    bare = fit_xgboost_regressor(df, ["a", "b"], "y", n_estimators=1, reg_lambda=0.0)
    assert np.ptp(scores(mild, df)) < np.ptp(scores(bare, df))
    assert (fit_xgboost_regressor(df, ["a", "b"], "y", n_estimators=1, gamma=1e9).feature < 0).all()
    known = fit_xgboost_classifier(df, ["a", "b"], "t", n_estimators=10, learning_rate=0.5, odd=1)
    assert known.notes == {"odd": "ignored: 1"} and (scores(known, df) == np.digitize(Y, [-0.3, 0.5])).mean() > 0.9
    assert sum(known.importances().values()) == pytest.approx(1.0)
    assert fit_lightgbm_classifier(df.where("k = 'yes'"), ["a"], "k").predict(df).select("prediction").distinct().collect() == [("yes",)]
    with pytest.raises(ValueError):
        fit_lightgbm_regressor(df.where("false"), ["a"], "y")
