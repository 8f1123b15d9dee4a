"""Kernel maps through landmarks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators.models import margin
from tabloom.plans.store import Store

DRAW = np.random.default_rng(5)
N = 120
X = DRAW.normal(0, 1, (N, 2))
RING = np.where((X**2).sum(axis=1) > 1.4, "out", "in")


@pytest.fixture(scope="module")
def df(spark):
    frame = pd.DataFrame(X, columns=["a", "b"]).assign(id=range(N), k=RING, y=(X**2).sum(axis=1))
    return spark.createDataFrame(frame).repartition(3).cache()


@pytest.mark.parametrize("kernel,offset", [("rbf", 0.0), ("poly", 0.0), ("poly", 1.0)])
def test_exact_when_landmarks_are_all_rows(df, kernel, offset):
    space = margin.fit_kernel_map(df, ["a", "b"], kernel, 0.4, 3, 10_000, 1, "landmarks", offset)
    inner = X @ X.T
    apart = ((X[:, None] - X[None]) ** 2).sum(axis=2)
    want = np.exp(-0.4 * apart) if kernel == "rbf" else (0.4 * inner + offset) ** 3
    assert len(space.landmarks) == N and np.allclose(space(X) @ space(X).T, want, atol=1e-5)


def test_sigmoid_is_exact_on_its_positive_part(df):
    space = margin.fit_kernel_map(df, ["a", "b"], "sigmoid", 0.3, 3, 10_000, 1, "landmarks", 0.2)
    values, vectors = np.linalg.eigh(np.tanh(0.3 * X @ X.T + 0.2))
    want = (vectors * np.maximum(values, 0)) @ vectors.T
    assert np.allclose(space(X) @ space(X).T, want, atol=1e-5)


def test_landmarks_do_not_depend_on_layout_or_copies(df):
    one = margin.pick_landmarks(df.coalesce(1), ["a", "b"], 10, 3)
    twice = margin.pick_landmarks(df.union(df).repartition(5), ["a", "b"], 10, 3)
    assert one.shape == (10, 2) and np.array_equal(one, twice)


def test_machines_learn_a_ring_and_are_kept(spark, df, tmp_path):
    model = margin.fit_svm(df, ["a", "b"], "k", kernel="rbf", components=30, max_iter=30, method="landmarks")
    scored = model.predict(df)
    assert model.kernel.size <= 30 and scored.where("prediction = k").count() > 0.95 * N
    store = Store(spark, str(tmp_path))
    store.save("ring", model)
    again = store.load("ring").predict(df).select("id", "prediction")
    assert again.exceptAll(scored.select("id", "prediction")).isEmpty()
    line = margin.fit_svr(df, ["a", "b"], "y", "id", kernel="poly", degree=2, method="landmarks", coef0=1.0, C=100.0)
    error = line.predict(df).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert error < 0.5


def test_refused(df):
    for bad in ({"kernel": "sigmoid"}, {"method": "other"}):
        with pytest.raises(ValueError):
            margin.fit_svm(df, ["a", "b"], "k", **bad)
    explicit = margin.fit_svm(df, ["a", "b"], "k", kernel="poly", degree=2, coef0=1.0, max_iter=3)
    assert explicit.notes == {"coef0": "ignored: 1.0"}
    with pytest.raises(ValueError, match="complete row"):
        margin.fit_kernel_map(df.where("false"), ["a", "b"], "rbf", 1.0, 3, 5, 1, "landmarks")
