"""Linear, ridge, lasso, elastic-net and logistic regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from .base import (
    Fitted, MlClassifier, assemble, attach_vector, class_list, fold, is_vector, require_columns, right_size, widths, with_code,
)
from .matrices import covariance, dot


@dataclass
class LinearModel(Fitted):
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0
    spans: list[int] = field(default_factory=list)
    model: object = None

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is not None:  # vector columns
            return self.model.transform(attach_vector(df, self.features)).select(*[ref(c) for c in df.columns], "prediction")
        return df.withColumn("prediction", dot(self.features, self.coefficients, self.intercept))

    def importances(self) -> dict[str, float]:
        return dict(zip(self.features, fold(np.abs(self.coefficients), self.spans or [1] * len(self.features))))


def _fit(df, features, label, fit_intercept, **settings) -> LinearModel:
    data = assemble(df, features, ref(label))
    model = LinearRegression(
        featuresCol="_x", labelCol="_y", fitIntercept=fit_intercept, standardization=False, **settings
    ).fit(data)
    spans = widths(df, features)
    return LinearModel(
        list(features), coefficients=model.coefficients.toArray().tolist(), intercept=float(model.intercept),
        spans=spans, model=model if any(is_vector(df, c) for c in features) else None,
    )


def _target_facts(df: DataFrame, features: Sequence[str], label: str) -> tuple[int, float]:
    kept = df.dropna(subset=[*features, label])
    return tuple(kept.agg(F.count("*"), F.stddev_pop(ref(label).cast("double"))).first())


def fit_linear(
    df: DataFrame, features: Sequence[str], label: str, fit_intercept: bool = True, positive: bool = False
) -> LinearModel:
    """Least squares; ``positive`` solves the non-negative problem on the Gram matrix."""
    if not positive:
        return _fit(df, features, label, fit_intercept, solver=_solver(range(sum(widths(df, features)))), regParam=0.0)
    require_columns(df, features, "a non-negative fit")
    moments = covariance(df.dropna(subset=[*features, label]), [*features, label])
    d = len(features)
    gram, mean = moments.scatter.copy(), moments.mean
    if not fit_intercept:
        gram = gram + moments.n * np.outer(mean, mean)
    weights = non_negative(gram[:d, :d], gram[:d, d])
    intercept = float(mean[d] - mean[:d] @ weights) if fit_intercept else 0.0
    return LinearModel(list(features), coefficients=weights.tolist(), intercept=intercept)


def _solver(features: Sequence) -> str:
    """The normal equations hold d x d numbers on the driver, and Spark takes them up to 4,096 features."""
    return "normal" if len(features) <= 4096 else "l-bfgs"


def non_negative(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Minimise w'Gw/2 - t'w over w >= 0 by active sets."""
    d = len(target)
    w, free = np.zeros(d), np.zeros(d, dtype=bool)
    for _ in range(10 * d + 10):
        slope = target - gram @ w
        slope[free] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-10 * max(1.0, np.abs(target).max()):
            break
        free[j] = True
        while True:
            trial = np.zeros(d)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], target[free], rcond=None)[0]
            if (trial[free] > 0).all():
                break
            falling = free & (trial <= 0)
            step = np.min(w[falling] / np.maximum(w[falling] - trial[falling], 1e-300))
            w = w + step * (trial - w)
            free &= w > 1e-14
            if not free.any():
                trial = np.zeros(d)
                break
        w = trial
    return w


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, fit_intercept: bool = True) -> LinearModel:
    n, spread = _target_facts(df, features, label)
    return _fit(df, features, label, fit_intercept, solver=_solver(range(sum(widths(df, features)))), regParam=alpha * (spread or 1.0) / n)


def fit_lasso(
    df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, fit_intercept: bool = True,
    max_iter: int = 1000, tol: float = 1e-4,
) -> LinearModel:
    return _fit(
        df, features, label, fit_intercept, regParam=alpha, elasticNetParam=1.0, maxIter=max_iter, tol=min(tol, 1e-9)
    )


def fit_elastic_net(
    df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, l1_ratio: float = 0.5,
    fit_intercept: bool = True, max_iter: int = 1000, tol: float = 1e-4,
) -> LinearModel:
    """The solver scales the target by its deviation, so both penalties are rescaled."""
    _, spread = _target_facts(df, features, label)
    spread = spread or 1.0
    l1, l2 = alpha * l1_ratio / spread, alpha * (1 - l1_ratio)
    total = l1 + l2
    return _fit(
        df, features, label, fit_intercept, regParam=total * spread, elasticNetParam=l1 / total if total else 0.0,
        maxIter=max_iter, tol=min(tol, 1e-9),
    )


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str, C: float = 1.0, penalty: str = "l2", l1_ratio: float = 0.5,
    max_iter: int = 100, multi_class: str = "auto", class_weight: str | None = None, tol: float = 1e-6,
) -> MlClassifier:
    classes = class_list(df, label)
    counts = {
        r.c: r.n
        for r in df.dropna(subset=[*features, label]).groupBy(ref(label).alias("c")).agg(F.count("*").alias("n")).collect()
    }
    n = sum(counts.values())
    df = with_code(df, label, classes)
    code = F.col("_code")
    weight = None
    if class_weight == "balanced":
        shares = F.array(*[F.lit(n / (len(counts) * counts.get(c, 1))) for c in classes])
        weight = F.element_at(shares, code.cast("int") + 1)
    data = right_size(assemble(df, features, code, weight), n)
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio, "none": 0.0, None: 0.0}[penalty]
    strength = 0.0 if penalty in ("none", None) else 1.0 / (C * n)
    family = "multinomial" if multi_class == "multinomial" or len(classes) > 2 else "binomial"
    estimator = LogisticRegression(
        featuresCol="_x", labelCol="_y", regParam=strength, elasticNetParam=mix, maxIter=max_iter, family=family,
        standardization=False, tol=tol,
    )
    if weight is not None:
        estimator = estimator.setWeightCol("_w")
    return MlClassifier(list(features), model=estimator.fit(data), classes=classes, spans=widths(df, features))
