"""Grid, random and Bayesian search over key-hashed folds."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, ref
from .lookup import rows_table
from .metrics.classification import classification_metrics, roc_auc
from .metrics.regression import regression_metrics
from .models.catalog import fit_named, is_classifier
from .split import with_fold


@dataclass(frozen=True)
class Real:
    """Uniform draws from [low, high)."""

    low: float
    high: float


@dataclass(frozen=True)
class Whole:
    """Integers from low to high - 1."""

    low: int
    high: int


# Recommended grids per algorithm.
_TREE = {"max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]}
_BOOST = {
    "n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7],
    "min_samples_split": [2, 5], "min_samples_leaf": [1, 2],
}
_LEAFWISE = {
    "n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "num_leaves": [31, 50, 100],
    "max_depth": [-1, 10, 20], "min_child_samples": [20, 30, 50],
}
_NETWORK = {
    "hidden_layer_sizes": [(50,), (100,), (50, 50), (100, 50)], "activation": ["relu", "tanh", "logistic"],
    "solver": ["adam", "sgd"], "alpha": [0.0001, 0.001, 0.01], "learning_rate": ["constant", "adaptive"],
}
GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l1", "l2"], "solver": ["liblinear", "saga"]},
    "random_forest_classifier": {"n_estimators": [50, 100, 200], **_TREE},
    "decision_tree_classifier": {"criterion": ["gini", "entropy"], **_TREE},
    "gradient_boosting_classifier": _BOOST,
    "xgboost_classifier": {
        "n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.3], "subsample": [0.8, 1.0],
    },
    "lightgbm_classifier": _LEAFWISE,
    "catboost_classifier": {
        "iterations": [100, 200, 500], "learning_rate": [0.01, 0.1, 0.2], "depth": [4, 6, 8, 10], "l2_leaf_reg": [1, 3, 5, 7],
    },
    "svm_classifier": {
        "C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto"],
        "degree": [3, 4, 5],
    },
    "naive_bayes": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
    "knn_classifier": {
        "n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"], "algorithm": ["auto", "ball_tree", "kd_tree"],
    },
    "mlp_classifier": _NETWORK,
    "linear_regression": {"fit_intercept": [True, False]},
    "ridge_regression": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "lasso_regression": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0], "fit_intercept": [True, False]},
    "elasticnet_regression": {
        "alpha": [0.001, 0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9], "fit_intercept": [True, False],
    },
    "random_forest_regressor": {
        "n_estimators": [50, 100, 200], "max_depth": [None, 10, 20], "min_samples_split": [2, 5, 10],
    },
    "decision_tree_regressor": {"criterion": ["squared_error", "friedman_mse", "absolute_error"], **_TREE},
    "gradient_boosting_regressor": _BOOST,
    "xgboost_regressor": {
        "n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7],
        "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0],
    },
    "lightgbm_regressor": _LEAFWISE,
    "svr": {
        "C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto"],
        "epsilon": [0.01, 0.1, 0.5],
    },
    "mlp_regressor": _NETWORK,
}

# Recommended distributions per algorithm.
_RANDOM_TREE = {"max_depth": Whole(5, 50), "min_samples_split": Whole(2, 20), "min_samples_leaf": Whole(1, 10)}
_RANDOM_BOOST = {
    "n_estimators": Whole(50, 300), "learning_rate": Real(0.01, 0.31), "max_depth": Whole(3, 10),
    "min_samples_split": Whole(2, 20), "min_samples_leaf": Whole(1, 10),
}
_RANDOM_XGB = {
    "n_estimators": Whole(50, 300), "max_depth": Whole(3, 10), "learning_rate": Real(0.01, 0.31),
    "subsample": Real(0.6, 1.0), "colsample_bytree": Real(0.6, 1.0),
}
_RANDOM_LEAFWISE = {
    "n_estimators": Whole(50, 300), "learning_rate": Real(0.01, 0.31), "num_leaves": Whole(20, 150),
    "max_depth": Whole(-1, 30), "min_child_samples": Whole(10, 100),
}
_RANDOM_NETWORK = {
    "activation": ["relu", "tanh", "logistic"], "solver": ["adam", "sgd"], "alpha": Real(0.0001, 0.1001),
    "learning_rate": ["constant", "adaptive"],
}
DISTRIBUTIONS: dict[str, dict[str, object]] = {
    "logistic_regression": {"C": Real(0.01, 10.01), "penalty": ["l1", "l2"], "solver": ["liblinear", "saga"]},
    "random_forest_classifier": {"n_estimators": Whole(50, 300), **_RANDOM_TREE},
    "decision_tree_classifier": {**_RANDOM_TREE, "criterion": ["gini", "entropy"]},
    "gradient_boosting_classifier": _RANDOM_BOOST,
    "xgboost_classifier": _RANDOM_XGB,
    "lightgbm_classifier": _RANDOM_LEAFWISE,
    "catboost_classifier": {
        "iterations": Whole(50, 500), "learning_rate": Real(0.01, 0.31), "depth": Whole(4, 12), "l2_leaf_reg": Real(1, 11),
    },
    "svm_classifier": {
        "C": Real(0.1, 100.1), "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto"],
    },
    "naive_bayes": {"var_smoothing": Real(1e-10, 1.00001e-5)},
    "knn_classifier": {"n_neighbors": Whole(2, 20), "leaf_size": Whole(10, 50), "weights": ["uniform", "distance"]},
    "mlp_classifier": _RANDOM_NETWORK,
    "linear_regression": {"fit_intercept": [True, False]},
    "ridge_regression": {"alpha": Real(0.1, 100.1)},
    "lasso_regression": {"alpha": Real(0.001, 10.001)},
    "elasticnet_regression": {"alpha": Real(0.001, 10.001), "l1_ratio": Real(0.1, 1.0)},
    "random_forest_regressor": {"n_estimators": Whole(50, 300), **_RANDOM_TREE},
    "decision_tree_regressor": {**_RANDOM_TREE, "criterion": ["squared_error", "friedman_mse", "absolute_error"]},
    "gradient_boosting_regressor": _RANDOM_BOOST,
    "xgboost_regressor": _RANDOM_XGB,
    "lightgbm_regressor": _RANDOM_LEAFWISE,
    "svr": {
        "C": Real(0.1, 100.1), "epsilon": Real(0.01, 0.51), "gamma": ["scale", "auto"], "kernel": ["linear", "rbf", "poly"],
    },
    "mlp_regressor": _RANDOM_NETWORK,
}
SCORES = ("accuracy", "f1", "roc_auc", "r2")


@dataclass
class SearchResult:
    trials: DataFrame
    best_parameters: dict
    best_score: float
    method: str
    algorithm: str

    def history_row(self) -> dict:
        """Row for the registry's tuning table."""
        return {
            "algorithm": self.algorithm, "method": self.method, "best_parameters": json.dumps(self.best_parameters),
            "best_score": self.best_score, "trials": self.trials.count(),
        }


def pick_score(df: DataFrame, label: str, algorithm: str, scoring: str | None) -> str:
    """Classes score by accuracy, continuous targets by r2; accuracy of a continuous target becomes r2."""
    continuous = not is_classifier(algorithm)
    if continuous and label in numeric_columns(df) and scoring is None:
        return "r2"
    if scoring is None:
        return "accuracy"
    if scoring not in SCORES:
        raise ValueError(f"unknown scoring {scoring!r}")
    return "r2" if continuous and scoring == "accuracy" else scoring


def score_model(model, df: DataFrame, label: str, scoring: str) -> float:
    scored = model.predict(df)
    if scoring == "r2":
        rows = regression_metrics(scored, label, "prediction")
        return rows.where("metric = 'r2'").first()["value"]
    if scoring == "roc_auc":
        classes = model.classes[1:] if len(model.classes) == 2 else model.classes
        return roc_auc(scored, label, {c: f"probability_{c}" for c in classes}).first()["value"]
    name = {"accuracy": "accuracy", "f1": "f1_score"}[scoring]
    return classification_metrics(scored, label, "prediction").where(F.col("metric") == name).first()["value"]


def cross_scores(
    folds: DataFrame, algorithm: str, features: list[str], label: str, key: str, params: dict, cv: int, scoring: str,
    fold: str = "_fold",
) -> list[float]:
    """Score on each fold of a model fitted on the others."""
    out = []
    for i in range(cv):
        train, test = folds.where(F.col(fold) != i), folds.where(F.col(fold) == i)
        model = fit_named(algorithm, train, features, label, key, **params)
        out.append(score_model(model, test, label, scoring))
    return out


def _prepared(df: DataFrame, algorithm: str, features: list[str], label: str, key: str, cv: int, seed: int) -> DataFrame:
    stratum = label if is_classifier(algorithm) else None
    needed = df.select(ref(key), *[ref(c) for c in features], ref(label))
    return with_fold(needed, key, cv, stratum, seed, "_fold").persist()


def _search(
    df, algorithm, features, label, key, cv, scoring, seed, method, propose: Callable[[list], dict | None], parallelism: int = 1
) -> SearchResult:
    scoring = pick_score(df, label, algorithm, scoring)
    folds = _prepared(df, algorithm, features, label, key, cv, seed)
    done: list[tuple[dict, list[float]]] = []
    try:

        def run(params: dict) -> tuple[dict, list[float]]:
            """A trial that cannot be fitted has no score and ranks last; the search goes on."""
            try:
                scores = cross_scores(folds, algorithm, features, label, key, params, cv, scoring)
            except (ValueError, TypeError, ArithmeticError, CapturedException):
                return params, []
            return params, [float(v) for v in scores if v is not None and not math.isnan(v)]

        if parallelism > 1:
            # independent trials share the cluster as concurrent Spark jobs
            planned = list(iter(lambda: propose([]), None))
            with ThreadPoolExecutor(parallelism) as pool:
                done = list(pool.map(run, planned))
        else:
            while (params := propose(done)) is not None:
                done.append(run(params))
    finally:
        folds.unpersist()
    means = [float(np.mean(s)) if s else None for _, s in done]
    if not any(s for _, s in done):
        raise ValueError("no trial could be scored")
    order = sorted(range(len(done)), key=lambda i: (means[i] is None, -(means[i] or 0.0), i))
    rank = {i: r + 1 for r, i in enumerate(order)}
    rows = [
        (i, json.dumps(p, sort_keys=True), means[i], float(np.std(s)) if s else None, rank[i], s)
        for i, (p, s) in enumerate(done)
    ]
    trials = rows_table(
        df.sparkSession, rows,
        "trial int, parameters string, mean_score double, std_score double, rank int, fold_scores array<double>",
    )
    return SearchResult(trials, done[order[0]][0], means[order[0]], method, algorithm)


def grid_search(
    df: DataFrame, algorithm: str, features: list[str], label: str, key: str, grid: dict[str, Sequence] | None = None,
    cv: int = 5, scoring: str | None = None, seed: int = 42, parallelism: int = 4,
) -> SearchResult:
    """Every combination of the grid."""
    grid = grid or GRIDS[algorithm]
    plans = iter([dict(zip(grid, values)) for values in itertools.product(*grid.values())])
    return _search(
        df, algorithm, features, label, key, cv, scoring, seed, "grid", lambda _: next(plans, None), parallelism
    )


def draw(space: dict[str, object], generator: np.random.Generator) -> dict:
    out = {}
    for name, choice in space.items():
        if isinstance(choice, Real):
            out[name] = float(generator.uniform(choice.low, choice.high))
        elif isinstance(choice, Whole):
            out[name] = int(generator.integers(choice.low, choice.high))
        elif isinstance(choice, (list, tuple)):
            out[name] = choice[int(generator.integers(len(choice)))]
        else:
            out[name] = choice
    return out


def random_search(
    df: DataFrame, algorithm: str, features: list[str], label: str, key: str, space: dict[str, object] | None = None,
    n_iter: int = 100, cv: int = 5, scoring: str | None = None, seed: int = 42, parallelism: int = 4,
) -> SearchResult:
    space = space or DISTRIBUTIONS[algorithm]
    generator = np.random.default_rng(seed)
    plans = iter([draw(space, generator) for _ in range(n_iter)])
    return _search(
        df, algorithm, features, label, key, cv, scoring, seed, "random", lambda _: next(plans, None), parallelism
    )


def _coordinates(params: dict, space: dict[str, object]) -> list[float]:
    """Parameters on [0, 1]; a choice list becomes one axis per value."""
    out: list[float] = []
    for name, choice in space.items():
        if isinstance(choice, (Real, Whole)):
            out.append((params[name] - choice.low) / max(choice.high - choice.low, 1e-300))
        elif isinstance(choice, (list, tuple)):
            out += [float(params[name] == v) for v in choice]
    return out


def expected_gain(seen: np.ndarray, scores: np.ndarray, offered: np.ndarray, length: float = 0.3) -> np.ndarray:
    """Expected improvement under a Gaussian process with a squared-exponential kernel."""

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) / (2 * length * length))

    spread = scores.std() or 1.0
    y = (scores - scores.mean()) / spread
    factor = np.linalg.cholesky(kernel(seen, seen) + 1e-6 * np.eye(len(seen)))
    cross = np.linalg.solve(factor, kernel(seen, offered))
    mean = cross.T @ np.linalg.solve(factor, y)
    deviation = np.sqrt(np.maximum(1.0 - (cross**2).sum(axis=0), 1e-12))
    z = (mean - y.max()) / deviation
    density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    share = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    return deviation * (z * share + density)


def bayesian_search(
    df: DataFrame, algorithm: str, features: list[str], label: str, key: str, space: dict[str, object] | None = None,
    n_iter: int = 50, cv: int = 5, scoring: str | None = None, seed: int = 42, warmup: int = 5, offers: int = 500,
) -> SearchResult:
    """One trial at a time: a few random ones, then the draw that promises most."""
    space = space or DISTRIBUTIONS[algorithm]
    generator = np.random.default_rng(seed)

    def propose(done: list) -> dict | None:
        if len(done) >= n_iter:
            return None
        if len(done) < warmup:
            return draw(space, generator)
        drawn = [draw(space, generator) for _ in range(offers)]
        seen = np.array([_coordinates(p, space) for p, _ in done])
        scores = np.array([np.mean(s) for _, s in done])
        gain = expected_gain(seen, scores, np.array([_coordinates(p, space) for p in drawn]))
        return drawn[int(gain.argmax())]

    return _search(df, algorithm, features, label, key, cv, scoring, seed, "bayesian", propose)
