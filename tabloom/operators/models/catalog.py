"""Estimators by name, with their kind and whether they need a row key."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame

from . import bayes, cluster, decomposition, density, graphs, linear, margin, nearest, neural, trees

CLASSIFIERS = {
    "logistic_regression": linear.fit_logistic,
    "decision_tree_classifier": trees.fit_tree_classifier,
    "random_forest_classifier": trees.fit_forest_classifier,
    "gradient_boosting_classifier": trees.fit_boosting_classifier,
    "xgboost_classifier": trees.fit_xgboost_classifier,
    "lightgbm_classifier": trees.fit_lightgbm_classifier,
    "catboost_classifier": trees.fit_catboost_classifier,
    "svm_classifier": margin.fit_svm,
    "naive_bayes": bayes.fit_naive_bayes,
    "knn_classifier": nearest.fit_nearest,
    "mlp_classifier": neural.fit_mlp_classifier,
}
REGRESSORS = {
    "linear_regression": linear.fit_linear,
    "ridge_regression": linear.fit_ridge,
    "lasso_regression": linear.fit_lasso,
    "elasticnet_regression": linear.fit_elastic_net,
    "decision_tree_regressor": trees.fit_tree_regressor,
    "random_forest_regressor": trees.fit_forest_regressor,
    "gradient_boosting_regressor": trees.fit_boosting_regressor,
    "xgboost_regressor": trees.fit_xgboost_regressor,
    "lightgbm_regressor": trees.fit_lightgbm_regressor,
    "svr": margin.fit_svr,
    "mlp_regressor": neural.fit_mlp_regressor,
}
#: Fits that give a model for new rows, and those that give (key, cluster) of their own rows.
CLUSTER_MODELS = {"kmeans": cluster.fit_kmeans, "gmm": cluster.fit_mixture}
CLUSTER_LABELS = {"dbscan": density.dbscan, "hierarchical": cluster.hierarchical, "spectral": cluster.spectral}
#: Projections for new rows (lda needs a target), and neighbour graphs (src, dst, weight).
PROJECTIONS = {"pca": decomposition.fit_pca, "lda": decomposition.fit_discriminant}
GRAPHS = {"tsne": graphs.perplexity_graph, "umap": graphs.fuzzy_graph}
#: Parameters that have another name here.
RENAMED = {"pca": {"n_components": "components"}, "lda": {"n_components": "components"}}


def kind_of(name: str) -> str:
    """classification, regression, clustering or reduction."""
    kinds = {
        "classification": (CLASSIFIERS,), "regression": (REGRESSORS,), "clustering": (CLUSTER_MODELS, CLUSTER_LABELS),
        "reduction": (PROJECTIONS, GRAPHS),
    }
    for kind, tables in kinds.items():
        if any(name in t for t in tables):
            return kind
    raise ValueError(f"unknown algorithm {name!r}")


def is_classifier(name: str) -> bool:
    return kind_of(name) == "classification"


def fit_unsupervised(
    name: str, df: DataFrame, features: list[str], key: str, target: str | None = None, **params
) -> tuple[object | None, DataFrame, dict[str, str]]:
    """(model for new rows or None, result for these rows, notes).

    Clusterings give the rows with ``cluster``, projections the rows with their components, and
    neighbour graphs their edges.
    """
    fit = (CLUSTER_MODELS | CLUSTER_LABELS | PROJECTIONS | GRAPHS)[name]
    params = {RENAMED.get(name, {}).get(k, k): v for k, v in params.items()}
    known = inspect.signature(fit).parameters
    notes = {k: f"ignored: {v}" for k, v in params.items() if k not in known}
    used = {k: v for k, v in params.items() if k in known}
    if name in CLUSTER_MODELS or name == "pca":
        model = fit(df, features, **used)
        return model, model.predict(df), notes
    if name == "lda":
        if target is None:
            raise ValueError("lda needs a target column")
        model = fit(df, features, target, **used)
        return model, model.predict(df), notes
    found = fit(df, key, features, **used)
    return None, found if name in GRAPHS else df.join(found, key), notes


def fit_named(name: str, df: DataFrame, features: list[str], label: str, key: str, **params):
    """Fit by name; parameters the estimator does not know are noted on the model."""
    fit = CLASSIFIERS[name] if is_classifier(name) else REGRESSORS[name]
    known = inspect.signature(fit).parameters
    if "key" in known:
        params["key"] = key
    if any(p.kind == p.VAR_KEYWORD for p in known.values()):
        return fit(df, features, label, **params)
    used = {k: v for k, v in params.items() if k in known}
    model = fit(df, features, label, **used)
    model.notes.update({k: f"ignored: {v}" for k, v in params.items() if k not in known})
    return model


def feature_importance(model, spark) -> DataFrame:
    """(feature, importance), empty when the model has none."""
    found = model.importances() or {}
    return spark.createDataFrame(sorted(found.items(), key=lambda p: -p[1]), "feature string, importance double")
