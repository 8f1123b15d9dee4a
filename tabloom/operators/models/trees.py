"""Decision trees, forests and boosting, with settings for the boosting libraries' parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref, text_columns
from ...sources.shared import settle
from ..encoding import Encoder, fit_encoder, ordered_target
from .base import Fitted, MlClassifier, MlRegressor, RestClassifier, assemble, class_list, right_size, widths, with_code
from .histogram import Growth, fit_boosted_trees

#: Fixed value: the deepest tree that pyspark.ml grows.
DEEPEST = 30


def _depth(value: int | None) -> int:
    return DEEPEST if value is None or value < 0 else min(value, DEEPEST)


def _depth_note(value: int | None, options: dict) -> dict[str, str]:
    """Notes on ignored options and on a depth that is cut."""
    notes = _notes(options)
    if value is not None and value > DEEPEST:
        notes["max_depth"] = f"{DEEPEST} instead of {value}"
    return notes


def _subset(value) -> str:
    if value in (None, "all", 1.0):
        return "all"
    return {"sqrt": "sqrt", "log2": "log2"}.get(value, str(value))


def _notes(options: dict) -> dict[str, str]:
    """Options without a counterpart are reported, not silently dropped."""
    return {k: f"ignored: {v}" for k, v in options.items()}


def fit_tree_classifier(
    df: DataFrame, features: Sequence[str], label: str, criterion: str = "gini", max_depth: int | None = None,
    min_samples_leaf: int = 1, max_bins: int = 32, random_state: int = 42, **ignored,
) -> MlClassifier:
    classes = class_list(df, label)
    model = DecisionTreeClassifier(
        featuresCol="_x", labelCol="_y", impurity=criterion, maxDepth=_depth(max_depth),
        minInstancesPerNode=min_samples_leaf, maxBins=max_bins, seed=random_state,
    ).fit(assemble(with_code(df, label, classes), features, F.col("_code"), classes=len(classes)))
    return MlClassifier(list(features), _depth_note(max_depth, ignored), model, classes, widths(df, features))


def fit_forest_classifier(
    df: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100, criterion: str = "gini",
    max_depth: int | None = None, max_features="sqrt", min_samples_leaf: int = 1, bootstrap: bool = True,
    max_bins: int = 32, random_state: int = 42, **ignored,
) -> MlClassifier:
    classes = class_list(df, label)
    model = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=n_estimators, impurity=criterion, maxDepth=_depth(max_depth),
        featureSubsetStrategy=_subset(max_features), minInstancesPerNode=min_samples_leaf, bootstrap=bootstrap,
        maxBins=max_bins, seed=random_state,
    ).fit(assemble(with_code(df, label, classes), features, F.col("_code"), classes=len(classes)))
    return MlClassifier(list(features), _depth_note(max_depth, ignored), model, classes, widths(df, features))


def fit_boosting_classifier(
    df: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100, learning_rate: float = 0.1,
    max_depth: int = 3, subsample: float = 1.0, min_samples_leaf: int = 1, max_features=None, min_gain: float = 0.0,
    max_bins: int = 32, random_state: int = 42, **ignored,
) -> MlClassifier | RestClassifier:
    """Two classes boost once; more classes boost one-versus-rest."""
    classes = class_list(df, label)
    base = GBTClassifier(
        featuresCol="_x", labelCol="_y", maxIter=n_estimators, stepSize=learning_rate, maxDepth=_depth(max_depth),
        subsamplingRate=subsample, minInstancesPerNode=min_samples_leaf, featureSubsetStrategy=_subset(max_features),
        minInfoGain=min_gain, maxBins=max_bins, seed=random_state,
    )
    whole = assemble(with_code(df, label, classes), features, F.col("_code")).persist()
    try:
        data = right_size(whole, whole.count())
        if len(classes) <= 2:
            return MlClassifier(list(features), _depth_note(max_depth, ignored), base.fit(data), classes, widths(df, features))
        models = [
            base.fit(data.withColumn("_y", (F.col("_y") == i).cast("double"))) for i in range(len(classes))
        ]
    finally:
        whole.unpersist()
    return RestClassifier(list(features), _depth_note(max_depth, ignored), models, classes, widths(df, features))


def fit_tree_regressor(
    df: DataFrame, features: Sequence[str], label: str, max_depth: int | None = None, min_samples_leaf: int = 1,
    max_bins: int = 32, random_state: int = 42, **ignored,
) -> MlRegressor:
    model = DecisionTreeRegressor(
        featuresCol="_x", labelCol="_y", maxDepth=_depth(max_depth), minInstancesPerNode=min_samples_leaf,
        maxBins=max_bins, seed=random_state,
    ).fit(assemble(df, features, ref(label)))
    return MlRegressor(list(features), _depth_note(max_depth, ignored), model, widths(df, features))


def fit_forest_regressor(
    df: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100, max_depth: int | None = None,
    max_features=1.0, min_samples_leaf: int = 1, bootstrap: bool = True, max_bins: int = 32, random_state: int = 42,
    **ignored,
) -> MlRegressor:
    model = RandomForestRegressor(
        featuresCol="_x", labelCol="_y", numTrees=n_estimators, maxDepth=_depth(max_depth),
        featureSubsetStrategy=_subset(max_features), minInstancesPerNode=min_samples_leaf, bootstrap=bootstrap,
        maxBins=max_bins, seed=random_state,
    ).fit(assemble(df, features, ref(label)))
    return MlRegressor(list(features), _depth_note(max_depth, ignored), model, widths(df, features))


def fit_boosting_regressor(
    df: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100, learning_rate: float = 0.1,
    max_depth: int = 3, subsample: float = 1.0, min_samples_leaf: int = 1, max_features=None, min_gain: float = 0.0,
    max_bins: int = 32, random_state: int = 42, **ignored,
) -> MlRegressor:
    model = GBTRegressor(
        featuresCol="_x", labelCol="_y", maxIter=n_estimators, stepSize=learning_rate, maxDepth=_depth(max_depth),
        subsamplingRate=subsample, minInstancesPerNode=min_samples_leaf, featureSubsetStrategy=_subset(max_features),
        minInfoGain=min_gain, maxBins=max_bins, seed=random_state,
    ).fit(assemble(df, features, ref(label)))
    return MlRegressor(list(features), _depth_note(max_depth, ignored), model, widths(df, features))


def xgboost_settings(
    n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 6, min_child_weight: float = 1.0,
    subsample: float = 1.0, colsample_bytree: float = 1.0, gamma: float = 0.0, reg_alpha: float = 0.0, reg_lambda: float = 1.0,
    max_leaves: int = 0, max_bin: int = 255, **rest,
) -> dict:
    """Level by level; second derivatives of several classes count twice.

    ``gamma`` is the least gain of a split; a split below it is not tried further, there is no later pruning.
    """
    return {
        "n_estimators": n_estimators, "subsample": subsample, "colsample": colsample_bytree, "max_bins": max_bin, "class_factor": 2.0,
        "rule": Growth(
            rate=learning_rate, max_depth=max_depth, leaves=max_leaves or None, alpha=reg_alpha, penalty=reg_lambda, min_gain=gamma,
            min_weight=min_child_weight,
        ),
        "notes": _notes(rest),
    }


def lightgbm_settings(
    n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = -1, num_leaves: int = 31, min_child_samples: int = 20,
    min_child_weight: float = 1e-3, min_split_gain: float = 0.0, subsample: float = 1.0, colsample_bytree: float = 1.0,
    reg_alpha: float = 0.0, reg_lambda: float = 0.0, max_bin: int = 255, **rest,
) -> dict:
    """Best leaf first up to ``num_leaves``. ``subsample`` is drawn anew in every round."""
    return {
        "n_estimators": n_estimators, "subsample": subsample, "colsample": colsample_bytree, "max_bins": max_bin,
        "rule": Growth(
            rate=learning_rate, max_depth=max_depth, leaves=num_leaves, alpha=reg_alpha, penalty=reg_lambda, min_gain=min_split_gain,
            min_weight=min_child_weight, min_rows=min_child_samples,
        ),
        "notes": _notes(rest),
    }


def catboost_preset(
    iterations: int = 100, learning_rate: float = 0.1, depth: int = 6, border_count: int = 254, **rest
) -> dict:
    return {
        "n_estimators": iterations, "learning_rate": learning_rate, "max_depth": depth, "max_bins": border_count + 1,
        **{"l2_leaf_reg": 3.0, "bagging_temperature": 1.0, "random_strength": 1.0, **rest},
    }


@dataclass
class EncodedFit(Fitted):
    """A fitted model behind target-encoded text columns."""

    inner: Fitted = None
    encoders: list[Encoder] = None

    @property
    def classes(self):
        return self.inner.classes

    def predict(self, df: DataFrame) -> DataFrame:
        coded = df.select(*[ref(c) for c in df.columns], *[ref(e.column).alias(f"_raw_{e.column}") for e in self.encoders])
        for e in self.encoders:
            coded = e.apply(coded)
        out = self.inner.predict(coded)
        raw = {e.column: ref(f"_raw_{e.column}").alias(e.column) for e in self.encoders}
        return out.select(*[raw.get(c, ref(c)) for c in out.columns if not c.startswith("_raw_")])

    def importances(self):
        return self.inner.importances()


def fit_xgboost_classifier(df, features, label, key: str | None = None, random_state: int = 42, **options):
    return fit_boosted_trees(df, features, label, "classification", key, random_state=random_state, **xgboost_settings(**options))


def fit_lightgbm_classifier(df, features, label, key: str | None = None, random_state: int = 42, **options):
    return fit_boosted_trees(df, features, label, "classification", key, random_state=random_state, **lightgbm_settings(**options))


def fit_catboost_classifier(df, features, label, key: str | None = None, random_state: int = 42, **options):
    """Text features become ordered target statistics of the class code before boosting.

    A fitted row is coded by the rows before it in a hashed order, a new row by all fitted rows.
    """
    classes = class_list(df, label)
    coded = with_code(df, label, classes).where(F.col("_code").isNotNull())
    texts = text_columns(df, features)
    encoders = [fit_encoder(coded, "target", c, "_code", smoothing=1.0) for c in texts]
    for i, c in enumerate(texts):
        coded = settle(ordered_target(coded, c, "_code", key, 1.0, random_state + i), "ordered")
    inner = fit_boosting_classifier(coded.drop("_code"), features, label, random_state=random_state, **catboost_preset(**options))
    return EncodedFit(list(features), inner.notes, inner, encoders)


def fit_xgboost_regressor(df, features, label, key: str | None = None, random_state: int = 42, **options):
    return fit_boosted_trees(df, features, label, "regression", key, random_state=random_state, **xgboost_settings(**options))


def fit_lightgbm_regressor(df, features, label, key: str | None = None, random_state: int = 42, **options):
    return fit_boosted_trees(df, features, label, "regression", key, random_state=random_state, **lightgbm_settings(**options))
