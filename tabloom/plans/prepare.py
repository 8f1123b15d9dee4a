"""Preparation bundle: dates, missing values, encoding, outliers, selection, scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.names import numeric_columns, ref
from ..operators.construct import Products
from ..operators.dates import date_columns
from ..operators.encoding import fit_auto_encoding
from ..operators.missing import check_target, drop_missing, fill_by_neighbors, fill_by_trees, fit_filler
from ..operators.outliers import Treatment, fit_treatment
from ..operators.scaling import Scaler, fit_scaler
from ..operators.scoring import DateStep, Preparation
from ..operators.selection import Selection, select_features

FITTED_FILLS = ("mean", "median", "mode", "most_frequent", "constant")


@dataclass
class Prepared:
    df: DataFrame
    preparation: Preparation
    target_scaler: Scaler | None = None
    notes: list[str] = field(default_factory=list)


def fit_preparation(
    df: DataFrame,
    key: str,
    target: str | None = None,
    missing: str | None = None,
    fill_value: object = None,
    encoding: Sequence[dict] = (),
    scale: str | None = None,
    scale_target: bool = False,
    categorical: Sequence[str] = (),
) -> Prepared:
    """Fit dates, fills, encoders and scalers on ``df`` and apply them in that order.

    Text columns are always encoded. Row-matching fills (knn, tree) and dropping rows
    change the given rows only; new rows then get column means or medians.
    """
    steps: list = []
    notes: list[str] = []
    if target:
        check_target(df, target)
    body = [c for c in df.columns if c not in (key, target)]
    found = [c for c in date_columns(df.select(*[ref(c) for c in body]), categorical)]
    if found:
        steps.append(DateStep(found))
        df = steps[-1].apply(df)
    if missing == "drop":
        df = drop_missing(df, body)
    elif missing in FITTED_FILLS:
        steps.append(fit_filler(df, missing, body, target, fill_value, categorical))
        df = steps[-1].apply(df)
    elif missing in ("knn", "tree"):
        numbers = numeric_columns(df, body, categorical)
        backup = fit_filler(df, "mean", body, target, categorical=categorical)
        fill = fill_by_neighbors if missing == "knn" else fill_by_trees
        df = backup.apply(fill(df, key, numbers))
        steps.append(backup)
        notes.append(f"{missing} fill applies to the fitted rows; new rows get column means")
    elif missing is not None:
        raise ValueError(f"unknown strategy {missing!r}")
    configs = list(encoding) + [{"column_name": key, "encoding_method": "none"}]
    coder = fit_auto_encoding(df, configs, target)
    steps.append(coder)
    df = coder.apply(df)
    notes += [f"{c}: {problem}" for c, problem in coder.errors]
    target_scaler = None
    if scale:
        flags = {n for e in coder.encoders if e.method in ("onehot", "binary", "hash") for n in e.new_columns}
        inputs = [c for c in df.columns if c not in (key, target) and c not in flags]
        steps.append(fit_scaler(df, scale, inputs, categorical=categorical))
        df = steps[-1].apply(df)
        if scale_target and target in numeric_columns(df):
            target_scaler = fit_scaler(df, scale, [target], role="target")
            df = target_scaler.apply(df)
    return Prepared(df, Preparation(steps), target_scaler, notes)


def prepare(df: DataFrame, key: str, **options) -> DataFrame:
    return fit_preparation(df, key, **options).df


def _numbers(df: DataFrame, key: str, target: str | None, options: dict) -> list[str]:
    return options.get("columns") or [c for c in numeric_columns(df) if c not in (key, target)]


def fit_outliers(df: DataFrame, key: str, target: str | None, options: dict) -> Treatment:
    return fit_treatment(
        df, options.get("method", "iqr"), options.get("action", "clip"), options.get("threshold", 1.5),
        _numbers(df, key, target, options), key,
    )


def fit_selection(df: DataFrame, key: str, target: str | None, options: dict) -> Selection:
    settings = {k: v for k, v in options.items() if k != "method"}
    settings["columns"] = _numbers(df, key, target, options)
    return select_features(df, options.get("method", "variance"), target, **settings)


def fit_polynomial(df: DataFrame, key: str, target: str | None, options: dict) -> Products:
    columns = numeric_columns(df, _numbers(df, key, target, options))
    return Products(columns, options.get("degree", 2), options.get("interaction_only", False))


def apply_outliers(df: DataFrame, key: str, target: str | None, options: dict) -> DataFrame:
    return fit_outliers(df, key, target, options).treat(df)


def apply_selection(df: DataFrame, key: str, target: str | None, options: dict) -> DataFrame:
    return fit_selection(df, key, target, options).apply(df)


def apply_polynomial(df: DataFrame, key: str, target: str | None, options: dict) -> DataFrame:
    return fit_polynomial(df, key, target, options).apply(df)
