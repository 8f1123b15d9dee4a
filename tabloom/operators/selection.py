"""Feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, ref, replace_columns, text_columns
from ..functions.parsing import clean_number
from .encoding import fit_encoder
from .lookup import rows_table

CLASS_LIMIT = 10


@dataclass
class Selection:
    method: str
    considered: list[str]
    selected: list[str]
    scores: dict[str, float] = field(default_factory=dict)
    target: str | None = None

    @property
    def dropped(self) -> list[str]:
        return [c for c in self.considered if c not in self.selected]

    def apply(self, df: DataFrame) -> DataFrame:
        """Selected columns, then the columns that took no part, then the target."""
        rest = [c for c in df.columns if c not in self.considered and c != self.target]
        last = [self.target] if self.target in df.columns else []
        kept = [c for c in self.selected if c in df.columns]
        return df.select(*[ref(c) for c in [*kept, *rest, *last]])

    def report(self, spark) -> DataFrame:
        rows = [
            (c, self.method, c in self.selected, None if c not in self.scores else float(self.scores[c]))
            for c in self.considered
        ]
        return rows_table(spark, rows, "column_name string, method string, selected boolean, score double")


def _candidates(df: DataFrame, columns: Sequence[str] | None, target: str | None) -> list[str]:
    return [c for c in numeric_columns(df, columns) if c != target]


def by_variance(df: DataFrame, threshold: float = 0.0, columns=None, target: str | None = None) -> Selection:
    names = _candidates(df, columns, target)
    row = df.agg(*[F.var_pop(clean_number(ref(c))).alias(c) for c in names]).first()
    kept = [c for c in names if row[c] is not None and row[c] > threshold]
    return Selection("variance", names, kept, row.asDict(), target)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of all column pairs over the rows where both are present."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return {}
    row = df.agg(
        *[F.corr(clean_number(ref(a)), clean_number(ref(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    ).first()
    return {p: (None if v is None or np.isnan(v) else v) for p, v in zip(pairs, row)}


def by_correlation(df: DataFrame, threshold: float = 0.9, columns=None, target: str | None = None) -> Selection:
    """Drop the later column of every pair whose correlation is above the threshold."""
    names = _candidates(df, columns, target)
    found = correlation_pairs(df, names)
    dropped = {b for (_, b), v in found.items() if v is not None and abs(v) > threshold}
    strongest = {
        c: max((abs(v) for p, v in found.items() if p[1] == c and v is not None), default=0.0) for c in names
    }
    return Selection("correlation", names, [c for c in names if c not in dropped], strongest, target)


def is_class_target(df: DataFrame, target: str) -> bool:
    """Texts, and numbers with fewer than ten values, are classes."""
    if target in text_columns(df):
        return True
    return df.select(ref(target)).distinct().limit(CLASS_LIMIT).count() < CLASS_LIMIT


def _forest_input(df: DataFrame, names: Sequence[str], target: str) -> tuple[DataFrame, bool]:
    classes = is_class_target(df, target)
    base = fit_encoder(df, "label", target).apply(df) if classes else df
    means = base.agg(*[F.avg(clean_number(ref(c))).alias(c) for c in names]).first()
    filled = replace_columns(
        base, {c: F.coalesce(clean_number(ref(c)), F.lit(means[c] if means[c] is not None else 0.0)) for c in names}
    )
    return filled.select(*[ref(c) for c in names], ref(target).cast("double").alias("_y")), classes


def forest_importances(data: DataFrame, names: Sequence[str], classes: bool, trees: int, seed: int) -> dict[str, float]:
    packed = VectorAssembler(inputCols=list(names), outputCol="_x").transform(data)
    kind = RandomForestClassifier if classes else RandomForestRegressor
    model = kind(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed).fit(packed)
    return dict(zip(names, model.featureImportances.toArray().tolist()))


def by_importance(
    df: DataFrame, target: str, n_features: int | None = None, threshold: float = 0.0, columns=None,
    trees: int = 100, seed: int = 42,
) -> Selection:
    """Top n, else at or above the threshold, else at or above the mean importance."""
    names = _candidates(df, columns, target)
    data, classes = _forest_input(df, names, target)
    scores = forest_importances(data, names, classes, trees, seed)
    if n_features:
        kept = sorted(names, key=lambda c: -scores[c])[:n_features]
    else:
        cut = threshold if threshold > 0 else float(np.mean(list(scores.values())))
        kept = [c for c in names if scores[c] >= cut]
    return Selection("importance", names, kept, scores, target)


def by_elimination(
    df: DataFrame, target: str, n_features: int | None = None, columns=None, trees: int = 100, seed: int = 42
) -> Selection:
    """Drop the weakest column and refit until n (default half) are left; scores are ranks."""
    names = _candidates(df, columns, target)
    goal = n_features or len(names) // 2
    data, classes = _forest_input(df, names, target)
    data = data.persist()
    try:
        left, ranks = list(names), {}
        while len(left) > max(goal, 1):
            scores = forest_importances(data, left, classes, trees, seed)
            weakest = min(left, key=lambda c: scores[c])
            ranks[weakest] = len(left) - goal + 1
            left.remove(weakest)
    finally:
        data.unpersist()
    return Selection("recursive", names, left, {c: float(ranks.get(c, 1)) for c in names}, target)


def f_scores(df: DataFrame, names: Sequence[str], target: str, classes: bool) -> dict[str, float | None]:
    """ANOVA F for classes, regression F for numbers."""
    if not classes:
        row = df.agg(
            F.count("*").alias("_n"),
            *[F.corr(clean_number(ref(c)), clean_number(ref(target))).alias(c) for c in names],
        ).first()
        return {
            c: None if row[c] is None or np.isnan(row[c]) or row[c] ** 2 >= 1 else row[c] ** 2 / (1 - row[c] ** 2) * (row["_n"] - 2)
            for c in names
        }
    overall = df.agg(*[F.avg(clean_number(ref(c))).alias(c) for c in names]).first()
    # one struct per class and column; the classes are folded by a second aggregate
    by_class = df.groupBy(ref(target).alias("_class")).agg(
        *[
            F.struct(
                F.count(clean_number(ref(c))).alias("n"),
                F.avg(clean_number(ref(c))).alias("m"),
                F.var_pop(clean_number(ref(c))).alias("v"),
            ).alias(f"s{i}")
            for i, c in enumerate(names)
        ]
    )
    row = by_class.agg(
        F.count("*").alias("_classes"),
        *[
            F.struct(
                F.sum(F.col(f"s{i}.n")).alias("n"),
                F.sum(F.col(f"s{i}.n") * F.pow(F.col(f"s{i}.m") - F.lit(overall[c]), 2)).alias("between"),
                F.sum(F.col(f"s{i}.n") * F.col(f"s{i}.v")).alias("within"),
            ).alias(f"s{i}")
            for i, c in enumerate(names)
            if overall[c] is not None
        ],
    ).first()
    out: dict[str, float | None] = {}
    for i, c in enumerate(names):
        s = row[f"s{i}"] if overall[c] is not None else None
        if s is None or not s.within or row["_classes"] < 2:
            out[c] = None
        else:
            out[c] = (s.between / (row["_classes"] - 1)) / (s.within / (s.n - row["_classes"]))
    return out


def by_f_score(df: DataFrame, target: str, k: int = 10, columns=None, classes: bool | None = None) -> Selection:
    """The k columns with the highest F statistic."""
    names = _candidates(df, columns, target)
    classes = is_class_target(df, target) if classes is None else classes
    scores = f_scores(df, names, target, classes)
    ranked = sorted((c for c in names if scores[c] is not None), key=lambda c: -scores[c])[:k]
    known = {c: s for c, s in scores.items() if s is not None}
    return Selection("f_score", names, [c for c in names if c in ranked], known, target)


def select_features(df: DataFrame, method: str, target: str | None = None, **options) -> Selection:
    """One entry point: variance, correlation, importance, recursive or f_score."""
    if method in ("variance", "correlation"):
        return {"variance": by_variance, "correlation": by_correlation}[method](df, target=target, **options)
    if target is None:
        raise ValueError(f"{method} selection needs a target column")
    kinds = {"importance": by_importance, "recursive": by_elimination, "f_score": by_f_score}
    if method not in kinds:
        raise ValueError(f"unknown selection method {method!r}")
    return kinds[method](df, target, **options)
