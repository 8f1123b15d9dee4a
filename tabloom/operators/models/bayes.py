"""Gaussian naive Bayes from one grouped aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ..lookup import rows_table
from .base import Fitted, require_columns, with_probabilities

#: Numbers of means that are written into one expression; models with more are applied as a matrix.
WRITTEN = 100


@dataclass
class NaiveBayes(Fitted):
    classes: list = field(default_factory=list)
    priors: list[float] = field(default_factory=list)
    means: list[list[float]] = field(default_factory=list)
    variances: list[list[float]] = field(default_factory=list)

    def table(self, spark) -> DataFrame:
        rows = [
            (str(c), self.priors[i], f, self.means[i][j], self.variances[i][j])
            for i, c in enumerate(self.classes)
            for j, f in enumerate(self.features)
        ]
        return rows_table(spark, rows, "class string, prior double, feature string, mean double, variance double")

    def _log_densities(self) -> Column:
        """Joint log density of each class, for few numbers as one expression."""
        logs = []
        for i in range(len(self.classes)):
            total = F.lit(math.log(self.priors[i]))
            for c, m, v in zip(self.features, self.means[i], self.variances[i]):
                gap = ref(c).cast("double") - F.lit(m)
                total = total - F.lit(0.5 * math.log(2 * math.pi * v)) - gap * gap / F.lit(2 * v)
            logs.append(total)
        return F.array(*logs)

    def _matrix_shares(self) -> Column:
        """Probabilities for many classes: rows of a batch against all classes, in blocks."""
        prior, mean, var = np.log(self.priors), np.array(self.means), np.array(self.variances)
        start = prior - 0.5 * np.log(2 * np.pi * var).sum(axis=1)

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            out = []
            for begin in range(0, len(x), 64):
                rows = np.stack([np.asarray(v, float) for v in x.iloc[begin : begin + 64]])
                total = np.tile(start, (len(rows), 1))
                for j in range(mean.shape[1]):
                    total -= (rows[:, j : j + 1] - mean[:, j]) ** 2 / (2 * var[:, j])
                total = np.exp(total - total.max(axis=1, keepdims=True))
                out += list(total / total.sum(axis=1, keepdims=True))
            return pd.Series(out, dtype=object)

        return run(F.array(*[ref(c).cast("double") for c in self.features]))

    def predict(self, df: DataFrame) -> DataFrame:
        if len(self.classes) * len(self.features) > WRITTEN:
            return with_probabilities(df, self._matrix_shares(), self.classes)
        staged = df.withColumn("_l", self._log_densities()).withColumn("_m", F.array_max("_l"))
        weights = F.transform("_l", lambda v: F.exp(v - F.col("_m")))
        staged = staged.withColumn("_w", weights)
        whole = F.aggregate("_w", F.lit(0.0), lambda a, v: a + v)
        out = with_probabilities(staged.withColumn("_t", whole), F.transform("_w", lambda v: v / F.col("_t")), self.classes)
        return out.drop("_l", "_m", "_w", "_t")


def fit_naive_bayes(df: DataFrame, features: Sequence[str], label: str, var_smoothing: float = 1e-9) -> NaiveBayes:
    require_columns(df, features, "naive Bayes")
    features = list(features)
    kept = df.dropna(subset=[*features, label])
    x = [ref(c).cast("double") for c in features]
    top = kept.agg(F.greatest(*[F.var_pop(c) for c in x], F.lit(0.0)) if len(x) > 0 else F.lit(0.0)).first()[0]
    rows = (
        kept.groupBy(ref(label).alias("c"))
        .agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("m"), F.array(*[F.var_pop(c) for c in x]).alias("v"))
        .collect()  # one row a class, which the model holds anyway
    )
    rows.sort(key=lambda r: r.c)
    total = sum(r.n for r in rows)
    extra = var_smoothing * (top or 0.0)
    return NaiveBayes(
        features, classes=[r.c for r in rows], priors=[r.n / total for r in rows], means=[list(r.m) for r in rows],
        variances=[[v + extra or 1e-300 for v in r.v] for r in rows],
    )
