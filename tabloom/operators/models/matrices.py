"""Means and cross-product matrices summed by Spark; only d x d numbers reach the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref

SQL_WIDTH = 16


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    scatter: np.ndarray  # sum of outer products of centred rows

    @property
    def matrix(self) -> np.ndarray:
        """Sample covariance."""
        return self.scatter / max(self.n - 1, 1)


def covariance(df: DataFrame, features: Sequence[str]) -> Moments:
    """Rows with a missing feature are left out."""
    names = list(features)
    d = len(names)
    x = df.select(*[ref(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    if d <= SQL_WIDTH:
        row = x.agg(
            F.count("*"),
            *[F.avg(f"x{i}") for i in range(d)],
            *[F.covar_pop(f"x{i}", f"x{j}") for i, j in pairs],
        ).first()
        n = row[0]
        if not n:
            return Moments(0, np.zeros(d), np.zeros((d, d)))
        mean = np.array(row[1 : d + 1], dtype=float)
        half = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[d + 1 :]):
            half[i, j] = half[j, i] = v * n
        return Moments(n, mean, half)
    row = x.agg(F.count("*"), *[F.avg(f"x{i}") for i in range(d)]).first()
    n = row[0]
    if not n:
        return Moments(0, np.zeros(d), np.zeros((d, d)))
    mean = np.array(row[1:], dtype=float)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for part in parts:
            centred = part.to_numpy(float) - mean
            total += centred.T @ centred
        yield pd.DataFrame({"spot": range(d * d), "v": total.reshape(-1)})

    sums = x.mapInPandas(partial, "spot int, v double").groupBy("spot").agg(F.sum("v").alias("v")).toPandas()
    scatter = np.zeros(d * d)
    scatter[sums["spot"]] = sums["v"]
    return Moments(n, mean, scatter.reshape(d, d))


def dot(features: Sequence[str], weights: Sequence[float], start: float = 0.0):
    """Weighted sum of columns as one expression."""
    total = F.lit(float(start))
    for c, w in zip(features, weights):
        total = total + ref(c).cast("double") * F.lit(float(w))
    return total


def largest_positive(vectors: np.ndarray) -> np.ndarray:
    """Fix the sign of each column so that its largest entry is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, range(vectors.shape[1])] < 0, -1.0, 1.0)
