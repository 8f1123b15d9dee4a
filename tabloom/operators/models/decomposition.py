"""Principal components and linear discriminants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ..lookup import lookup
from .matrices import covariance, dot, largest_positive


@dataclass
class Projection:
    """(x - mean) times vectors, as one select."""

    features: list[str]
    mean: np.ndarray
    vectors: np.ndarray
    prefix: str

    @property
    def components(self) -> list[str]:
        return [f"{self.prefix}{k + 1}" for k in range(self.vectors.shape[1])]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(
            "*",
            *[
                dot(self.features, v, -float(self.mean @ v)).alias(name)
                for name, v in zip(self.components, self.vectors.T)
            ],
        )


@dataclass
class Pca(Projection):
    ratio: np.ndarray = None
    variance: np.ndarray = None
    singular: np.ndarray = None
    whiten: bool = False

    def reconstruction_errors(self, df: DataFrame) -> DataFrame:
        """(error): squared distance of each row to its projection."""
        shown = self.transform(df)
        back = self.vectors * self.variance if self.whiten else self.vectors
        gaps = [
            ref(c).cast("double") - dot(self.components, back[j], float(self.mean[j]))
            for j, c in enumerate(self.features)
        ]
        return shown.select(sum((g * g for g in gaps), F.lit(0.0)).alias("error"))


def fit_pca(df: DataFrame, features: Sequence[str], components: int = 2, whiten: bool = False) -> Pca:
    moments = covariance(df, features)
    values, vectors = np.linalg.eigh(moments.matrix)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    kept = min(components, len(values))
    vectors = largest_positive(vectors[:, :kept])
    total = values.sum()
    ratio = values[:kept] / total if total > 0 else np.zeros(kept)
    if whiten:
        vectors = vectors / np.sqrt(np.where(values[:kept] > 0, values[:kept], 1.0))
    return Pca(
        list(features), moments.mean, vectors, "pc", ratio=ratio, variance=values[:kept],
        singular=np.sqrt(values[:kept] * max(moments.n - 1, 0)), whiten=whiten,
    )


def shrunk_within(df: DataFrame, features: Sequence[str], label: str) -> np.ndarray:
    """Prior-weighted class covariances, each pulled to its mean variance by the Ledoit-Wolf share.

    The share is estimated on standardised features from two grouped aggregates: the
    correlations, and the fourth moment of the distance to the class mean.
    """
    d = len(features)
    x = [ref(c).cast("double") for c in features]
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    stats = df.groupBy(ref(label).alias("_k")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("m"), F.array(*[F.stddev_pop(c) for c in x]).alias("s"),
        F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs], F.lit(0.0)).alias("c"),
    )
    joined = lookup(df.select(ref(label).alias("_k"), *[c.alias(f"x{i}") for i, c in enumerate(x)]), stats, "_k", "n")
    size = sum(
        (F.pow((F.col(f"x{i}") - F.col("m")[i]) / F.nullif(F.col("s")[i], F.lit(0.0)), 2) for i in range(d)), F.lit(0.0)
    )
    fourth = {r["_k"]: r.q for r in joined.groupBy("_k").agg(F.sum(size * size).alias("q")).collect()}
    total, within = 0, np.zeros((d, d))
    for r in stats.collect():
        scale = np.array([v or 1.0 for v in r.s])
        corr = np.diag(np.array(r.s) ** 2)
        for (i, j), v in zip(pairs, r.c):
            corr[i, j] = corr[j, i] = v
        corr = corr / np.outer(scale, scale)
        centre = np.trace(corr) / d
        norm = float((corr**2).sum())
        spread = (norm - 2 * centre * np.trace(corr) + d * centre**2) / d
        noise = min(((fourth[r["_k"]] or 0.0) / r.n - norm) / (d * r.n), spread)
        share = noise / spread if spread > 0 else 0.0
        corr = (1 - share) * corr + share * centre * np.eye(d)
        within += r.n * corr * np.outer(scale, scale)
        total += r.n
    return within / max(total, 1)


def fit_discriminant(
    df: DataFrame, features: Sequence[str], label: str, components: int = 2, shrinkage: float | str | None = None
) -> Projection:
    """Directions that separate class means, scaled to unit within-class variance.

    ``shrinkage`` is a share, or 'auto' for an estimated one per class.
    """
    features = list(features)
    complete = df.dropna(subset=[*features, label])
    moments = covariance(complete, features)
    rows = complete.groupBy(ref(label)).agg(
        F.count("*").alias("_n"), *[F.avg(ref(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]
    ).collect()
    counts = np.array([r["_n"] for r in rows], dtype=float)
    means = np.array([[r[f"m{i}"] for i in range(len(features))] for r in rows])
    gaps = means - moments.mean
    within = (moments.scatter - (gaps * counts[:, None]).T @ gaps) / max(moments.n - len(rows), 1)
    if shrinkage == "auto":
        within = shrunk_within(complete, features, label)
    elif shrinkage:
        within = (1 - shrinkage) * within + shrinkage * np.trace(within) / len(features) * np.eye(len(features))
    values, vectors = np.linalg.eigh(within)
    solid = values > 1e-10 * max(values.max(), 1e-300)
    whitener = vectors[:, solid] / np.sqrt(values[solid])
    _, _, directions = np.linalg.svd((gaps * np.sqrt(counts)[:, None]) @ whitener, full_matrices=False)
    kept = min(components, len(rows) - 1, len(directions))
    return Projection(features, moments.mean, largest_positive(whitener @ directions[:kept].T), "ld")
