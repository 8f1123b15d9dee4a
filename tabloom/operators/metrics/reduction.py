"""Metrics and chart tables of dimensionality reduction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ..lookup import rows_table
from ..models.matrices import covariance
from ..selection import correlation_pairs
from .common import chart_sample, histogram, metric_rows



def reduction_summary(df: DataFrame, features: Sequence[str], components: Sequence[str]) -> DataFrame:
    row = df.agg(F.count("*").alias("n"))
    return metric_rows(
        row,
        {
            "original_dimensions": F.lit(len(features)),
            "reduced_dimensions": F.lit(len(components)),
            "dimension_reduction_ratio": F.lit(len(components) / len(features)),
            "n_samples": F.col("n"),
        },
    )


def component_statistics(df: DataFrame, components: Sequence[str]) -> DataFrame:
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("component"), F.avg(ref(c)).alias("mean"), F.stddev_pop(ref(c)).alias("std"),
                F.min(ref(c)).cast("double").alias("min"), F.max(ref(c)).cast("double").alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(components)
        ]
    )
    return row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(components))])))


def scatter(df: DataFrame, key: str, components: Sequence[str], points: int = 1000) -> DataFrame:
    """Up to ``points`` rows as (key, x, y, z), missing axes zero."""
    axes = [ref(c) for c in components[:3]] + [F.lit(0.0)] * max(0, 3 - len(components))
    return chart_sample(df, key, points).select(ref(key), *[a.cast("double").alias(n) for a, n in zip(axes, "xyz")])


def component_histograms(
    df: DataFrame, components: Sequence[str], bins: int = 30, limit: int | None = None
) -> DataFrame:
    return histogram(df, {c: ref(c) for c in components[:limit]}, bins)


def component_correlation(df: DataFrame, components: Sequence[str]) -> DataFrame:
    """Full correlation matrix in long form."""
    found = correlation_pairs(df, components)
    rows = [(c, c, 1.0) for c in components]
    rows += [(a, b, v) for (a, b), v in found.items()] + [(b, a, v) for (a, b), v in found.items()]
    return rows_table(df.sparkSession, rows, "component string, other string, correlation double")


def eigenvalue_spectrum(df: DataFrame, features: Sequence[str], top: int | None = None) -> DataFrame:
    """(position, eigenvalue) of the covariance matrix, largest first."""
    values = np.linalg.eigvalsh(covariance(df, features).matrix)[::-1]
    rows = [(i + 1, float(v)) for i, v in enumerate(values[:top])]
    return rows_table(df.sparkSession, rows, "position int, eigenvalue double")


def spectrum_totals(df: DataFrame, features: Sequence[str], kept: int) -> DataFrame:
    values = np.linalg.eigvalsh(covariance(df, features).matrix)[::-1]
    rows = [("total_variance", float(values.sum())), ("top_k_variance", float(values[:kept].sum()))]
    return rows_table(df.sparkSession, rows, "metric string, value double")


def variance_explained(pca, spark) -> DataFrame:
    """(component, variance_ratio, cumulative_variance, singular_value)."""
    cumulative = np.cumsum(pca.ratio)
    rows = [
        (i + 1, float(r), float(c), float(s)) for i, (r, c, s) in enumerate(zip(pca.ratio, cumulative, pca.singular))
    ]
    return rows_table(spark, rows, "component int, variance_ratio double, cumulative_variance double, singular_value double")


def component_loadings(pca, spark, components: int | None = None, features: int | None = None) -> DataFrame:
    rows = [
        (k + 1, name, float(pca.vectors[j, k]))
        for k in range(pca.vectors.shape[1])[:components]
        for j, name in enumerate(pca.features[:features])
    ]
    return rows_table(spark, rows, "component int, feature string, loading double")


def reconstruction_error(df: DataFrame, pca) -> DataFrame:
    """Squared error summed over features (for the histogram) and its mean per cell."""
    errors = pca.reconstruction_errors(df)
    row = errors.agg(F.avg(F.col("error") / len(pca.features)).alias("mse"), F.avg("error").alias("mean"))
    return metric_rows(
        row,
        {"reconstruction_error": F.col("mse"), "reconstruction_rmse": F.sqrt("mse"), "mean_error": F.col("mean")},
    )


def reconstruction_histogram(df: DataFrame, pca, bins: int = 30) -> DataFrame:
    return histogram(pca.reconstruction_errors(df), {"reconstruction_error": F.col("error")}, bins)
