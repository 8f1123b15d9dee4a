"""Regression metrics and residual charts."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ..lookup import rows_table
from ..ordering import exact_quantiles
from .common import chart_sample, histogram, metric_rows

EPSILON = 2.220446049250313e-16


def residual(y_true: str, y_pred: str) -> Column:
    return ref(y_true) - ref(y_pred)


def determination(sse: Column, spread: Column) -> Column:
    """1 - sse/spread; a constant truth scores 1 when hit exactly and 0 otherwise."""
    return F.when(spread > 0, 1 - sse / spread).otherwise(F.when(sse > 0, 0.0).otherwise(1.0))


def regression_metrics(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    r, y = residual(y_true, y_pred), ref(y_true)
    row = df.agg(
        F.avg(r * r).alias("mse"),
        F.avg(F.abs(r)).alias("mae"),
        F.var_pop(y).alias("var_y"),
        F.var_pop(r).alias("var_r"),
        F.avg(F.abs(r) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )
    return metric_rows(
        row,
        {
            "mse": F.col("mse"),
            "rmse": F.sqrt("mse"),
            "mae": F.col("mae"),
            "r2": determination(F.col("mse"), F.col("var_y")),
            "explained_variance": determination(F.col("var_r"), F.col("var_y")),
            "mape": F.col("mape"),
        },
    )


def value_statistics(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """mean, population deviation, min and max of residual, prediction and actual."""
    series = {"residual": residual(y_true, y_pred), "prediction": ref(y_pred), "actual": ref(y_true)}
    row = df.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
            ).alias(n)
            for n, c in series.items()
        ]
    )
    parts = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("s")) for n in series])
    return row.select(F.inline(parts)).select("series", "s.*")


def prediction_sample(df: DataFrame, key: str, y_true: str, y_pred: str, points: int = 1000) -> DataFrame:
    return chart_sample(df, key, points).select(ref(key), ref(y_true).alias("actual"), ref(y_pred).alias("predicted"))


def diagonal(df: DataFrame, column: str) -> DataFrame:
    """End points of the reference line of a chart."""
    return df.agg(F.min(ref(column)).alias("line_start"), F.max(ref(column)).alias("line_end"))


def residual_sample(df: DataFrame, key: str, y_true: str, y_pred: str, points: int = 1000) -> DataFrame:
    return chart_sample(df, key, points).select(
        ref(key), ref(y_pred).alias("predicted"), residual(y_true, y_pred).alias("residual")
    )


def residual_histogram(df: DataFrame, y_true: str, y_pred: str, bins: int = 30) -> DataFrame:
    return histogram(df, {"residual": residual(y_true, y_pred)}, bins)


def error_histogram(df: DataFrame, y_true: str, y_pred: str, bins: int = 30) -> DataFrame:
    return histogram(df, {"abs_error": F.abs(residual(y_true, y_pred))}, bins)


def percentage_error(y_true: str, y_pred: str) -> Column:
    return residual(y_true, y_pred) / F.nullif(ref(y_true), F.lit(0)) * 100


def percentage_histogram(df: DataFrame, y_true: str, y_pred: str, bins: int = 30) -> DataFrame:
    """Empty when any true value is zero."""
    zero = df.agg(F.bool_or(ref(y_true) == 0)).first()[0]
    return histogram(df.where(F.lit(not zero)), {"pct_error": percentage_error(y_true, y_pred)}, bins)


def error_center(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Mean and deviation of residuals, mean and median of absolute and percentage errors."""
    r, pct = residual(y_true, y_pred), percentage_error(y_true, y_pred)
    row = df.agg(F.avg(r), F.stddev_pop(r), F.avg(F.abs(r)), F.avg(pct), F.bool_or(ref(y_true) == 0)).first()
    mid = exact_quantiles(df, {"a": F.abs(r), "p": pct}, [0.5])
    whole = not row[4]
    rows = [
        ("residual_mean", row[0]), ("residual_std", row[1]), ("mean_error", row[2]), ("median_error", mid["a"][0]),
        ("mean_pct_error", row[3] if whole else None), ("median_pct_error", mid["p"][0] if whole else None),
    ]
    return rows_table(df.sparkSession, rows, "metric string, value double")


def quantile_pairs(df: DataFrame, y_true: str, y_pred: str, points: int = 100) -> DataFrame:
    """(point, theoretical, sample): sorted residuals at evenly spaced ranks against normal quantiles."""
    n = df.agg(F.count(residual(y_true, y_pred))).first()[0]
    size = min(points, n)
    if not size:
        return rows_table(df.sparkSession, [], "point int, theoretical double, sample double")
    ranks = [0] if size == 1 else [int(i * (n - 1) / (size - 1)) for i in range(size)]
    shares = [0.0 if n == 1 else rank / (n - 1) for rank in ranks]
    found = exact_quantiles(df, {"r": residual(y_true, y_pred)}, shares)["r"]
    normal = NormalDist()
    rows = [(i, normal.inv_cdf((rank + 0.5) / n), v) for i, (rank, v) in enumerate(zip(ranks, found))]
    return rows_table(df.sparkSession, rows, "point int, theoretical double, sample double")


def interval_analysis(df: DataFrame, y_true: str, y_pred: str, bins: int = 10) -> DataFrame:
    """(bin, bin_start, bin_end, n, mae, r2) over equal, right-open intervals of the truth.

    Rows at the maximum fall in no interval; r2 needs two rows.
    """
    lo, hi = df.agg(F.min(ref(y_true)), F.max(ref(y_true))).first()
    schema = "bin int, bin_start double, bin_end double, n long, mae double, r2 double"
    if lo is None or lo == hi:
        return rows_table(df.sparkSession, [], schema)
    y, r = ref(y_true), residual(y_true, y_pred)
    spot = F.floor(F.lit(float(bins)) * (y - F.lit(lo)) / F.lit(hi - lo)).cast("int")
    kept = df.select(spot.alias("bin"), y.alias("y"), r.alias("r")).where(F.col("bin") < bins)
    per = kept.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(F.abs("r")).alias("mae"), F.avg(F.col("r") * F.col("r")).alias("sse"),
        F.var_pop("y").alias("var"),
    )
    width = (hi - lo) / bins
    return per.select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_end"),
        "n",
        "mae",
        F.when(F.col("n") > 1, determination(F.col("sse"), F.col("var"))).alias("r2"),
    )
