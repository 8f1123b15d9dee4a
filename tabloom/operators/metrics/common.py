"""Histograms, samples and long-form helpers shared by the metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.hashing import seeded_hash
from ...functions.names import ref

CHART_POINTS = 1000


def metric_rows(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    """One (metric, value) row per expression over a one-row table."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in names.items()])
    return df.select(F.inline(pairs))


def chart_sample(df: DataFrame, key: str, points: int = CHART_POINTS, seed: int = 42) -> DataFrame:
    """At most ``points`` rows in hash order of the key: the reproducible chart sample."""
    return df.orderBy(seeded_hash(ref(key), seed), ref(key)).limit(points)


def histogram(df: DataFrame, values: dict[str, Column], bins: int = 30) -> DataFrame:
    """(series, bin, bin_start, bin_end, n) with the last bin closed; empty bins are listed."""
    names = list(values)
    head = df.select(*[values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    row = head.agg(
        *[F.struct(F.min(f"v{i}").alias("lo"), F.max(f"v{i}").alias("hi")).alias(f"v{i}") for i in range(len(names))]
    ).first()
    edges = {}
    for i in range(len(names)):
        lo, hi = row[i]
        if lo is not None:
            edges[i] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    slots = [
        F.struct(
            F.lit(names[i]).alias("series"),
            F.least(F.floor(F.lit(float(bins)) * (F.col(f"v{i}") - F.lit(lo)) / F.lit(hi - lo)) + 1, F.lit(bins)).cast("int").alias("bin"),
        )
        for i, (lo, hi) in edges.items()
    ]
    spark = df.sparkSession
    frame = spark.createDataFrame(
        [
            (names[i], b + 1, lo + (hi - lo) * b / bins, lo + (hi - lo) * (b + 1) / bins)
            for i, (lo, hi) in edges.items()
            for b in range(bins)
        ],
        "series string, bin int, bin_start double, bin_end double",
    )
    if not slots:
        return frame.withColumn("n", F.lit(0).cast("long"))
    counts = head.select(F.inline(F.array(*slots))).groupBy("series", "bin").agg(F.count("*").alias("n"))
    return frame.join(counts, ["series", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
