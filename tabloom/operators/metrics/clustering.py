"""Cluster quality metrics and chart tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ..lookup import lookup
from ..neighbors import SMALL_VALUES, TILE_ROWS, blocks, distance_sums, distances, pair_blocks
from .common import chart_sample, metric_rows

NOISE = -1


def centroids(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(label, n, center array) per cluster."""
    return df.groupBy(ref(label)).agg(
        F.count("*").alias("n"), F.array(*[F.avg(ref(c).cast("double")) for c in features]).alias("center")
    )


def _with_distance(df: DataFrame, features: Sequence[str], label: str, centers: DataFrame) -> DataFrame:
    joined = lookup(df.select(ref(label), *[ref(c) for c in features]), centers, label, "n")
    squares = [
        (ref(c).cast("double") - F.col("center")[i]) * (ref(c).cast("double") - F.col("center")[i])
        for i, c in enumerate(features)
    ]
    return joined.select(ref(label), "n", F.sqrt(sum(squares, F.lit(0.0))).alias("distance"))


def silhouette_samples(
    df: DataFrame, key: str, features: Sequence[str], label: str, distance: str = "euclidean",
    small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(key, label, silhouette) per row.

    ``euclidean`` is exact and quadratic in the rows. ``squared`` uses squared
    distances, whose sums follow from cluster moments in one pass.
    """
    sizes = df.groupBy(ref(label).alias("other")).agg(F.count("*").alias("m"))
    if distance == "squared":
        sums = _moment_sums(df, key, features, label, small_values, tile_rows)
    else:
        sums = distance_sums(df, key, features, label, "euclidean", small_values, tile_rows)
    sized = lookup(sums, sizes, "other", "m")
    own = ref(label) == F.col("other")
    per = sized.groupBy(ref(key), ref(label)).agg(
        F.max(F.when(own & (F.col("m") > 1), F.col("total") / (F.col("m") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("m"))).alias("b"),
    )
    value = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    return per.select(ref(key), ref(label), F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def _moment_sums(df, key, features, label, small_values, tile_rows):
    x = F.array(*[ref(c).cast("double") for c in features])
    rows = df.select(ref(key).alias("left_key"), ref(label).alias("_l"), x.alias("_x"))
    moments = df.groupBy(ref(label).alias("other")).agg(
        F.count("*").alias("m"),
        F.array(*[F.sum(ref(c).cast("double")) for c in features]).alias("s"),
        F.sum(sum((ref(c).cast("double") * ref(c).cast("double") for c in features), F.lit(0.0))).alias("q"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"left_key {kinds['left_key']}, _l {kinds['_l']}, other {kinds['_l']}, total double"

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        points, s = np.stack(a["_x"].to_numpy()), np.stack(b["s"].to_numpy())
        m, q = b["m"].to_numpy(float), b["q"].to_numpy(float)
        total = (points**2).sum(axis=1)[:, None] * m - 2 * points @ s.T + q
        return pd.DataFrame(
            {
                "left_key": np.repeat(a["left_key"].to_numpy(), len(b)),
                "_l": np.repeat(a["_l"].to_numpy(), len(b)),
                "other": np.tile(b["other"].to_numpy(), len(a)),
                "total": np.maximum(total, 0.0).reshape(-1),
            }
        )

    found = pair_blocks(rows, moments, "left_key", "other", work, schema, len(features), small_values, tile_rows)
    return found.select(F.col("left_key").alias(key), F.col("_l").alias(label), "other", "total")


def silhouette_score(df: DataFrame, key: str, features: Sequence[str], label: str, distance: str = "euclidean") -> DataFrame:
    """Mean over all rows (noise counts as a cluster) and over the rows without noise."""
    samples = silhouette_samples(df, key, features, label, distance)
    row = samples.agg(
        F.avg("silhouette").alias("all"), F.avg(F.when(ref(label) != NOISE, F.col("silhouette"))).alias("clean")
    )
    return metric_rows(row, {"silhouette_score": F.col("all"), "avg_score": F.col("clean")})


def davies_bouldin(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij."""
    centers = centroids(df, features, label)
    spreads = _with_distance(df, features, label, centers).groupBy(ref(label)).agg(F.avg("distance").alias("s"))
    table = centers.join(spreads, label).select(ref(label).alias("l"), "center", "s")
    kind = table.schema["l"].dataType.simpleString()

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(a["center"].to_numpy()), np.stack(b["center"].to_numpy())
        worst = []
        for part in blocks(len(x), len(y)):
            d = distances(x[part], y, "euclidean")
            ratio = (a["s"].to_numpy()[part][:, None] + b["s"].to_numpy()[None, :]) / np.where(d > 0, d, np.inf)
            ratio[a["l"].to_numpy()[part][:, None] == b["l"].to_numpy()[None, :]] = -np.inf
            worst.append(ratio.max(axis=1))
        return pd.DataFrame({"l": a["l"], "worst": np.concatenate(worst)})

    found = pair_blocks(table, table, "l", "l", work, f"l {kind}, worst double", len(features))
    per = found.groupBy("l").agg(F.max("worst").alias("worst"))
    return metric_rows(per.agg(F.avg("worst").alias("v")), {"davies_bouldin_score": F.col("v")})


def calinski_harabasz(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Between-cluster over within-cluster dispersion, each per degree of freedom."""
    overall = df.agg(*[F.avg(ref(c).cast("double")).alias(f"f{i}") for i, c in enumerate(features)]).first()
    per = df.groupBy(ref(label)).agg(
        F.count("*").alias("n"),
        *[F.avg(ref(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.var_pop(ref(c).cast("double")).alias(f"v{i}") for i, c in enumerate(features)],
    )
    between = sum((F.pow(F.col(f"m{i}") - F.lit(overall[i]), 2) for i in range(len(features))), F.lit(0.0))
    within = sum((F.col(f"v{i}") for i in range(len(features))), F.lit(0.0))
    row = per.agg(
        F.sum(F.col("n") * between).alias("b"), F.sum(F.col("n") * within).alias("w"),
        F.sum("n").alias("n"), F.count("*").alias("k"),
    )
    score = F.when(F.col("w") > 0, F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).otherwise(1.0)
    return metric_rows(row, {"calinski_harabasz_score": score})


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(ref(label).alias("cluster")).agg(F.count("*").alias("n"))


def cluster_counts(df: DataFrame, label: str) -> DataFrame:
    """Number of labels (noise included) and of noise points."""
    row = cluster_sizes(df, label).agg(
        F.count("*").alias("k"), F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("n"))), F.lit(0)).alias("noise")
    )
    return metric_rows(row, {"n_clusters": F.col("k"), "n_noise_points": F.col("noise")})


def intra_cluster_distances(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Distance to the own centre: mean, population deviation, min, max; no noise, no singletons."""
    kept = df.where(ref(label) != NOISE)
    measured = _with_distance(kept, features, label, centroids(kept, features, label)).where(F.col("n") > 1)
    return measured.groupBy(ref(label).alias("cluster")).agg(
        F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"),
        F.min("distance").alias("min"), F.max("distance").alias("max"),
    )


def cluster_centers(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    per = df.groupBy(ref(label).alias("cluster")).agg(*[F.avg(ref(c).cast("double")).alias(c) for c in features])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), ref(c).alias("center")) for c in features])
    return per.select("cluster", F.inline(parts))


def inter_center_distances(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The full matrix (cluster, other, distance); its size is the square of the cluster count."""
    table = centroids(df, features, label).select(ref(label).alias("cluster"), "center")
    kind = table.schema["cluster"].dataType.simpleString()

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(a["center"].to_numpy()), np.stack(b["center"].to_numpy())
        return pd.DataFrame(
            {
                "cluster": np.repeat(a["cluster"].to_numpy(), len(b)),
                "other": np.tile(b["cluster"].to_numpy(), len(a)),
                "distance": distances(x, y, "euclidean").reshape(-1),
            }
        )

    return pair_blocks(
        table, table, "cluster", "cluster", work, f"cluster {kind}, other {kind}, distance double", len(features)
    )


def cluster_feature_statistics(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(cluster, feature, mean, std, min, max) without noise."""
    per = df.where(ref(label) != NOISE).groupBy(ref(label).alias("cluster")).agg(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.avg(ref(c)).alias("mean"), F.stddev_pop(ref(c)).alias("std"),
                F.min(ref(c)).cast("double").alias("min"), F.max(ref(c)).cast("double").alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(features)
        ]
    )
    return per.select("cluster", F.inline(F.array(*[F.col(f"s{i}") for i in range(len(features))])))


def projection_sample(df: DataFrame, key: str, features: Sequence[str], label: str, points: int = 1000) -> DataFrame:
    """(key, x, y, label) of at most ``points`` rows; more than two features go through PCA."""
    from ..models.decomposition import fit_pca

    if len(features) > 2:
        shown = fit_pca(df, features, 2).transform(df)
        x, y = "pc1", "pc2"
    else:
        shown, (x, y) = df, features
    return chart_sample(shown, key, points).select(ref(key), ref(x).alias("x"), ref(y).alias("y"), ref(label))


def projected_centers(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Cluster centres in the plane of :func:`projection_sample`."""
    from ..models.decomposition import fit_pca

    means = df.groupBy(ref(label)).agg(*[F.avg(ref(c).cast("double")).alias(c) for c in features])
    if len(features) > 2:
        means = fit_pca(df, features, 2).transform(means)
        return means.select(ref(label).alias("cluster"), F.col("pc1").alias("x"), F.col("pc2").alias("y"))
    return means.select(ref(label).alias("cluster"), *[ref(c).alias(n) for c, n in zip(features, "xy")])
