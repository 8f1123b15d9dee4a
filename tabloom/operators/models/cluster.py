"""k-means, Gaussian mixtures, single linkage, bisecting and spectral clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, PowerIterationClustering
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ...sources.shared import release, settle
from ..components import connected_components
from ..lookup import lookup
from ..neighbors import SMALL_VALUES, TILE_ROWS, nearest
from ..ordering import running_totals
from .base import Fitted, assemble, attach_vector, require_numeric, right_size
from .graphs import neighbor_graph


def squared_distance(features: Sequence[str], center: Sequence[float]) -> Column:
    gaps = [ref(c).cast("double") - F.lit(float(v)) for c, v in zip(features, center)]
    return sum((g * g for g in gaps), F.lit(0.0))


@dataclass
class Centers(Fitted):
    """Cluster centres; a row belongs to the nearest one, the lower number on ties."""

    centers: np.ndarray = None
    inertia: float = 0.0

    def predict(self, df: DataFrame) -> DataFrame:
        staged = df.withColumn("_d", F.array(*[squared_distance(self.features, c) for c in self.centers]))
        label = (F.array_position("_d", F.array_min("_d")) - 1).cast("int")
        return staged.select(*[ref(c) for c in df.columns], label.alias("cluster"))


def update_centers(df: DataFrame, fitted: Centers) -> DataFrame:
    """One assignment and update step: (cluster, n, feature means)."""
    return fitted.predict(df).groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.avg(ref(c).cast("double")).alias(c) for c in fitted.features]
    )


def fit_kmeans(
    df: DataFrame, features: Sequence[str], n_clusters: int = 3, n_init: int = 10, max_iter: int = 300,
    tol: float = 1e-4, random_state: int = 42,
) -> Centers:
    """Best of ``n_init`` seeded runs by the sum of squared distances."""
    data = assemble(df, features).persist()
    best = None
    try:
        sized = right_size(data, data.count())
        for i in range(n_init):
            model = KMeans(
                featuresCol="_x", k=n_clusters, maxIter=max_iter, tol=tol, seed=random_state + i, initMode="k-means||"
            ).fit(sized)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
    finally:
        data.unpersist()
    centers = np.array(best.clusterCenters())
    centers = centers[np.lexsort(centers.T[::-1])]
    return Centers(list(features), centers=centers, inertia=float(best.summary.trainingCost))


@dataclass
class Mixture(Fitted):
    weights: np.ndarray = None
    means: np.ndarray = None
    covariances: np.ndarray = None
    log_likelihood: float = 0.0

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities and log density of each row."""
        logs = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            factor = np.linalg.cholesky(c)
            z = np.linalg.solve(factor, (x - m).T)
            logs[:, k] = math.log(max(w, 1e-300)) - 0.5 * (
                len(m) * math.log(2 * math.pi) + 2 * np.log(np.diag(factor)).sum() + (z * z).sum(axis=0)
            )
        top = logs.max(axis=1, keepdims=True)
        whole = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        return np.exp(logs - whole), whole[:, 0]

    def predict(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("array<double>")
        def run(v: pd.Series) -> pd.Series:
            return pd.Series(list(model.shares(np.stack(v.to_numpy()).astype(float))[0]) if len(v) else [], dtype=object)

        staged = df.withColumn("_p", run(F.array(*[ref(c).cast("double") for c in self.features])))
        label = (F.array_position("_p", F.array_max("_p")) - 1).cast("int")
        return staged.select(
            *[ref(c) for c in df.columns], label.alias("cluster"),
            *[F.col("_p")[k].alias(f"probability_{k}") for k in range(len(self.weights))],
        )


def fit_mixture(
    df: DataFrame, features: Sequence[str], n_components: int = 3, covariance_type: str = "full", max_iter: int = 100,
    random_state: int = 42, tol: float = 1e-3, floor: float = 1e-6,
) -> Mixture:
    """Full covariances use the built-in estimator; tied, diag and spherical run EM on summed moments."""
    require_numeric(df, features)
    features, k, d = list(features), n_components, len(features)
    if covariance_type == "full":
        model = GaussianMixture(featuresCol="_x", k=k, maxIter=max_iter, seed=random_state, tol=tol).fit(assemble(df, features))
        rows = model.gaussiansDF.collect()
        means = np.array([r["mean"].toArray() for r in rows])
        order = np.lexsort(means.T[::-1])
        covs = np.array([r["cov"].toArray() + floor * np.eye(d) for r in rows])
        return Mixture(
            features, weights=np.array(model.weights)[order], means=means[order], covariances=covs[order],
            log_likelihood=float(model.summary.logLikelihood),
        )
    start = fit_kmeans(df, features, k, n_init=1, random_state=random_state)
    rows = settle(df.select(F.array(*[ref(c).cast("double") for c in features]).alias("_x")).where(
        ~F.exists("_x", lambda v: v.isNull() | F.isnan(v))), "mixture")
    state = Mixture(features, weights=np.full(k, 1 / k), means=start.centers, covariances=np.stack([np.eye(d)] * k))
    hard, previous = True, -math.inf
    for _ in range(max_iter + 1):
        model, first = state, hard

        def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(k + k * d + k * d * d + 1)
            for part in parts:
                if not len(part):
                    continue
                x = np.stack(part["_x"].to_numpy()).astype(float)
                if first:
                    gap = ((x[:, None, :] - model.means[None]) ** 2).sum(axis=2)
                    r = np.eye(k)[gap.argmin(axis=1)]
                    density = np.zeros(len(x))
                else:
                    r, density = model.shares(x)
                z = x - start.centers.mean(axis=0)
                second = np.einsum("nk,ni,nj->kij", r, z, z)
                total += np.concatenate([r.sum(axis=0), (r.T @ z).reshape(-1), second.reshape(-1), [density.sum()]])
            yield pd.DataFrame({"spot": range(len(total)), "v": total})

        sums = rows.mapInPandas(partial, "spot int, v double").groupBy("spot").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(k + k * d + k * d * d + 1)
        flat[sums["spot"]] = sums["v"]
        n = np.maximum(flat[:k], 1e-12)
        shift = flat[k : k + k * d].reshape(k, d) / n[:, None]
        covs = flat[k + k * d : -1].reshape(k, d, d) / n[:, None, None] - shift[:, :, None] * shift[:, None, :]
        if covariance_type == "tied":
            covs = np.stack([(covs * n[:, None, None]).sum(axis=0) / n.sum()] * k)
        elif covariance_type == "diag":
            covs = np.stack([np.diag(np.diag(c)) for c in covs])
        elif covariance_type == "spherical":
            covs = np.stack([np.eye(d) * np.trace(c) / d for c in covs])
        else:
            raise ValueError(f"unknown covariance type {covariance_type!r}")
        level = float(flat[-1] / n.sum())
        if not hard and abs(level - previous) < tol:
            break
        previous = -math.inf if hard else level
        state = Mixture(
            features, weights=n / n.sum(), means=shift + start.centers.mean(axis=0), covariances=covs + floor * np.eye(d),
            log_likelihood=level,
        )
        hard = False
    release(rows)
    return state


def number_clusters(roots: DataFrame, root: str = "root") -> DataFrame:
    """(root, cluster): clusters numbered from 0 by their lowest member."""
    once = settle(roots.select(root).distinct().withColumn("_one", F.lit(1)), "roots")
    ranked = running_totals(once, [root], {"_upto": "_one"})
    return ranked.select(root, (F.col("_upto") - 1).cast("int").alias("cluster"))


def distinct_points(df: DataFrame, key: str, features: Sequence[str], unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, points): each row with its vector, each distinct vector with its lowest key and count."""
    require_numeric(df, features)
    x = F.array(*[ref(c).cast("double") for c in features])
    if unit:
        size = F.sqrt(sum((ref(c).cast("double") * ref(c).cast("double") for c in features), F.lit(0.0)))
        x = F.transform(x, lambda v: v / F.when(size > 0, size).otherwise(1.0))
    # adding zero turns -0.0 into 0.0, so equal vectors group together
    x = F.transform(x, lambda v: v + F.lit(0.0))
    rows = df.dropna(subset=list(features)).select(ref(key).alias("_key"), x.alias("_v"))
    points = rows.groupBy("_v").agg(F.min("_key").alias("rep"), F.count("*").alias("m"))
    return rows, settle(points, "points")


def labels_for_rows(rows: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Hand the cluster of each distinct vector (_v, m, cluster) to all rows that share it."""
    found = lookup(rows, points.select("_v", "m", "cluster"), "_v", "m")
    return found.select(F.col("_key").alias(key), "cluster")


def single_linkage(
    df: DataFrame, key: str, features: Sequence[str], n_clusters: int = 3, metric: str = "euclidean",
    small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(key, cluster): minimum spanning tree without its longest edges.

    Every round joins each point to its nearest point of another component and keeps
    the shortest link per component, so the components at least halve.
    """
    names = [f"_f{i}" for i in range(len(features))]
    rows, points = distinct_points(df, key, features, unit=metric == "cosine")
    base = "euclidean" if metric == "cosine" else metric
    flat = settle(points.select("rep", "_v", "m", *[F.col("_v")[i].alias(n) for i, n in enumerate(names)]), "linkage")
    state = flat.select("rep", *names, F.col("rep").alias("comp"))
    tree: DataFrame | None = None
    owned: DataFrame | None = None
    while state.select("comp").distinct().limit(2).count() > 1:
        hits = nearest(state, state, "rep", names, 1, base, label="comp", small_values=small_values, tile_rows=tile_rows)
        links = hits.join(state.select(F.col("rep").alias("left_key"), F.col("comp").alias("a")), "left_key")
        order = F.struct("distance", F.least("left_key", "right_key").alias("lo"), F.greatest("left_key", "right_key").alias("hi"))
        picked = settle(
            links.groupBy("a").agg(F.min(order).alias("e")).select("e.*").distinct(), "links"
        )
        tree = picked if tree is None else tree.unionByName(picked)
        # the links of a round join whole components, so contract on component names
        comps = state.select("rep", "comp")
        joined = (
            picked.join(comps.select(F.col("rep").alias("lo"), F.col("comp").alias("src")), "lo")
            .join(comps.select(F.col("rep").alias("hi"), F.col("comp").alias("dst")), "hi")
        )
        roots = connected_components(joined.select("src", "dst"))
        sizes = state.groupBy("comp").agg(F.count("*").alias("size")).join(roots.withColumnRenamed("node", "comp"), "comp")
        state = settle(
            lookup(state, sizes, "comp", "size").select("rep", *names, F.col("root").alias("comp")), "linkage"
        )
        release(owned)
        owned = state
    if tree is None:
        roots = flat.select(F.col("rep").alias("node"), F.col("rep").alias("root"))
    else:
        cut = tree.orderBy(F.desc("distance"), F.desc("lo"), F.desc("hi")).limit(max(n_clusters - 1, 0))
        # at most n_clusters - 1 rows
        kept = tree.join(F.broadcast(cut.select("lo", "hi")), ["lo", "hi"], "left_anti")
        linked = connected_components(kept.select(F.col("lo").alias("src"), F.col("hi").alias("dst")))
        roots = flat.select(F.col("rep").alias("node")).join(linked, "node", "left").select(
            "node", F.coalesce("root", "node").alias("root")
        )
    numbers = number_clusters(roots)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).join(numbers, "root")
    named = lookup(roots, sizes, "root", "n").select(F.col("node").alias("rep"), "cluster")
    return labels_for_rows(rows, points.join(named, "rep"), key)


def hierarchical(
    df: DataFrame, key: str, features: Sequence[str], n_clusters: int = 3, linkage: str = "ward", metric: str = "euclidean",
    random_state: int = 42,
) -> DataFrame:
    """(key, cluster). Ward is served by bisecting k-means, which cuts the same squared-error criterion top down."""
    if linkage == "single":
        return single_linkage(df, key, features, n_clusters, metric)
    if linkage != "ward":
        raise ValueError(f"{linkage} linkage needs all pairwise distances in one place; use single or ward")
    model = BisectingKMeans(featuresCol="_x", k=n_clusters, seed=random_state).fit(assemble(df, features))
    out = model.transform(attach_vector(df.dropna(subset=list(features)).select(ref(key), *[ref(c) for c in features]), features))
    return out.select(ref(key), F.col("prediction").alias("cluster"))


def spectral(
    df: DataFrame, key: str, features: Sequence[str], n_clusters: int = 3, affinity: str = "rbf", n_neighbors: int = 10,
    gamma: float = 1.0, max_iter: int = 40,
) -> DataFrame:
    """(key, cluster) by power iteration on the symmetric neighbour graph; keys must be whole numbers."""
    edges = neighbor_graph(df, key, features, n_neighbors)
    weight = F.exp(-gamma * F.col("distance") * F.col("distance")) if affinity == "rbf" else F.col("share")
    graph = settle(
        edges.where(F.col("src") < F.col("dst")).select(
            F.col("src").cast("long"), F.col("dst").cast("long"), F.greatest(weight, F.lit(1e-12)).alias("weight")
        ),
        "affinity",
    )
    model = PowerIterationClustering(k=n_clusters, maxIter=max_iter, initMode="degree", weightCol="weight")
    found = model.assignClusters(graph)
    return df.select(ref(key)).join(found.select(F.col("id").alias(key), "cluster"), key)
