"""Neighbour graphs: plain, entropy-calibrated and fuzzy."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ...sources.shared import settle
from ..neighbors import SMALL_VALUES, TILE_ROWS, nearest


def neighbor_graph(
    df: DataFrame, key: str, features: Sequence[str], k: int = 10, metric: str = "euclidean",
    small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(src, dst, distance, share) in both directions; share is 1 for mutual neighbours, else 0.5."""
    hits = nearest(df, df, key, features, k, metric, True, small_values=small_values, tile_rows=tile_rows)
    one = hits.select(F.col("left_key").alias("src"), F.col("right_key").alias("dst"), "distance")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    return both.groupBy("src", "dst").agg(F.max("distance").alias("distance"), (F.count("*") * 0.5).alias("share"))


def _neighbor_lists(df, key, features, k, metric, small_values, tile_rows, among: DataFrame | None = None) -> DataFrame:
    """(src, ds, dsts): at most k distances per row, nearest first, to rows of another table or of its own."""
    right = df if among is None else among
    hits = nearest(df, right, key, features, k, metric, True, small_values=small_values, tile_rows=tile_rows)
    packed = hits.groupBy(F.col("left_key").alias("src")).agg(
        F.array_sort(F.collect_list(F.struct("distance", F.col("right_key").alias("dst")))).alias("h")
    )
    return packed.select("src", F.col("h.distance").alias("ds"), F.col("h.dst").alias("dsts"))


def _padded(lists: pd.Series) -> np.ndarray:
    width = max(len(v) for v in lists)
    out = np.full((len(lists), width), np.inf)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def entropy_weights(d: np.ndarray, perplexity: float, rounds: int = 100) -> np.ndarray:
    """Row-wise exp(-beta d^2), scaled to sum to one, with entropy log(perplexity)."""
    square = d * d
    square = square - square.min(axis=1, keepdims=True)
    finite = np.isfinite(square)
    square[~finite] = 0.0
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    beta = np.ones(len(d))
    goal = np.log(np.minimum(perplexity, finite.sum(axis=1)))
    p = finite / finite.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        w = np.exp(-beta[:, None] * square) * finite
        total = w.sum(axis=1)
        p = w / total[:, None]
        entropy = np.log(total) + beta * (p * square).sum(axis=1)
        wide = entropy > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p


def fuzzy_weights(d: np.ndarray, k: int, rounds: int = 64) -> np.ndarray:
    """Row-wise exp(-(d - nearest)/sigma) with weights summing to log2(k)."""
    finite = np.isfinite(d)
    gap = np.where(finite, d, 0.0)
    gap = np.maximum(gap - np.where(finite, d, np.inf).min(axis=1, keepdims=True), 0.0)
    goal = math.log2(k)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(rounds):
        total = (np.exp(-gap / sigma[:, None]) * finite).sum(axis=1)
        over = total > goal
        high, low = np.where(over, sigma, high), np.where(over, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
        sigma = np.maximum(sigma, 1e-12)
    return np.exp(-gap / sigma[:, None]) * finite


def _directed(lists: DataFrame, weigh, kind: str) -> DataFrame:
    """(src, dst, w) from neighbour lists, one vectorised calibration per batch."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            w = weigh(_padded(part["ds"]))
            yield pd.DataFrame(
                {"src": part["src"], "dsts": part["dsts"], "ws": [row[: len(v)] for row, v in zip(w, part["ds"])]}
            )

    out = lists.mapInPandas(scan, f"src {kind}, dsts array<{kind}>, ws array<double>")
    pairs = F.arrays_zip(F.col("dsts").alias("dst"), F.col("ws").alias("w"))
    return out.select("src", F.inline(pairs)).toDF("src", "dst", "w")


def perplexity_graph(
    df: DataFrame, key: str, features: Sequence[str], perplexity: float = 30.0, metric: str = "euclidean",
    symmetric: bool = True, small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(src, dst, p): joint neighbour probabilities that sum to one, or conditional ones per row."""
    k = max(2, int(3 * perplexity))
    lists = _neighbor_lists(df, key, features, k, metric, small_values, tile_rows)
    kind = df.schema[key].dataType.simpleString()
    directed = _directed(lists, lambda d: entropy_weights(d, perplexity), kind)
    if not symmetric:
        return directed.withColumnRenamed("w", "p")
    n = lists.count()  # rows with all features; the others are no nodes
    both = directed.unionByName(directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") / (2.0 * n)).alias("p"))


def fuzzy_graph(
    df: DataFrame, key: str, features: Sequence[str], n_neighbors: int = 15, metric: str = "euclidean",
    symmetric: bool = True, small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(src, dst, w) with src < dst: fuzzy union a + b - ab of both directions, or directed weights."""
    lists = _neighbor_lists(df, key, features, n_neighbors, metric, small_values, tile_rows)
    kind = df.schema[key].dataType.simpleString()
    directed = _directed(lists, lambda d: fuzzy_weights(d, n_neighbors), kind)
    if not symmetric:
        return directed
    pair = directed.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    total = F.sum("w") - F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0)
    return pair.groupBy("src", "dst").agg(total.alias("w"))


@dataclass
class FuzzyProjection:
    """A kept neighbour graph that new rows can be placed on."""

    features: list[str]
    key: str
    rows: DataFrame
    n_neighbors: int = 15
    metric: str = "euclidean"
    small_values: int = SMALL_VALUES
    tile_rows: int = TILE_ROWS

    def project(self, df: DataFrame) -> DataFrame:
        """(src, dst, w): weights of each row towards its nearest kept rows, which sum to log2(k).

        A row that is kept itself (by its key) is no neighbour of its own, so it gets the weights it has in
        the graph. Rows with gaps have no edges. Only the new rows search; the kept graph is not changed.
        """
        lists = _neighbor_lists(
            df, self.key, self.features, self.n_neighbors, self.metric, self.small_values, self.tile_rows, self.rows
        )
        kind, k = df.schema[self.key].dataType.simpleString(), self.n_neighbors
        return _directed(lists, lambda d: fuzzy_weights(d, k), kind)


def fit_fuzzy_projection(
    df: DataFrame, key: str, features: Sequence[str], n_neighbors: int = 15, metric: str = "euclidean",
    small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS,
) -> FuzzyProjection:
    kept = settle(df.select(ref(key), *[ref(c) for c in features]), "projection")
    return FuzzyProjection(list(features), key, kept, n_neighbors, metric, small_values, tile_rows)
