"""DBSCAN over grid cells."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ...sources.shared import settle
from ..components import connected_components
from ..lookup import lookup
from ..neighbors import blocks, distances
from .cluster import distinct_points, labels_for_rows, number_clusters

GRID_DIMENSIONS = 3


def _adjacent(x: np.ndarray, y: np.ndarray, eps: float, metric: str) -> np.ndarray:
    return np.concatenate([distances(x[p], y, metric) <= eps for p in blocks(len(x), len(y))])


def _forest(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """Star edges of the connected parts of a bipartite adjacency: far fewer than its pairs."""
    edges = []
    todo_a, todo_b = adjacent.any(axis=1), adjacent.any(axis=0)
    for start in np.nonzero(todo_a)[0]:
        if not todo_a[start]:
            continue
        todo_a[start] = False
        queue, hub = deque([(0, start)]), left[start]
        while queue:
            side, i = queue.popleft()
            if side == 0:
                fresh = np.nonzero(adjacent[i] & todo_b)[0]
                todo_b[fresh] = False
                edges += [(hub, right[j]) for j in fresh]
                queue.extend((1, j) for j in fresh)
            else:
                fresh = np.nonzero(adjacent[:, i] & todo_a)[0]
                todo_a[fresh] = False
                edges += [(hub, left[j]) for j in fresh]
                queue.extend((0, j) for j in fresh)
    return edges


def dbscan(
    df: DataFrame, key: str, features: Sequence[str], eps: float = 0.5, min_samples: int = 5,
    metric: str = "euclidean", tile_rows: int = 4096,
) -> DataFrame:
    """(key, cluster), noise is -1; a border point joins the lowest cluster in reach.

    Equal vectors are merged with their count. Up to three features, cells are small
    enough that all points of a cell are neighbours: a cell with ``min_samples`` rows is
    all core and needs no distances, however many rows it holds. With more features the
    grid spans three of them and only prunes. Pairs of cells are compared tile by tile;
    a tile returns counts, or one star edge per reached point, never its pairs.
    """
    if metric == "cosine":
        reach, base = math.sqrt(2 * eps), "euclidean"
    else:
        reach, base = eps, metric
    d = len(features)
    rows, points = distinct_points(df, key, features, unit=metric == "cosine")
    compact = d <= GRID_DIMENSIONS
    spread = points.agg(*[F.stddev_pop(F.col("_v")[i]) for i in range(d)]).first()
    axes = sorted(sorted(range(d), key=lambda i: -(spread[i] or 0.0))[:GRID_DIMENSIONS])
    shrink = (math.sqrt(d) if base == "euclidean" else d) if compact else 1.0
    side = reach / shrink
    steps = math.ceil(shrink)
    # a little slack keeps rounding from pushing a neighbour out of the compared cells
    cell = F.array(*[F.floor(F.col("_v")[i] / F.lit(side * (1 - 1e-9))).cast("long") for i in axes])
    placed = settle(points.withColumn("cell", cell), "grid")
    cells = settle(
        placed.groupBy("cell").agg(F.sum("m").alias("weight"), F.count("*").alias("n"), F.min("rep").alias("hub"))
        .select(
            "cell", "n", "hub", (F.lit(compact) & (F.col("weight") >= min_samples)).alias("dense"),
            F.ceil(F.col("n") / tile_rows).cast("int").alias("chunks"),
        ),
        "cells",
    )
    placed = settle(
        lookup(placed, cells, "cell", "n").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")),
        "grid",
    )
    ahead = [o for o in product(range(-steps, steps + 1), repeat=len(axes)) if o >= (0,) * len(axes)]
    other = F.array(*[F.struct(*[(F.col("cell")[i] + F.lit(o[i])).alias(f"c{i}") for i in range(len(axes))]) for o in ahead])
    left = cells.select(
        F.col("cell").alias("a"), F.col("chunks").alias("ca"), F.col("dense").alias("da"), F.col("n").alias("na"),
        F.explode(other).alias("o"),
    ).select("a", "ca", "da", "na", F.array(*[F.col(f"o.c{i}") for i in range(len(axes))]).alias("b"))
    right = cells.select(F.col("cell").alias("b"), F.col("chunks").alias("cb"), F.col("dense").alias("db"), F.col("n").alias("nb"))
    tiles = (
        left.join(right, "b")
        .where(~((F.col("a") == F.col("b")) & F.col("da")))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ca") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)))
        .where((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
        .select(
            "a", "i", "b", "j", (F.col("da") & F.col("db")).alias("solid"),
            ((F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))).alias("twin"),
            (F.col("na") / F.col("ca") + F.col("nb") / F.col("cb")).alias("size"),
            F.concat_ws("|", F.col("a").cast("string"), "i", F.col("b").cast("string"), "j").alias("tile"),
        )
    )
    tiles = settle(tiles, "tiles")
    # small tiles travel together; a full one has a bundle almost to itself
    load = tiles.agg(F.sum("size")).first()[0] or 0.0
    bundles = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(load / (2 * tile_rows)))
    tiles = tiles.withColumn("bundle", F.pmod(F.xxhash64("tile"), F.lit(bundles)).cast("int"))
    kind = placed.schema["rep"].dataType.simpleString()

    def compare(which: DataFrame, table: DataFrame, work, schema: str) -> DataFrame:
        names = ["rep", "_v", "m", "dense"] + [c for c in ("core",) if c in table.columns]
        data = table.select(*names, "cell", "chunk")
        one = which.join(data, (F.col("a") == F.col("cell")) & (F.col("i") == F.col("chunk")))
        two = which.join(data, (F.col("b") == F.col("cell")) & (F.col("j") == F.col("chunk")))
        kept = ["bundle", "tile", "twin", *names]
        # new column identities, because both sides come from the same tables; a fixed
        # number of partitions, because the work is far larger than the bytes
        parts = min(bundles, 20_000)
        one, two = (
            t.select(*[F.col(c).alias(c) for c in kept]).repartition(parts, "bundle") for t in (one, two)
        )
        empty = [c.split()[0] for c in schema.split(", ")]

        def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            x, y = x.sort_values("tile"), y.sort_values("tile")
            both = np.intersect1d(x["tile"].unique(), y["tile"].unique())
            columns = [{c: t[c].to_numpy() for c in names + ["twin"]} for t in (x, y)]
            spans = [
                (np.searchsorted(t["tile"].to_numpy(), both, "left"), np.searchsorted(t["tile"].to_numpy(), both, "right"))
                for t in (x, y)
            ]
            out = []
            for n in range(len(both)):
                sides = [{c: v[lo[n] : hi[n]] for c, v in cols.items()} for cols, (lo, hi) in zip(columns, spans)]
                close = _adjacent(np.stack(sides[0]["_v"]), np.stack(sides[1]["_v"]), reach, base)
                out += work(close, *sides)
            return pd.DataFrame(out, columns=empty)

        return one.groupBy("bundle").cogroup(two.groupBy("bundle")).applyInPandas(run, schema)

    def count(close: np.ndarray, x: dict, y: dict) -> list[tuple]:
        thin = ~x["dense"].astype(bool)
        out = list(zip(x["rep"][thin], (close @ y["m"])[thin]))
        if not x["twin"][0]:
            thin = ~y["dense"].astype(bool)
            out += zip(y["rep"][thin], (close.T @ x["m"])[thin])
        return out

    # two dense cells are core already, so only tiles with a sparse side are counted
    counted = compare(tiles.where(~F.col("solid")), placed, count, f"rep {kind}, c long")
    reached = counted.groupBy("rep").agg(F.sum("c").alias("c"))
    core = placed.join(reached, "rep", "left").withColumn(
        "core", F.col("dense") | (F.coalesce("c", F.lit(0)) >= min_samples)
    )
    core = settle(core, "core")

    def link(close: np.ndarray, x: dict, y: dict) -> list[tuple]:
        xc, yc = x["core"].astype(bool), y["core"].astype(bool)
        xr, yr = x["rep"], y["rep"]
        solid = close[np.ix_(xc, yc)]
        if x["dense"].all() and y["dense"].all():
            # each side hangs together already: one link is enough
            edges = [(xr[xc][i], yr[yc][j], False) for i, j in np.argwhere(solid)[:1]]
        else:
            edges = [(a, b, False) for a, b in _forest(solid, xr[xc], yr[yc])]
        # a point that is no core has fewer than min_samples neighbours
        edges += [(xr[i], yr[j], True) for i, j in np.argwhere(close & ~xc[:, None] & yc[None, :])]
        if not x["twin"][0]:
            edges += [(yr[j], xr[i], True) for i, j in np.argwhere(close & xc[:, None] & ~yc[None, :])]
        return edges

    links = settle(compare(tiles, core, link, f"src {kind}, dst {kind}, border boolean"), "links")
    stars = core.where("dense").select(F.col("hub").alias("src"), F.col("rep").alias("dst"))
    alone = core.where("core").select(F.col("rep").alias("src"), F.col("rep").alias("dst"))
    edges = links.where(~F.col("border")).select("src", "dst").unionByName(stars).unionByName(alone)
    roots = settle(connected_components(edges), "roots")
    border = (
        links.where("border").join(roots, F.col("dst") == F.col("node"))
        .groupBy(F.col("src").alias("node")).agg(F.min("root").alias("root"))
    )
    whole = roots.unionByName(border)
    numbers = number_clusters(roots)
    sizes = whole.groupBy("root").agg(F.count("*").alias("n")).join(numbers, "root")
    named = lookup(whole, sizes, "root", "n").select(F.col("node").alias("rep"), "cluster")
    labelled = points.join(named, "rep", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return labels_for_rows(rows, labelled, key)
