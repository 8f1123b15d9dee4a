"""Exact k-nearest-neighbour join and exact distance sums.

Small right sides (checked size) are broadcast as one array. Larger ones are cut
into Voronoi cells around sampled pivots. The triangle inequality tells each left
row which cells can hold one of its neighbours, and only those are visited. Cells
and visitors are both split into bounded tiles, so a cell holding a third of all
rows is shared by many tasks. A tile returns at most k rows per visitor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, seeded_hash
from ..functions.names import ref
from ..sources.shared import settle

SMALL_VALUES = 2_000_000
TILE_ROWS = 8192
MAX_PIVOTS = 1024
BLOCK = 1_000_000
GROUP = 256
#: Right rows that share a box, and right rows measured at once by a group.
LEAF = 512
CHUNK = 2048
#: Beyond this, squares and their differences are not formed.
LARGE = 1e100


METRICS = ("euclidean", "cosine", "correlation", "manhattan", "chebyshev")
#: Computed as half the squared distance of unit vectors; correlation takes their own mean off the features first.
UNIT = ("cosine", "correlation")


def check_metric(metric: str) -> None:
    """The pruning bounds hold for these distances only."""
    power = metric.removeprefix("minkowski:")
    if metric not in METRICS and (power == metric or float(power) < 1):
        raise ValueError(f"unknown metric {metric!r}; use minkowski:<power from 1> or {', '.join(METRICS)}")


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every row of x to every row of y, summed dimension by dimension."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gap = np.abs(x[:, j, None] - y[None, :, j])
        if metric == "chebyshev":
            np.maximum(total, gap, out=total)
        elif metric == "manhattan":
            total += gap
        elif metric.startswith("minkowski"):
            total += gap ** float(metric.split(":")[1])
        else:
            total += gap * gap
    if metric.startswith("minkowski"):
        return total ** (1 / float(metric.split(":")[1]))
    return np.sqrt(total) if metric in ("euclidean", *UNIT) else total


def pair_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of x to the same row of y, the very numbers that ``distances`` gives."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        gap = np.abs(x[:, j] - y[:, j])
        if metric == "chebyshev":
            np.maximum(out, gap, out=out)
        elif metric == "manhattan":
            out += gap
        elif metric.startswith("minkowski"):
            out += gap ** float(metric.split(":")[1])
        else:
            out += gap * gap
    if metric.startswith("minkowski"):
        return out ** (1 / float(metric.split(":")[1]))
    return np.sqrt(out) if metric in ("euclidean", *UNIT) else out


def pieces(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in parts of at most ``size``, halved along their widest dimension, so that a part fits a small box."""
    out, waiting = [], [np.arange(len(x))]
    while waiting:
        part = waiting.pop()
        if len(part) <= size:
            out.append(part)
            continue
        v = x[part]
        half = len(part) // 2
        cut = np.argpartition(v[:, int((v.max(axis=0) - v.min(axis=0)).argmax())], half)
        waiting += [part[cut[half:]], part[cut[:half]]]
    return out


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def blocks(rows: int, other: int) -> Iterator[slice]:
    """Row ranges whose distance matrix stays below a fixed size."""
    step = max(1, BLOCK // max(other, 1))
    for start in range(0, rows, step):
        yield slice(start, start + step)


class RightSide:
    """Right rows of a block, kept in boxes of neighbouring rows."""

    def __init__(self, y: np.ndarray, keys: np.ndarray, labels: np.ndarray | None, carry: dict[str, np.ndarray]):
        parts = pieces(y, LEAF)
        order = np.concatenate(parts)
        self.ends = np.cumsum([0, *map(len, parts)])
        self.y = y[order]
        self.low = np.minimum.reduceat(self.y, self.ends[:-1])
        self.high = np.maximum.reduceat(self.y, self.ends[:-1])
        self.plain = bool(np.abs(self.y).max() < LARGE)
        self.centre = self.y.mean(axis=0) if self.plain else np.zeros(y.shape[1])
        self.z = self.y - self.centre
        self.square = (self.z * self.z).sum(axis=1) if self.plain else None
        self.keys = keys[order]
        by_key = np.argsort(self.keys, kind="stable")
        self.sorted_keys, self.spot = self.keys[by_key], by_key
        self.rank = np.empty(len(order), dtype=int)
        self.rank[by_key] = np.arange(len(order))
        self.labels = None if labels is None else labels[order]
        self.carry = {c: v[order] for c, v in carry.items()}

    @classmethod
    def of(cls, rows: pd.DataFrame, carry: Sequence[str], labelled: bool) -> RightSide:
        return cls(
            np.stack(rows["_y"].to_numpy()), rows["right_key"].to_numpy(), rows["_l"].to_numpy() if labelled else None,
            {c: rows[c].to_numpy() for c in carry},
        )

    def own(self, keys: np.ndarray) -> np.ndarray:
        """Position of each left key among the right rows, -1 where absent."""
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.spot[at], -1)

    def search(
        self, x: np.ndarray, k: int, metric: str, own: np.ndarray | None, labels: np.ndarray | None, within: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """(row, position, distance, place) of the k nearest rows no farther than ``within``.

        Boxes are visited by their distance from the group's box until none can hold a nearer row. A product of
        matrices finds the few rows that may count; their distances are then taken dimension by dimension.
        """
        gap = np.maximum(np.maximum(self.low - x.max(axis=0), x.min(axis=0) - self.high), 0.0)
        apart = distances(np.nan_to_num(gap, nan=0.0, posinf=np.inf), np.zeros((1, x.shape[1])), metric)[:, 0]
        near = np.argsort(apart, kind="stable")
        squared = metric in ("euclidean", *UNIT) and self.plain and bool(np.abs(x).max() < LARGE)
        if squared:
            z = x - self.centre
            square = (z * z).sum(axis=1)
        need = k + (own is not None)
        value, spot = np.full((len(x), k), np.inf), np.zeros((len(x), k), int)
        bound, at = within, 0
        while at < len(near):
            open_to = float(bound.max()) * (1 + 1e-9) + 1e-12
            stop, rows = at, 0
            while stop < len(near) and apart[near[stop]] <= open_to:
                size = self.ends[near[stop] + 1] - self.ends[near[stop]]
                if stop > at and rows + size > CHUNK:
                    break
                rows, stop = rows + size, stop + 1
            if stop == at:
                break
            spots = np.concatenate([np.arange(self.ends[i], self.ends[i + 1]) for i in near[at:stop]])
            at = stop
            if squared:
                d = z @ (-2 * self.z[spots].T)
                d += square[:, None]
                d += self.square[spots]
                slack = 4e-16 * (x.shape[1] + 8) * float(square.max() + self.square[spots].max())
                limit = bound * bound * (1 + 1e-9) + slack
            else:
                d = distances(x, self.y[spots], metric)
                slack = 0.0
                limit = bound * (1 + 1e-9)
            if labels is not None:
                d[labels[:, None] == self.labels[spots]] = np.inf
            if d.shape[1] >= need and np.isinf(bound).any():
                limit = np.minimum(limit, np.partition(d, need - 1, axis=1)[:, need - 1] * (1 + 1e-9) + 2 * slack)
            r, c = np.nonzero(d <= limit[:, None])
            c = spots[c]
            if own is not None:
                r, c = r[c != own[r]], c[c != own[r]]
            if labels is not None:
                other = labels[r] != self.labels[c]
                r, c = r[other], c[other]
            exact = pair_distances(x[r], self.y[c], metric) if squared or len(r) < d.size else d[r, c]
            fits = np.isfinite(exact) & (exact <= bound[r])
            if not fits.any():
                continue
            old = np.nonzero(np.isfinite(value))
            r, c = np.concatenate([old[0], r[fits]]), np.concatenate([spot[old], c[fits]])
            exact = np.concatenate([value[old], exact[fits]])
            order = np.lexsort((self.rank[c], exact, r))
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            kept = place < k
            r, c, exact, place = r[kept], c[kept], exact[kept], place[kept]
            value[r, place], spot[r, place] = exact, c
            bound = np.minimum(within, value[:, k - 1])
        r, place = np.nonzero(np.isfinite(value))
        return r, spot[r, place], value[r, place], place + 1


def top_rows(
    left: pd.DataFrame, right: RightSide, k: int, metric: str, exclude_self: bool, labelled: bool
) -> pd.DataFrame:
    """k nearest right rows of each left row, nearest first, lower key first on ties; none beyond ``_within``, if given."""
    columns = ["left_key", "right_key", "distance", "rank", *right.carry]
    x = np.stack(left["_x"].to_numpy())
    left_keys = left["left_key"].to_numpy()
    labels = left["_l"].to_numpy() if labelled else None
    own = right.own(left_keys) if exclude_self else None
    within = left["_within"].to_numpy(float) if "_within" in left else np.full(len(x), np.inf)
    out: list[tuple[np.ndarray, ...]] = []
    for group in pieces(x, GROUP):
        r, c, value, place = right.search(
            x[group], k, metric, None if own is None else own[group], None if labels is None else labels[group], within[group]
        )
        out.append((group[r], c, value, place))
    r, c, value, place = (np.concatenate([o[i] for o in out]) for i in range(4))
    if metric in UNIT:
        value = value * value / 2
    found = {"left_key": left_keys[r], "right_key": right.keys[c], "distance": value, "rank": place.astype("int32")}
    found.update({n: v[c] for n, v in right.carry.items()})
    return pd.DataFrame(found)[columns]


def no_rows(columns: Sequence[str]) -> pd.DataFrame:
    """An empty result; its columns are objects, which Arrow turns into any type (an empty float column into numbers only)."""
    return pd.DataFrame({c: [] for c in columns}, dtype=object)


def _packed(df: DataFrame, key: str, features: Sequence[str], metric: str, names: tuple[str, str], extra=()) -> DataFrame:
    complete = df.dropna(subset=list(features))
    x = F.array(*[ref(c).cast("double") for c in features])
    if metric == "correlation":
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / len(features)
        x = F.transform(x, lambda v: v - mean)
    if metric in UNIT:
        size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
        x = F.transform(x, lambda v: v / F.when(size > 0, size).otherwise(1.0))
    return complete.select(ref(key).alias(names[0]), x.alias(names[1]), *extra)


def spread(df: DataFrame, rows: int, cost: float, key: str) -> DataFrame:
    """Enough balanced partitions for work that is far dearer than a shuffle."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * cost / 2e10))
    return df.repartition(min(tasks, max(rows, 1)), ref(key))


def nearest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    features: Sequence[str],
    k: int,
    metric: str = "euclidean",
    exclude_self: bool = False,
    label: str | None = None,
    carry: Sequence[str] = (),
    small_values: int = SMALL_VALUES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(left_key, right_key, distance, rank, *carry) of the k nearest right rows.

    Ties go to the lower right key. With ``label`` only right rows of another label
    count (k must be 1 then). ``carry`` names columns of ``right`` to return.
    """
    if label is not None and k != 1:
        raise ValueError("a label restriction needs k = 1")
    check_metric(metric)
    features = list(features)
    tag = [ref(label).alias("_l")] if label else []
    lrows = _packed(left, key, features, metric, ("left_key", "_x"), tag)
    rrows = _packed(right, key, features, metric, ("right_key", "_y"), tag + [ref(c) for c in carry])
    fields = {f.name: f.dataType.simpleString() for f in rrows.schema.fields}
    schema = f"left_key {lrows.schema['left_key'].dataType.simpleString()}, right_key {fields['right_key']}, distance double, rank int" + "".join(
        f", `{c}` {fields[c]}" for c in carry
    )
    count = rrows.count()
    labelled = label is not None
    shown = ["left_key", "right_key", "distance", "rank", *[ref(c) for c in carry]]
    if not count:
        return left.sparkSession.createDataFrame([], schema)
    if count * len(features) <= small_values:
        found = rrows.toArrow()
        y = found["_y"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
        names = ["right_key", *(["_l"] if labelled else []), *carry]
        flat = {n: found[n].to_numpy() for n in names}
        shared = left.sparkSession.sparkContext.broadcast((y, flat))

        def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            values, named = shared.value
            side = RightSide(values, named["right_key"], named.get("_l"), {c: named[c] for c in carry})
            for part in parts:
                if len(part):
                    yield top_rows(part, side, k, metric, exclude_self, labelled)

        # every left row meets all right rows in one place, so its ranks are final
        return spread(lrows, lrows.count(), count * len(features), "left_key").mapInPandas(scan, schema).select(*shown)
    found = _tiled_nearest(lrows, rrows, len(features), k, metric, exclude_self, labelled, carry, schema, count, tile_rows)
    order = Window.partitionBy("left_key").orderBy("distance", "right_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*shown)


def _tiled_nearest(lrows, rrows, width, k, metric, exclude_self, labelled, carry, schema, count, tile_rows):
    need = k + 1 if exclude_self else k
    if not labelled:
        # only the lowest keys of identical vectors can be neighbours
        copies = Window.partitionBy("_y").orderBy("right_key")
        rrows = rrows.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= need).drop("_c")
    wanted = int(min(MAX_PIVOTS, max(4, math.sqrt(count) / 4)))
    sample = rrows.orderBy(seeded_hash(F.col("right_key"), "pivot")).select("_y").take(wanted)
    pivots = np.unique(np.array([r[0] for r in sample], dtype=float), axis=0)
    base = "euclidean" if metric in UNIT else metric

    right_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rrows.schema.fields)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            d = distances(matrix(part["_y"], width), pivots, base)
            part = part.assign(_cell=d.argmin(axis=1).astype("int32"), _far=d.min(axis=1) if len(part) else [])
            yield part

    placed = settle(rrows.mapInPandas(assign, right_schema + ", _cell int, _far double"), "cells")
    sizes = placed.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_far").alias("lo"), F.max("_far").alias("hi")).collect()
    cells = np.array([r["_cell"] for r in sizes])
    low = np.array([r.lo for r in sizes])
    high = np.array([r.hi for r in sizes])
    live = pivots[cells]
    slot = {int(c): i for i, c in enumerate(cells)}
    depth = 2 if labelled else need
    near = np.full((len(cells), depth), np.inf)
    near_label = np.empty((len(cells), depth), dtype=object)
    if labelled:
        source = placed.groupBy("_cell", "_l").agg(F.min("_far").alias("_far"))
    else:
        source = placed.withColumn("_l", F.lit(0))
    closest = Window.partitionBy("_cell").orderBy("_far")
    for r in source.select("_cell", "_far", "_l", F.row_number().over(closest).alias("n")).where(F.col("n") <= depth).collect():
        near[slot[r["_cell"]], r.n - 1] = r["_far"]
        near_label[slot[r["_cell"]], r.n - 1] = r["_l"]

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = matrix(part["_x"], width)
            visits: list[np.ndarray] = []
            first = "_within" not in part
            reached: list[np.ndarray] = []
            for rows in blocks(len(x), len(live) * depth * 4):
                d = distances(x[rows], live, base)
                if first:
                    reach = d[:, :, None] + near[None, :, :]
                    if labelled:
                        mine = part["_l"].to_numpy()[rows]
                        reach[near_label[None, :, :] == mine[:, None, None]] = np.inf
                    flat = reach.reshape(len(d), -1)
                    nth = min(need, flat.shape[1]) - 1
                    bound = np.partition(flat, nth, axis=1)[:, nth] if flat.shape[1] >= need else np.full(len(d), np.inf)
                    reached.append(bound * (1 + 1e-9) + 1e-12)
                    visits += list(cells[d.argmin(axis=1)[:, None]].astype("int32"))
                    continue
                bound = part["_within"].to_numpy(float)[rows]
                gap = np.maximum(d - high[None, :], low[None, :] - d)
                gap = np.maximum(gap, (d - d.min(axis=1)[:, None]) / 2)
                # rows that are placed by their nearest pivot lie on its side of the border
                open_cells = gap <= bound[:, None]
                open_cells[np.arange(len(d)), d.argmin(axis=1)] = False
                visits += [cells[row].astype("int32") for row in open_cells]
            if first:
                part = part.assign(_within=np.concatenate(reached) if reached else [])
            yield part.assign(_cells=pd.Series(visits, index=part.index, dtype=object))

    columns = ["left_key", "right_key", "distance", "rank", *carry]

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return no_rows(columns)
        return top_rows(a, RightSide.of(b, carry, labelled), k, metric, exclude_self, labelled)

    spots = ["_cell", "_chunk", "_salt"]

    def visited(visiting: DataFrame) -> DataFrame:
        """Hits of every visitor in the cells that it visits."""
        visitors = {
            r["_cell"]: r.n
            for r in visiting.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count("*").alias("n")).collect()
        }
        plan_rows = [
            (int(r["_cell"]), math.ceil(r.n / tile_rows), math.ceil(visitors.get(r["_cell"], 1) / tile_rows)) for r in sizes
        ]
        # one row per cell, at most MAX_PIVOTS rows
        plan = lrows.sparkSession.createDataFrame(plan_rows, "_cell int, _chunks int, _salts int")
        ltiles = (
            visiting.withColumn("_cell", F.explode("_cells")).drop("_cells")
            .join(F.broadcast(plan), "_cell")
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
            .withColumn("_salt", F.pmod(F.xxhash64("left_key"), F.col("_salts")).cast("int"))
            .drop("_chunks", "_salts")
        )
        rtiles = (
            placed.drop("_far")
            .join(F.broadcast(plan), "_cell")
            .withColumn("_chunk", F.pmod(F.xxhash64("right_key"), F.col("_chunks")).cast("int"))
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
            .drop("_chunks", "_salts")
        )
        # a fixed number of partitions, because the work is far larger than the bytes
        tiles = sum(chunks * salts for _, chunks, salts in plan_rows)
        parts = max(1, min(tiles, 20_000))
        ltiles, rtiles = ltiles.repartition(parts, *spots), rtiles.repartition(parts, *spots)
        return ltiles.groupBy(*spots).cogroup(rtiles.groupBy(*spots)).applyInPandas(tile, schema)

    left_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lrows.schema.fields)
    left_schema += ", _within double, _cells array<int>"
    # each row asks its own cell first; what it finds there says how far the others have to be searched
    first = settle(lrows.mapInPandas(visit, left_schema), "visits")
    hits = settle(visited(first), "hits")
    order = Window.partitionBy("left_key").orderBy("distance", "right_key")
    last = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k)
    far = F.sqrt(2 * F.col("distance")) if metric in UNIT else F.col("distance")
    last = last.select(F.col("left_key").alias("_last_key"), (far * (1 + 1e-9) + 1e-12).alias("_last"))
    again = first.drop("_cells").join(last, F.col("left_key").eqNullSafe(F.col("_last_key")), "left")
    again = again.withColumn("_within", F.least("_within", "_last")).select(*[f.name for f in lrows.schema.fields], "_within")
    second = settle(again.mapInPandas(visit, left_schema), "visits")
    return hits.unionByName(visited(second))


def pair_blocks(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, work, schema: str, width: int,
    small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Rows of ``work(left block, right block)`` over all pairs of blocks.

    ``work`` must return a few rows per left row, never one per pair. A right side of
    checked size is broadcast; otherwise both sides are dealt into tiles.
    """
    count = right.count()
    if count * width <= small_values:
        shared = left.sparkSession.sparkContext.broadcast(right.toPandas())

        def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part) and len(shared.value):
                    yield work(part, shared.value)

        return spread(left, left.count(), count * width, left_key).mapInPandas(scan, schema)
    across, down = math.ceil(left.count() / tile_rows), math.ceil(count / tile_rows)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = left.withColumn("_a", hash_bucket(ref(left_key), across).cast("int")).withColumn("_b", every(down))
    b = right.withColumn("_b", hash_bucket(ref(right_key), down).cast("int")).withColumn("_a", every(across))
    empty = [part.split()[0].strip("`") for part in schema.split(", ")]

    def tile(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return work(x, y) if len(x) and len(y) else no_rows(empty)

    parts = max(1, min(across * down, 20_000))
    a, b = (t.select(*[ref(c).alias(c) for c in t.columns]).repartition(parts, "_a", "_b") for t in (a, b))
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInPandas(tile, schema)


def label_sums(x: np.ndarray, y: np.ndarray, codes: np.ndarray, labels: int, metric: str) -> np.ndarray:
    """(row of x, label): summed distances to the rows of y, which are sorted by their label's code.

    Euclidean distances come from a product of matrices, in blocks that stay in a core's cache. Pairs so near
    that the differences of squares lose digits are measured again dimension by dimension.
    """
    total = np.zeros((len(x), labels))
    if metric != "euclidean" or not max(np.abs(x).max(), np.abs(y).max()) < LARGE:
        member = np.zeros((len(y), labels))
        member[np.arange(len(y)), codes] = 1.0
        return np.concatenate([distances(x[p], y, metric) @ member for p in blocks(len(x), len(y))])
    centre = y.mean(axis=0)
    zx, zy = x - centre, y - centre
    xx, yy = (zx * zx).sum(axis=1), (zy * zy).sum(axis=1)
    for at in range(0, len(y), LEAF):
        some = slice(at, at + LEAF)
        here = codes[some]
        starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        turned = -2 * zy[some].T
        for first in range(0, len(x), GROUP):
            rows = slice(first, first + GROUP)
            d = zx[rows] @ turned
            d += xx[rows, None]
            d += yy[some]
            close = 1e-7 * (xx[rows].max() + yy[some].max())
            if d.min() < close:
                r, c = np.nonzero(d < close)
                exact = pair_distances(x[first + r], y[at + c], metric)
                d[r, c] = exact * exact
            np.sqrt(d, out=d)
            total[rows, here[starts]] += np.add.reduceat(d, starts, axis=1) if len(starts) > 1 else d.sum(axis=1)[:, None]
    return total


def distance_sums(
    df: DataFrame, key: str, features: Sequence[str], label: str, metric: str = "euclidean",
    small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(key, label, other, total): summed distance of each row to all rows of each label.

    The work is quadratic by definition; the data moved is not: every tile returns one
    number per row and label.
    """
    rows = _packed(df, key, features, metric, ("left_key", "_x"), [ref(label).alias("_l")])
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"left_key {fields['left_key']}, _l {fields['_l']}, other {fields['_l']}, total double"

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_l", kind="stable")
        x, y = np.stack(a["_x"].to_numpy()), np.stack(b["_x"].to_numpy())
        labels, codes = np.unique(b["_l"].to_numpy(), return_inverse=True)
        total = label_sums(x, y, codes, len(labels), metric)
        return pd.DataFrame(
            {
                "left_key": np.repeat(a["left_key"].to_numpy(), len(labels)),
                "_l": np.repeat(a["_l"].to_numpy(), len(labels)),
                "other": np.tile(labels, len(x)),
                "total": total.reshape(-1),
            }
        )

    found = pair_blocks(rows, rows, "left_key", "left_key", sums, schema, len(features), small_values, tile_rows)
    return found.groupBy(F.col("left_key").alias(key), F.col("_l").alias(label), "other").agg(F.sum("total").alias("total"))
