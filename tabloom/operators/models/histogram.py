"""Second-order boosting over binned features, grown leaf by leaf or level by level.

Features become bin numbers once. Every pass adds up first and second derivatives of the loss for
each (leaf, feature, bin) inside its task; Spark sums them and finds the best cut of every leaf with
a window over at most ``max_bins`` rows. The driver sees one row for each leaf, or one for each of
its features where these are few.

Sums are kept in whole numbers, so a tree does not depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.names import ref
from ...sources.shared import release, settle
from .base import Fitted, class_list, feature_array, fold, require_numeric, widths, with_code, with_probabilities

#: Margins are written anew after so many trees; a pass replays only the trees since then.
REPLAYED = 16
#: Numbers in the histograms of one task; more leaves go into further passes.
HISTOGRAM_CELLS = 4_000_000
#: With more (leaf, feature) pairs Spark also picks the best feature; up to so many rows the driver does.
COLLECTED = 10_000
#: Bits of one row's derivative; batches of up to 16,384 rows then add up exactly in doubles.
BITS = 38
BATCH = 16_384


@dataclass
class Growth:
    """When a leaf is split and what it is worth.

    The gain of a cut is score(left) + score(right) - score(leaf), score = max(|G| - alpha, 0)^2 / (H + lambda).
    ``leaves`` grows the best leaf first up to so many; without it all leaves of a level are split.
    ``max_depth`` below 1 sets no bound.
    """

    rate: float = 0.1
    max_depth: int = 6
    leaves: int | None = None
    alpha: float = 0.0
    penalty: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    min_rows: int = 1

    def open(self, depth: int, h: float, n: int) -> bool:
        """Whether a leaf could be split at all."""
        shallow = self.max_depth < 1 or depth < self.max_depth
        return shallow and n >= 2 * max(self.min_rows, 1) and h >= 2 * self.min_weight

    def value(self, g: float, h: float) -> float:
        held = math.copysign(max(abs(g) - self.alpha, 0.0), g)
        return -self.rate * held / (h + self.penalty) if h + self.penalty > 0 else 0.0


@dataclass
class Objective:
    """Derivatives of a loss by its margins, one margin for each side."""

    kind: str
    sides: int
    factor: float = 1.0

    def __call__(self, m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "squared":
            return m - y[:, None], np.ones_like(m)
        if self.kind == "logistic":
            p = _logistic(m)
            return p - y[:, None], p * (1 - p)
        p = _softmax(m)
        g = p.copy()
        g[np.arange(len(y)), y.astype(int)] -= 1
        return g, self.factor * p * (1 - p)


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -700, 700)))


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Tree:
    """Nodes found so far; those that the final tree leaves out stay as they are never reached again."""

    def __init__(self):
        self.split: list[tuple | None] = [None]
        self.known: list[bool] = [False]
        self.kids: list[tuple[int, int] | None] = [None]
        self.sums: list[tuple[float, float, int]] = [(0.0, 0.0, 0)]
        self.depth: list[int] = [0]
        self.picked: set[int] = set()

    def select(self, rule: Growth) -> list[int]:
        """Take the best leaves by the known gains; gives the new leaves whose gains are still to be found.

        Once none are left, every leaf that was passed over had a known gain, so the order is that
        of splitting one leaf at a time.
        """
        self.picked, unknown = set(), []
        queue = [(-self.split[0][0], 0)] if self.split[0] else []
        while queue and (rule.leaves is None or len(self.picked) < rule.leaves - 1):
            _, node = heapq.heappop(queue)
            self.picked.add(node)
            for kid in self.kids[node] or self._divide(node, rule):
                if not self.known[kid]:
                    unknown.append(kid)
                elif self.split[kid]:
                    heapq.heappush(queue, (-self.split[kid][0], kid))
        return unknown

    def _divide(self, node: int, rule: Growth) -> tuple[int, int]:
        _, _, _, _, gl, hl, nl = self.split[node]
        g, h, n = self.sums[node]
        first = len(self.split)
        for sums in ((gl, hl, nl), (g - gl, h - hl, n - nl)):
            depth = self.depth[node] + 1
            self.split.append(None)
            self.known.append(not rule.open(depth, sums[1], sums[2]))
            self.kids.append(None)
            self.sums.append(sums)
            self.depth.append(depth)
        self.kids[node] = (first, first + 1)
        return self.kids[node]

    def arrays(self, nodes: set[int] | None = None) -> dict[str, np.ndarray]:
        """Feature, bin, side of gaps and children of each node; a leaf has feature -1 and leads to itself."""
        n = len(self.split)
        out = {
            "feature": np.full(n, -1, np.int32), "bin": np.zeros(n, np.int32), "gaps": np.zeros(n, bool),
            "left": np.arange(n, dtype=np.int32), "right": np.arange(n, dtype=np.int32),
        }
        for i, kids in enumerate(self.kids):
            if kids and (nodes is None or i in nodes):
                _, out["feature"][i], out["bin"][i], out["gaps"][i] = self.split[i][:4]
                out["left"][i], out["right"][i] = kids
        return out


def _walk(x: np.ndarray, bounds: np.ndarray, gone: np.ndarray, tree: dict[str, np.ndarray], start: np.ndarray) -> np.ndarray:
    """The leaf of each row from each start. ``bounds`` holds the cut of every node, ``gone`` marks gaps in ``x``."""
    at = np.repeat(start[None, :], len(x), axis=0)
    rows = np.arange(len(x))[:, None]
    while True:
        f = tree["feature"][at]
        inner = f >= 0
        if not inner.any():
            return at
        f = np.maximum(f, 0)
        missing = gone[rows, f]
        left = np.where(missing, tree["gaps"][at], x[rows, f] <= bounds[at])
        at = np.where(inner, np.where(left, tree["left"][at], tree["right"][at]), at)


@dataclass
class BoostedTrees(Fitted):
    """Trees over raw values: ``x <= cut`` goes left, gaps to the side that was best for them."""

    objective: str = "squared"
    base: list[float] = field(default_factory=list)
    feature: np.ndarray = None
    cut: np.ndarray = None
    gaps: np.ndarray = None
    left: np.ndarray = None
    right: np.ndarray = None
    value: np.ndarray = None
    gain: np.ndarray = None
    roots: np.ndarray = None
    sides: np.ndarray = None
    classes: list | None = None
    spans: list[int] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.repeat(np.array(self.base)[None, :], len(x), axis=0)
        tree = {"feature": self.feature, "gaps": self.gaps, "left": self.left, "right": self.right}
        gone = np.isnan(x)
        for start in range(0, len(self.roots), 64):
            roots, sides = self.roots[start : start + 64], self.sides[start : start + 64]
            worth = self.value[_walk(x, self.cut, gone, tree, roots)]
            for side in set(sides.tolist()):
                out[:, side] += worth[:, sides == side].sum(axis=1)
        return out

    def _outputs(self, df: DataFrame) -> Column:
        @F.pandas_udf("array<double>")
        def run(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            m = self.margins(np.stack(v.to_numpy()).astype(float))
            if self.objective == "logistic":
                p = _logistic(m)
                m = np.concatenate([1 - p, p], axis=1)
            elif self.objective == "softmax":
                m = _softmax(m)
            return pd.Series(list(m))

        return run(_filled(df, self.features))

    def predict(self, df: DataFrame) -> DataFrame:
        if self.objective == "squared":
            return df.withColumn("prediction", self._outputs(df)[0])
        staged = df.withColumn("_v", self._outputs(df))
        return with_probabilities(staged, F.col("_v"), self.classes).drop("_v")

    def importances(self) -> dict[str, float]:
        """Share of the total gain."""
        inner = self.feature >= 0
        sums = np.bincount(self.feature[inner], weights=self.gain[inner], minlength=sum(self.spans))
        return dict(zip(self.features, fold(sums / sums.sum() if sums.sum() > 0 else sums, self.spans)))


def _filled(df: DataFrame, features: Sequence[str]) -> Column:
    return F.transform(feature_array(df, features), lambda v: F.coalesce(v, F.lit(math.nan)))


def find_cuts(rows: DataFrame, width: int, max_bins: int) -> list[np.ndarray]:
    """Cuts of each number in ``_x``: midpoints between its values if they are at most ``max_bins``, else quantiles.

    A task reports a number's values only while they are few, so the exact way moves at most
    ``max_bins`` rows for each task and number.
    """

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.empty(0)] * width
        for b in batches:
            x = _matrix(b.column(0), width)
            for j in range(width):
                if seen[j] is not None:
                    v = x[:, j]
                    v = np.unique(np.concatenate([seen[j], v[~np.isnan(v)]]))
                    seen[j] = v if len(v) <= max_bins else None
        for j, v in enumerate(seen):
            values = pa.array([None] if v is None else v, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(values), pa.int32()), values], ["j", "v"])

    whole = Window.partitionBy("j")
    found = rows.select("_x").mapInArrow(few, "j int, v double").distinct()
    counted = found.select("j", "v", F.count("*").over(whole).alias("n"), F.count("v").over(whole).alias("k"))
    small = counted.where((F.col("n") == F.col("k")) & (F.col("k") <= max_bins))
    exact = {r.j: np.array(r.v) for r in small.groupBy("j").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()}
    cuts: list[np.ndarray] = [np.empty(0)] * width
    for j, v in exact.items():
        with np.errstate(all="ignore"):
            middle = v[:-1] + (v[1:] - v[:-1]) / 2
        cuts[j] = np.where(np.isfinite(middle) & (middle < v[1:]), middle, v[:-1])
    wide = [j for j in range(width) if j not in exact]
    probabilities = [i / max_bins for i in range(1, max_bins)]
    for start in range(0, len(wide), 64):
        some = wide[start : start + 64]
        values = [F.when(~F.isnan(F.col("_x")[j]), F.col("_x")[j]) for j in some]
        row = rows.agg(*[F.percentile_approx(v, probabilities, 20 * max_bins) for v in values], *[F.max(v) for v in values]).first()
        for slot, j in enumerate(some):
            spots = np.unique(np.array(row[slot] or [], dtype=float))
            cuts[j] = spots[spots < row[slot + len(some)]] if len(spots) else spots
    return cuts


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width).astype(float)


def _packed(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, BATCH):
            yield b.slice(start, BATCH)


class _Booster:
    def __init__(self, rows: DataFrame, width: int, base: list[float], loss: Objective, rule: Growth, max_bins: int, reach: float, count: int):
        plain = {k: float(getattr(rule, k)) for k in ("alpha", "penalty", "min_gain", "min_weight")}
        self.loss, self.rule, self.width = loss, replace(rule, **plain), width
        self.cuts = find_cuts(rows, width, max_bins)
        self.kind = np.dtype("uint8" if max(map(len, self.cuts)) + 1 < 256 else "uint16")
        bits = max(min(BITS, 59 - count.bit_length()), 8)
        self.scales = (2.0**bits / max(reach, 1e-300), 2.0**bits / 2)
        self.fresh: list[list[dict]] = []
        self.tasks = max(1, min(math.ceil(count / 20_000), 2 * rows.sparkSession.sparkContext.defaultParallelism))
        self.table = None
        self._keep(self._bin(rows, base))

    def _bin(self, rows: DataFrame, base: list[float]) -> DataFrame:
        cuts, kind, width = self.cuts, self.kind, self.width
        start = np.array(base).tobytes()

        def run(batches):
            for b in batches:
                x = _matrix(b.column(0), width)
                out = np.empty(x.shape, kind)
                for j in range(width):
                    out[:, j] = np.where(np.isnan(x[:, j]), len(cuts[j]) + 1, np.searchsorted(cuts[j], x[:, j], side="left"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in out], pa.binary()), b.column(1), b.column(2), pa.array([start] * len(x), pa.binary())],
                    ["bins", "y", "draw", "margin"],
                )

        return rows.select("_x", "_y", "_draw").mapInArrow(run, "bins binary, y double, draw long, margin binary")

    def _keep(self, df: DataFrame) -> None:
        old = self.table
        self.table = settle(df, "boosting")
        release(old)

    def close(self) -> None:
        release(self.table)

    def _replay(self):
        """Margins of a batch: those written last and the trees since then."""
        fresh, kind, width, sides = self.fresh, self.kind, self.width, self.loss.sides
        gaps = np.array([len(c) + 1 for c in self.cuts])

        def run(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            bins = _packed(b.column(0), kind, width)
            m = _packed(b.column(3), np.dtype("float64"), sides).copy()
            gone = bins == gaps
            for trees in fresh:
                for side, t in enumerate(trees):
                    m[:, side] += t["value"][_walk(bins, t["bin"], gone, t, np.zeros(1, np.int32))[:, 0]]
            return bins, gone, m

        return run

    def _rewrite(self) -> None:
        replay = self._replay()

        def run(batches):
            for b in _pieces(batches):
                _, _, m = replay(b)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in m], pa.binary())], ["bins", "y", "draw", "margin"]
                )

        self._keep(self.table.mapInArrow(run, self.table.schema))
        self.fresh = []

    def _histograms(self, trees: list[_Tree], asked: list[tuple[int, int]], chosen: list[int], share: float, round_: int) -> DataFrame:
        """(slot, feature, bin, g, h, n) in whole numbers; bin -1 holds the gaps."""
        replay, loss, (gs, hs) = self._replay(), self.loss, self.scales
        shapes = [t.arrays() for t in trees]
        slots = [np.full(len(t.split), -1) for t in trees]
        for slot, (side, node) in enumerate(asked):
            slots[side][node] = slot
        used = sorted({side for side, _ in asked})
        sizes = {j: len(self.cuts[j]) + 2 for j in chosen}
        total = len(asked)
        limit = int(share * 2**32)

        def run(batches):
            sums = {j: np.zeros((3, total * sizes[j]), np.int64) for j in chosen}
            for b in _pieces(batches):
                if not b.num_rows:
                    continue
                bins, gone, m = replay(b)
                g, h = loss(m, b.column(1).to_numpy())
                drawn = np.ones(b.num_rows, bool)
                if share < 1:
                    mixed = (b.column(2).to_numpy().view(np.uint64) ^ np.uint64(round_ + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    drawn = (mixed >> np.uint64(32)) < limit
                for side in used:
                    slot = slots[side][_walk(bins, shapes[side]["bin"], gone, shapes[side], np.zeros(1, np.int32))[:, 0]]
                    mine = np.flatnonzero((slot >= 0) & drawn)
                    gi, hi = np.rint(g[mine, side] * gs), np.rint(h[mine, side] * hs)
                    for j in chosen:
                        place, size = slot[mine] * sizes[j] + bins[mine, j], total * sizes[j]
                        sums[j][0] += np.bincount(place, gi, size).astype(np.int64)
                        sums[j][1] += np.bincount(place, hi, size).astype(np.int64)
                        sums[j][2] += np.bincount(place, minlength=size)
            for j in chosen:
                at = np.flatnonzero(sums[j][2])
                where = at % sizes[j]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at // sizes[j], pa.int32()), pa.array(np.full(len(at), j), pa.int32()),
                        pa.array(np.where(where == sizes[j] - 1, -1, where), pa.int32()), *[pa.array(s[at], pa.int64()) for s in sums[j]],
                    ],
                    ["slot", "feature", "bin", "g", "h", "n"],
                )

        return self.table.coalesce(self.tasks).mapInArrow(run, "slot int, feature int, bin int, g long, h long, n long")

    def _best(self, found: DataFrame, groups: int) -> DataFrame:
        """The best cut of every slot, or of each of its features; ties go to the first feature and lowest bin.

        Written as SQL text, since it is planned anew for every pass. In ``one`` stand the rows up to
        a bin, in ``gap`` those without a value, in ``whole`` all of the leaf.
        """
        (gs, hs), rule = self.scales, self.rule
        shuffles = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = found.repartition(min(groups, shuffles), "slot", "feature")
        summed = dealt.groupBy("slot", "feature", "bin").agg(F.expr("sum(g) AS g"), F.expr("sum(h) AS h"), F.expr("sum(n) AS n"))
        leaf = "OVER (PARTITION BY slot, feature)"
        so_far = "OVER (PARTITION BY slot, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
        table = summed.selectExpr(
            "slot", "feature", "bin", *[f"sum({c}) {so_far} AS {c}_one" for c in "ghn"], *[f"sum({c}) {leaf} AS {c}_whole" for c in "ghn"],
            *[f"sum(IF(bin < 0, {c}, 0)) {leaf} AS {c}_gap" for c in "ghn"],
        )

        def score(g: str, h: str) -> str:
            held, below = f"greatest(abs({g} / {gs!r}D) - {rule.alpha!r}D, 0D)", f"({h} / {hs!r}D + {rule.penalty!r}D)"
            return f"IF({below} > 0, power({held}, 2) / {below}, 0D)"

        def cut(gaps_left: bool) -> str:
            one = {c: f"{c}_one" if gaps_left else f"({c}_one - {c}_gap)" for c in "ghn"}
            rest = {c: f"({c}_whole - {one[c]})" for c in "ghn"}
            gain = f"{score(one['g'], one['h'])} + {score(rest['g'], rest['h'])} - {score('g_whole', 'h_whole')}"
            fits = f"bin >= 0 AND least({one['n']}, {rest['n']}) >= {max(rule.min_rows, 1)}"
            fits += f" AND least({one['h']}, {rest['h']}) / {hs!r}D >= {rule.min_weight!r}D AND {gain} > {max(rule.min_gain, 1e-12)!r}D"
            left = ", ".join(f"'{c}_left', {one[c]}" for c in "ghn")
            return f"named_struct('gain', IF({fits}, {gain}, NULL), 'feature', -feature, 'bin', -bin, 'gaps', {gaps_left}, {left})"

        fields = [f"max({c}_whole) AS {c}_all" for c in "ghn"]
        best = table.groupBy("slot", "feature").agg(F.expr(f"max(greatest({cut(True)}, {cut(False)})) AS b"), *[F.expr(f) for f in fields])
        if groups > COLLECTED:
            best = best.groupBy("slot").agg(F.expr("max(b) AS b"), *[F.expr(f"max({c}_all) AS {c}_all") for c in "ghn"])
        return best.selectExpr("slot", "b.*", "g_all", "h_all", "n_all")

    def grow(self, round_: int, chosen: list[int], share: float) -> list[_Tree]:
        trees = [_Tree() for _ in range(self.loss.sides)]
        asked = [(side, 0) for side in range(len(trees))]
        cells = 3 * sum(len(self.cuts[j]) + 2 for j in chosen)
        step = max(1, HISTOGRAM_CELLS // cells)
        gs, hs = self.scales
        while asked:
            for start in range(0, len(asked), step):
                some = asked[start : start + step]
                rows = self._best(self._histograms(trees, some, chosen, share, round_), len(some) * len(chosen)).collect()
                for side, node in some:
                    trees[side].known[node] = True
                best = {}
                for r in rows:
                    rank = (-math.inf if r.gain is None else r.gain, r.feature)
                    if r.slot not in best or rank > best[r.slot][0]:
                        best[r.slot] = rank, r
                for _, r in best.values():
                    side, node = some[r.slot]
                    t = trees[side]
                    t.sums[node] = (r.g_all / gs, r.h_all / hs, r.n_all)
                    if r.gain is not None and self.rule.open(t.depth[node], *t.sums[node][1:]):
                        t.split[node] = (r.gain, -r.feature, -r.bin, r.gaps, r.g_left / gs, r.h_left / hs, r.n_left)
            asked = [(side, node) for side, t in enumerate(trees) for node in t.select(self.rule)]
        done = []
        for t in trees:
            shape = t.arrays(t.picked)
            shape["value"] = np.array([self.rule.value(g, h) for g, h, _ in t.sums])
            done.append(shape)
        self.fresh.append(done)
        if len(self.fresh) * self.loss.sides >= REPLAYED:
            self._rewrite()
        return trees


def _flatten(rounds: list[list[_Tree]], cuts: list[np.ndarray], rule: Growth) -> dict[str, np.ndarray]:
    """All trees in one set of arrays, without the nodes that no tree kept; bins become values."""
    out = {k: [] for k in ("feature", "cut", "gaps", "left", "right", "value", "gain", "roots", "sides")}
    for trees in rounds:
        for side, t in enumerate(trees):
            kept = [0] + [k for i in sorted(t.picked) for k in t.kids[i]]
            place = {node: len(out["feature"]) + i for i, node in enumerate(kept)}
            out["roots"].append(place[0])
            out["sides"].append(side)
            for node in kept:
                inner = node in t.picked
                gain, j, b, gaps = t.split[node][:4] if inner else (0.0, -1, 0, False)
                left, right = t.kids[node] if inner else (node, node)
                out["feature"].append(j)
                out["cut"].append((cuts[j][b] if b < len(cuts[j]) else math.inf) if inner else 0.0)
                out["gaps"].append(gaps)
                out["left"].append(place[left])
                out["right"].append(place[right])
                out["value"].append(0.0 if inner else rule.value(*t.sums[node][:2]))
                out["gain"].append(gain)
    kinds = {"cut": float, "value": float, "gain": float, "gaps": bool}
    return {k: np.array(v, dtype=kinds.get(k, np.int32)) for k, v in out.items()}


def fit_boosted_trees(
    df: DataFrame, features: Sequence[str], label: str, task: str = "regression", key: str | None = None,
    n_estimators: int = 100, rule: Growth | None = None, subsample: float = 1.0, colsample: float = 1.0,
    max_bins: int = 255, class_factor: float | None = None, random_state: int = 42, notes: dict[str, str] | None = None,
) -> BoostedTrees:
    """Boost ``n_estimators`` rounds; several classes grow one tree each per round on softmax derivatives.

    Gaps and NaN in features are allowed and go to the better side of each cut. Rows without a label
    are left out. ``subsample`` draws rows by a hash of the key (without one, of the whole row, so that
    equal rows are drawn together). ``class_factor`` scales the second derivative for several classes
    (default classes / (classes - 1)). Margins start at the mean, or at the logarithms of the class shares.
    """
    require_numeric(df, features)
    rule, spans = rule or Growth(), widths(df, features)
    if task == "classification":
        classes = class_list(df, label)
        if not classes:
            raise ValueError("no row has a label")
        coded = with_code(df, label, classes)
        y = F.col("_code")
    else:
        classes, coded, y = None, df, ref(label).cast("double")
    mark = F.xxhash64(F.lit(random_state), ref(key)) if key else F.xxhash64(F.lit(random_state), _filled(df, features), y)
    rows = coded.select(_filled(df, features).alias("_x"), y.alias("_y"), mark.alias("_draw")).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    rows = settle(rows, "boosting")
    if classes is None:
        head = rows.agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), F.min("_y").alias("low"), F.max("_y").alias("high")).first()
        if not head.n:
            raise ValueError("no row has a label")
        count, base = head.n, [float(f"{head.mean:.12g}")]
        loss, reach = Objective("squared", 1), 2 * max(head.high - head.mean, head.mean - head.low)
    else:
        shares = {int(r._y): r["count"] for r in rows.groupBy("_y").count().collect()}
        count = sum(shares.values())
        logs = [math.log(shares[i] / count) for i in range(len(classes))]
        two, k = len(classes) == 2, len(classes)
        base = [logs[1] - logs[0]] if two else logs
        factor = class_factor or k / max(k - 1, 1)
        loss, reach = Objective("logistic" if two else "softmax", len(base), factor), 2.0
    width = sum(spans)
    generator = np.random.default_rng(random_state)
    booster = _Booster(rows, width, base, loss, rule, max_bins, reach, count)
    release(rows)
    rounds: list[list[_Tree]] = []
    try:
        for r in range(n_estimators if classes is None or len(classes) > 1 else 0):
            size = max(1, round(colsample * width))
            chosen = list(range(width)) if size >= width else sorted(generator.choice(width, size, replace=False).tolist())
            rounds.append(booster.grow(r, chosen, subsample))
    finally:
        booster.close()
    return BoostedTrees(
        list(features), dict(notes or {}), loss.kind, [float(b) for b in base], classes=classes, spans=spans,
        **_flatten(rounds, booster.cuts, rule),
    )
