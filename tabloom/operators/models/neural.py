"""Gradient training of small networks on packed shards.

Rows are dealt into shards by key hash and each shard is packed into one record, once.
In every round each shard runs a few epochs of mini-batch steps from the shared state; the
states are averaged by row count (iterative parameter mixing). It is the same at any
size: small data has ``SHARDS`` shards, larger data one for every ``SHARD_VALUES`` values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.hashing import hash_bucket
from ...functions.names import ref
from ...sources.shared import release, settle
from .base import Fitted, class_list, feature_array, require_numeric, widths, with_code, with_probabilities

SHARDS = 8
SHARD_VALUES = 4_000_000
#: Epochs of a shard between two averages.
LOCAL_EPOCHS = 5
ACTIVATIONS = ("relu", "tanh", "logistic", "identity")


def activate(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0.0)
    if kind == "tanh":
        return np.tanh(z)
    if kind == "logistic":
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    return z


def slope(a: np.ndarray, kind: str) -> np.ndarray:
    """Derivative of the activation from its value."""
    if kind == "relu":
        return (a > 0).astype(float)
    if kind == "tanh":
        return 1.0 - a * a
    if kind == "logistic":
        return a * (1.0 - a)
    return np.ones_like(a)


@dataclass
class Network:
    """Layer sizes and the loss; weights live in one flat vector."""

    sizes: list[int]
    activation: str = "relu"
    loss: str = "softmax"
    epsilon: float = 0.1

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return [(a + 1, b) for a, b in zip(self.sizes, self.sizes[1:])]

    @property
    def length(self) -> int:
        return sum(a * b for a, b in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        generator = np.random.default_rng(seed)
        parts = []
        for a, b in self.shapes:
            reach = math.sqrt((2.0 if self.activation == "logistic" else 6.0) / (a - 1 + b))
            parts.append(generator.uniform(-reach, reach, (a, b)).reshape(-1))
        return np.concatenate(parts)

    def layers(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append(flat[at : at + a * b].reshape(a, b))
            at += a * b
        return out

    def outputs(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Values of every layer; the last row of each weight matrix is the bias."""
        values = [x]
        weights = self.layers(flat)
        for i, w in enumerate(weights):
            z = values[-1] @ w[:-1] + w[-1]
            values.append(activate(z, self.activation) if i < len(weights) - 1 else z)
        if self.loss == "softmax":
            z = values[-1] - values[-1].max(axis=1, keepdims=True)
            e = np.exp(z)
            values[-1] = e / e.sum(axis=1, keepdims=True)
        return values

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
        values = self.outputs(flat, x)
        weights, last = self.layers(flat), values[-1]
        if self.loss == "softmax":
            code = y[:, 0].astype(int)
            loss = -np.log(np.maximum(last[np.arange(len(x)), code], 1e-300)).mean()
            delta = last.copy()
            delta[np.arange(len(x)), code] -= 1.0
        elif self.loss == "squared":
            delta = last - y
            loss = 0.5 * float((delta**2).sum(axis=1).mean())
        else:
            gap = last - y
            over = np.abs(gap) - self.epsilon
            loss = float(np.maximum(over, 0.0).sum(axis=1).mean())
            delta = np.where(over > 0, np.sign(gap), 0.0)
        delta = delta / len(x)
        grads: list[np.ndarray] = []
        for i in range(len(weights) - 1, -1, -1):
            grads.append(
                np.concatenate([values[i].T @ delta + decay * weights[i][:-1], delta.sum(axis=0, keepdims=True)]).reshape(-1)
            )
            if i:
                delta = (delta @ weights[i][:-1].T) * slope(values[i], self.activation)
        loss += 0.5 * decay * sum(float((w[:-1] ** 2).sum()) for w in weights)
        return loss, np.concatenate(grads[::-1])


@dataclass
class Settings:
    solver: str = "adam"
    rate: float = 0.001
    schedule: str = "constant"
    batch: int = 200
    alpha: float = 1e-4
    decay: float | None = None
    max_iter: int = 200
    tol: float = 1e-4
    patience: int = 10
    seed: int = 42


def epoch(net: Network, s: Settings, state: np.ndarray, x: np.ndarray, y: np.ndarray, number: int, shard: int) -> tuple[np.ndarray, float]:
    """One pass over a shard; the state is weights, two moment vectors and a step count."""
    p = net.length
    w, m, v, t = state[:p].copy(), state[p : 2 * p].copy(), state[2 * p : 3 * p].copy(), state[3 * p]
    order = np.random.default_rng([s.seed, number, shard]).permutation(len(x))
    size = min(s.batch, len(x))
    total = 0.0
    for at in range(0, len(x), size):
        rows = order[at : at + size]
        decay = s.decay if s.decay is not None else s.alpha / len(rows)
        loss, g = net.gradient(w, x[rows], y[rows], decay)
        total += loss * len(rows)
        t += 1
        rate = s.rate / math.sqrt(t) if s.schedule == "invscaling" else s.rate
        if s.solver == "adam":
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        else:
            m = 0.9 * m - rate * g
            w += 0.9 * m - rate * g
    return np.concatenate([w, m, v, [t]]), total / len(x)


class Watch:
    """Stop after ``patience`` epochs without a gain of ``tol`` in the loss."""

    def __init__(self, tol: float, patience: int):
        self.tol, self.patience, self.best, self.idle = tol, patience, math.inf, 0

    def done(self, loss: float) -> bool:
        self.idle = self.idle + 1 if loss > self.best - self.tol else 0
        self.best = min(self.best, loss)
        return self.idle > self.patience


def pack(
    df: DataFrame, key: str, x: Column, y: Sequence[Column], width: int, shard_values: int,
    into: Callable[[np.ndarray], np.ndarray] | None = None,
) -> tuple[DataFrame, int, int]:
    """One record per shard: (shard, n, x bytes, y bytes), rows in key order.

    With ``into`` the inputs are its values, ``width`` numbers a row; the shards hold what it is taken of, and rows
    whose values are no numbers are left out.
    """
    rows = df.select(ref(key).alias("_key"), x.alias("_x"), F.array(*[c.cast("double") for c in y]).alias("_y"))
    rows = rows.where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)) & ~F.exists("_y", lambda v: v.isNull() | F.isnan(v)))
    count = rows.count()
    shards = max(SHARDS, math.ceil(count * width / shard_values))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_key")
        xs = np.stack(part["_x"].to_numpy()).astype(float)
        ys = np.stack(part["_y"].to_numpy()).astype(float)
        if into is not None:
            whole = ~np.isnan(into(xs)).any(axis=1)
            part, xs, ys = part[whole], xs[whole], ys[whole]
            if not len(part):
                return pd.DataFrame({"shard": [], "n": [], "xs": [], "ys": []})
        return pd.DataFrame({"shard": [int(part["_shard"].iloc[0])], "n": [len(part)], "xs": [xs.tobytes()], "ys": [ys.tobytes()]})

    spread = rows.withColumn("_shard", hash_bucket(F.col("_key"), shards, "shard"))
    packed = spread.groupBy("_shard").applyInPandas(join, "shard int, n long, xs binary, ys binary")
    packed = settle(packed, "shards")
    if into is not None:
        count = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return packed, shards, count


def train(
    packed: DataFrame, shards: int, net: Network, s: Settings, into: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, list[float]]:
    p = net.length
    state = np.concatenate([net.start(s.seed), np.zeros(2 * p + 1)])
    targets = 1 if net.loss == "softmax" else net.sizes[-1]

    def unpack(row) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(row.xs).reshape(row.n, -1)
        return x if into is None else into(x), np.frombuffer(row.ys).reshape(row.n, targets)

    spark = packed.sparkSession
    watch, curve = Watch(s.tol, s.patience), []

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            for v in part["v"]:
                total = np.array(v) if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"v": [total]})

    for first in range(0, s.max_iter, LOCAL_EPOCHS):
        shared = spark.sparkContext.broadcast(state)
        epochs = range(first, min(first + LOCAL_EPOCHS, s.max_iter))

        def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(shared.value) + len(epochs) + 1)
            for part in parts:
                for row in part.itertuples():
                    x, y = unpack(row)
                    now, losses = shared.value, []
                    for number in epochs:
                        now, loss = epoch(net, s, now, x, y, number, row.shard)
                        losses.append(loss)
                    total += np.concatenate([now, losses, [1.0]]) * row.n
            yield pd.DataFrame({"v": [total]})

        # one array per task, added up in two steps: the driver sees a bounded number of them
        sums = packed.mapInPandas(step, "v array<double>").repartition(16).mapInPandas(add, "v array<double>").collect()
        shared.unpersist()
        flat = np.sum([r.v for r in sums], axis=0) if sums else np.zeros(1)
        if not flat[-1]:
            break
        flat = flat / flat[-1]
        state = flat[: len(state)]
        losses = flat[len(state) : -1].tolist()
        curve += losses
        if any([watch.done(v) for v in losses]):
            break
    return state[:p], curve


@dataclass
class NetworkFit(Fitted):
    network: Network = None
    weights: np.ndarray = None
    classes: list | None = None
    loss_curve: list[float] = field(default_factory=list)

    def _outputs(self, df: DataFrame) -> Column:
        net, w = self.network, self.weights

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(net.outputs(w, np.stack(x.to_numpy()).astype(float))[-1]))

        return run(feature_array(df, self.features))

    def predict(self, df: DataFrame) -> DataFrame:
        if self.classes is not None:
            return with_probabilities(df, self._outputs(df), self.classes)
        return df.withColumn("prediction", self._outputs(df)[0])


def _fit(df, features, target, key, net, s, shard_values):
    require_numeric(df, features)
    x = feature_array(df, features)
    packed, shards, _ = pack(df, key, x, [target], sum(widths(df, features)), shard_values)
    try:
        return train(packed, shards, net, s)
    finally:
        release(packed)


def _settings(solver, learning_rate_init, learning_rate, alpha, max_iter, random_state, tol) -> tuple[Settings, dict]:
    notes = {}
    if solver not in ("adam", "sgd"):
        notes["solver"] = f"ignored: {solver}"
        solver = "adam"
    if learning_rate not in ("constant", "invscaling"):
        notes["learning_rate"] = f"constant instead of {learning_rate}"
    return Settings(solver, learning_rate_init, learning_rate, alpha=alpha, max_iter=max_iter, seed=random_state, tol=tol), notes


def fit_mlp_classifier(
    df: DataFrame, features: Sequence[str], label: str, key: str, hidden_layer_sizes: Sequence[int] = (100,),
    activation: str = "relu", solver: str = "adam", alpha: float = 1e-4, learning_rate: str = "constant",
    learning_rate_init: float = 0.001, max_iter: int = 200, random_state: int = 42, tol: float = 1e-4,
    shard_values: int = SHARD_VALUES,
) -> NetworkFit:
    classes = class_list(df, label)
    net = Network([sum(widths(df, features)), *hidden_layer_sizes, len(classes)], activation, "softmax")
    s, notes = _settings(solver, learning_rate_init, learning_rate, alpha, max_iter, random_state, tol)
    coded = with_code(df, label, classes)
    weights, curve = _fit(coded, features, F.col("_code"), key, net, s, shard_values)
    return NetworkFit(list(features), notes, net, weights, classes=classes, loss_curve=curve)


def fit_mlp_regressor(
    df: DataFrame, features: Sequence[str], label: str, key: str, hidden_layer_sizes: Sequence[int] = (100,),
    activation: str = "relu", solver: str = "adam", alpha: float = 1e-4, learning_rate: str = "constant",
    learning_rate_init: float = 0.001, max_iter: int = 200, random_state: int = 42, tol: float = 1e-4,
    shard_values: int = SHARD_VALUES,
) -> NetworkFit:
    net = Network([sum(widths(df, features)), *hidden_layer_sizes, 1], activation, "squared")
    s, notes = _settings(solver, learning_rate_init, learning_rate, alpha, max_iter, random_state, tol)
    weights, curve = _fit(df, features, ref(label), key, net, s, shard_values)
    return NetworkFit(list(features), notes, net, weights, loss_curve=curve)
