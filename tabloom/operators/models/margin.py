"""Support vector classification and regression with explicit kernel maps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ...sources.shared import release
from .base import (
    Fitted, assemble, attach_vector, class_list, feature_array, fold, require_numeric, right_size, widths, with_code,
    with_probabilities,
)
from .neural import SHARD_VALUES, Network, Settings, pack, train


@dataclass
class KernelMap:
    """Feature map whose inner product is (linear, poly) or approaches (rbf) the kernel.

    rbf draws random Fourier features; poly lists all monomials of the exact degree,
    the map of the kernel with offset zero. With landmarks any of rbf, poly and sigmoid goes through
    the kernel with them, times the root of the pseudo-inverse of their own kernel matrix: exact
    on what the landmarks span.
    """

    kind: str
    gamma: float
    degree: int = 3
    width: int = 1
    directions: np.ndarray | None = None
    phases: np.ndarray | None = None
    landmarks: np.ndarray | None = None
    root: np.ndarray | None = None
    offset: float = 0.0

    @property
    def size(self) -> int:
        if self.root is not None:
            return self.root.shape[1]
        if self.kind == "rbf":
            return len(self.phases)
        if self.kind == "poly":
            return math.comb(self.width + self.degree - 1, self.degree)
        return self.width

    def kernel(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Kernel of all rows of ``x`` with all of ``z``."""
        inner = x @ z.T
        if self.kind == "rbf":
            apart = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1) - 2 * inner
            return np.exp(-self.gamma * np.maximum(apart, 0))
        if self.kind == "poly":
            return (self.gamma * inner + self.offset) ** self.degree
        if self.kind == "sigmoid":
            return np.tanh(self.gamma * inner + self.offset)
        return inner

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.root is not None:
            return self.kernel(x, self.landmarks) @ self.root
        if self.kind == "rbf":
            return math.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        if self.kind == "poly":
            out = []
            for term in combinations_with_replacement(range(self.width), self.degree):
                ways = math.factorial(self.degree)
                for j in set(term):
                    ways //= math.factorial(term.count(j))
                out.append(math.sqrt(ways * self.gamma**self.degree) * np.prod(x[:, list(term)], axis=1))
            return np.stack(out, axis=1)
        return x


def pick_landmarks(df: DataFrame, features: Sequence[str], count: int, seed: int) -> np.ndarray:
    """``count`` different rows by a hash of their values, whatever the layout; rows with gaps are left out."""
    rows = df.dropna(subset=list(features)).select(feature_array(df, features).alias("x"))
    drawn = rows.groupBy("x").agg(F.xxhash64(F.lit(seed), F.col("x")).alias("at")).orderBy("at", "x").limit(count)
    return np.array([r.x for r in drawn.collect()], dtype=float).reshape(-1, sum(widths(df, features)))


def with_landmarks(kernel: KernelMap, landmarks: np.ndarray, small: float = 1e-12) -> KernelMap:
    """The map through landmarks. Directions whose eigenvalue is at most ``small`` of the largest are left out.

    The sigmoid kernel can have negative eigenvalues; they have no real root and are left out too.
    """
    if not len(landmarks):
        raise ValueError("no complete row to take landmarks from")
    values, vectors = np.linalg.eigh(kernel.kernel(landmarks, landmarks))
    keep = values > small * max(values[-1], 0.0)
    if not keep.any():
        raise ValueError("the kernel vanishes on all landmarks")
    return replace(kernel, directions=None, phases=None, landmarks=landmarks, root=vectors[:, keep] / np.sqrt(values[keep]))


def fit_kernel_map(
    df: DataFrame, features: Sequence[str], kernel: str, gamma: str | float, degree: int, components: int, seed: int,
    method: str = "explicit", offset: float = 0.0,
) -> KernelMap:
    """``method="landmarks"`` goes through ``components`` landmarks (see KernelMap) and knows sigmoid kernels and offsets."""
    if method not in ("explicit", "landmarks"):
        raise ValueError(f"unknown method {method!r}")
    if kernel == "sigmoid" and method == "explicit":
        raise ValueError("the sigmoid kernel has no explicit feature map; use method='landmarks'")
    d = sum(widths(df, features))
    if gamma == "auto":
        gamma = 1.0 / d
    elif gamma == "scale" and d > len(features):
        packed = assemble(df, features).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_x")).alias("s")).first().s
        mean = packed.mean.toArray()
        var = packed.variance.toArray() * (packed["count"] - 1) / max(packed["count"], 1)
        whole = float(var.mean() + mean.var())
        gamma = 1.0 / (d * whole) if whole > 0 else 1.0
    elif gamma == "scale":
        row = df.agg(*[F.avg(ref(c).cast("double")) for c in features], *[F.var_pop(ref(c).cast("double")) for c in features]).first()
        mean, var = np.array(row[:d], dtype=float), np.array(row[d:], dtype=float)
        whole = float(var.mean() + mean.var())
        gamma = 1.0 / (d * whole) if whole > 0 else 1.0
    if method == "landmarks" and kernel != "linear":
        space = KernelMap(kernel, gamma, degree, d, offset=offset)
        return with_landmarks(space, pick_landmarks(df, features, components, seed))
    if kernel != "rbf":
        return KernelMap(kernel, gamma, degree, d)
    generator = np.random.default_rng(seed)
    return KernelMap(
        kernel, gamma, degree, d, generator.normal(0.0, math.sqrt(2 * gamma), (d, components)),
        generator.uniform(0.0, 2 * math.pi, components),
    )


def _notes(ignored: dict, method: str, offset: float) -> dict[str, str]:
    """What a fit did not use; explicit maps have offset zero."""
    unused = {**ignored, "coef0": offset} if method == "explicit" and offset else ignored
    return {k: f"ignored: {v}" for k, v in unused.items()}


def mapped(df: DataFrame, kernel: KernelMap, features: Sequence[str]) -> Column:
    x = feature_array(df, features)
    if kernel.kind == "linear":
        return x

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(kernel(np.stack(v.to_numpy()).astype(float))) if len(v) else [], dtype=object)

    return run(x)


def scored(df: DataFrame, kernel: KernelMap, features: Sequence[str], weights: np.ndarray, bias: np.ndarray) -> Column:
    """Array of linear scores in the mapped space, one per column of ``weights``."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(kernel(np.stack(v.to_numpy()).astype(float)) @ weights + bias))

    return run(feature_array(df, features))


@dataclass
class MarginClassifier(Fitted):
    kernel: KernelMap = None
    weights: np.ndarray = None
    bias: np.ndarray = None
    slopes: list[float] = field(default_factory=list)
    offsets: list[float] = field(default_factory=list)
    classes: list = field(default_factory=list)
    spans: list[int] = field(default_factory=list)

    def margins(self, df: DataFrame) -> Column:
        return scored(df, self.kernel, self.features, self.weights, self.bias)

    def predict(self, df: DataFrame) -> DataFrame:
        """The class of the largest margin; probabilities from a logistic fit on margins."""
        staged = df.withColumn("_m", self.margins(df))
        odds = [1 / (1 + F.exp(-(F.col("_m")[i] * a + b))) for i, (a, b) in enumerate(zip(self.slopes, self.offsets))]
        if len(self.classes) == 2:
            best = (F.col("_m")[0] > 0).cast("int")
            shares = [1 - odds[0], odds[0]]
        else:
            best = F.array_position("_m", F.array_max("_m")) - 1
            total = sum(odds, F.lit(0.0))
            shares = [o / total for o in odds]
        return with_probabilities(staged, F.array(*shares), self.classes, best).drop("_m")

    def importances(self) -> dict[str, float] | None:
        if self.kernel.kind != "linear":
            return None
        return dict(zip(self.features, fold(np.abs(self.weights).mean(axis=1), self.spans or [1] * len(self.features))))


def fit_svm(
    df: DataFrame, features: Sequence[str], label: str, C: float = 1.0, kernel: str = "rbf", degree: int = 3,
    gamma: str | float = "scale", components: int = 200, max_iter: int = 100, tol: float = 1e-3, random_state: int = 42,
    method: str = "explicit", coef0: float = 0.0, **ignored,
) -> MarginClassifier:
    """Linear machine in the kernel's feature space; several classes go one against the rest."""
    require_numeric(df, features)
    classes = class_list(df, label)
    space = fit_kernel_map(df, features, kernel, gamma, degree, components, random_state, method, coef0)
    coded = with_code(df.dropna(subset=[*features, label]), label, classes)
    x = F.col("_x") if kernel == "linear" else array_to_vector(mapped(coded, space, features)).alias("_x")
    rows = (attach_vector(coded, features) if kernel == "linear" else coded).select(x, F.col("_code").alias("_c")).persist()
    try:
        n = rows.count()
        sized = right_size(rows, n).persist()
        sides = [1] if len(classes) == 2 else range(len(classes))
        weights, bias, slopes, offsets = [], [], [], []
        for side in sides:
            data = sized.withColumn("_y", (F.col("_c") == side).cast("double"))
            svc = LinearSVC(
                featuresCol="_x", labelCol="_y", regParam=1.0 / (C * n), standardization=False, maxIter=max_iter,
                tol=tol,
            ).fit(data)
            weights.append(svc.coefficients.toArray())
            bias.append(svc.intercept)
            margin = svc.transform(data).select(
                "_y", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("_m")
            )
            odds = LogisticRegression(featuresCol="_m", labelCol="_y", regParam=1e-6, tol=1e-4).fit(margin)
            slopes.append(float(odds.coefficients[0]))
            offsets.append(float(odds.intercept))
        sized.unpersist()
    finally:
        rows.unpersist()
    return MarginClassifier(
        list(features), _notes(ignored, method, coef0), space, np.stack(weights, axis=1), np.array(bias),
        slopes, offsets, classes, widths(df, features),
    )


@dataclass
class MarginRegressor(Fitted):
    kernel: KernelMap = None
    weights: np.ndarray = None
    bias: float = 0.0

    def predict(self, df: DataFrame) -> DataFrame:
        score = scored(df, self.kernel, self.features, self.weights[:, None], np.array([self.bias]))
        return df.withColumn("prediction", score[0])


def fit_svr(
    df: DataFrame, features: Sequence[str], label: str, key: str, C: float = 1.0, epsilon: float = 0.1,
    kernel: str = "rbf", degree: int = 3, gamma: str | float = "scale", components: int = 200, max_iter: int = 200,
    learning_rate_init: float = 0.02, random_state: int = 42, shard_values: int = SHARD_VALUES, method: str = "explicit",
    coef0: float = 0.0, **ignored,
) -> MarginRegressor:
    """Epsilon-insensitive loss with the weight penalty 1/(C n), trained by mini-batch steps."""
    require_numeric(df, features)
    space = fit_kernel_map(df, features, kernel, gamma, degree, components, random_state, method, coef0)
    base = df.dropna(subset=[*features, label])
    # the map is many times as wide as the features, so shards hold these and map them when they are read
    into = None if kernel == "linear" else space
    packed, shards, count = pack(base, key, feature_array(base, features), [ref(label)], space.size, shard_values, into)
    net = Network([space.size, 1], "identity", "epsilon", epsilon)
    s = Settings(rate=learning_rate_init, decay=1.0 / (C * max(count, 1)), max_iter=max_iter, seed=random_state, tol=1e-5)
    try:
        flat, _ = train(packed, shards, net, s, into)
    finally:
        release(packed)
    layer = net.layers(flat)[0]
    return MarginRegressor(
        list(features), _notes(ignored, method, coef0), space, layer[:-1, 0], float(layer[-1, 0])
    )
