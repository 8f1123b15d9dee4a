"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each n-gram seen in a text is an indicator scaled by its class log-count ratio; a linear
hinge-loss model over the scaled indicators is fitted by dual coordinate descent. Besides
word n-grams there are n-grams of word shapes (case, digits, marks, a word repeated), so
that texts in any language and of unseen words are judged by their form.

The model is fitted on a bounded sample of labelled rows (``common.LABELLED_ROWS``) and
is a table of weights of bounded size; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LABELLED_ROWS, add_columns, fold, labelled_sample, map_texts, whole_texts, worker_table

#: Hashed n-grams; two that collide share a weight.
FEATURES = 1 << 18
#: Passes of the coordinate descent, and the cost of a margin violation.
PASSES = 12
COST = 0.05
#: Parts of the sample; each is scored by a model of the others to calibrate probabilities.
PARTS = 3
#: Word shapes a worker keeps.
SHAPES = 300_000


def shape(word: str) -> str:
    """Form of a word: its letters' case, digits and marks, each run shortened to one sign."""
    out = []
    for c in word if len(word) <= 40 else word[:20] + word[-20:]:
        if c.isalpha():
            sign = "X" if c.isupper() else "x"
        else:
            sign = "9" if c.isdigit() else c
        if not out or out[-1] != sign:
            out.append(sign)
        elif len(out) < 2 or out[-2] != sign:
            out.append(sign)
    return "".join(out)


class ShapeTable(dict):
    """Word -> shape, kept by a worker up to a size."""

    def __missing__(self, word: str) -> str:
        if len(self) > SHAPES:
            self.clear()
        found = shape(word)
        if len(word) <= 40:
            self[word] = found
        return found


def grams(text: str) -> set:
    """Distinct words, and n-grams of one to three shapes; a word like the one before has the shape '='."""
    words = text.split()
    shapes = list(map(worker_table("shapes", ShapeTable).__getitem__, words))
    for i in [i for i, (a, b) in enumerate(zip(words, words[1:]), 1) if a == b]:
        shapes[i] = "="
    out: set = set(words)
    out.update(zip(shapes))
    out.update(zip(shapes, shapes[1:]))
    out.update(zip(shapes, shapes[1:], shapes[2:]))
    return out


def indicators(text: str) -> np.ndarray:
    """Sorted distinct hashed n-grams of a text."""
    from zlib import crc32

    keys = ["\0".join(g) if isinstance(g, tuple) else "\1" + g for g in grams(text)]
    found = np.fromiter((crc32(k.encode("utf-8", "surrogatepass")) for k in keys), np.int64, len(keys))
    return np.unique(found % FEATURES)


@dataclass
class LinearModel:
    """score = 1 / (1 + exp(-(slope * margin + offset)))."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, items: np.ndarray) -> float:
        return float(self.weights[items].sum() / math.sqrt(len(items) or 1) + self.bias)

    def score(self, items: np.ndarray) -> float:
        z = self.slope * self.margin(items) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log of each feature's smoothed share among positive rows over that among negative ones."""
    counts = np.ones((2, FEATURES))
    for items, label in zip(rows, y):
        counts[int(label), items] += 1
    counts /= np.array([[(y == 0).sum() + 2.0], [(y == 1).sum() + 2.0]])
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, seed: int = 0) -> LinearModel:
    """Hinge-loss model over indicators scaled by the ratios and by the row's length; classes weigh alike."""
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    bound = COST * 0.5 / np.maximum(share, 1e-9)[y.astype(int)] * math.sqrt(len(rows))
    scaled = [ratios[r] / math.sqrt(len(r) or 1) for r in rows]
    norms = np.array([float(s @ s) + 1.0 for s in scaled])
    alpha = np.zeros(len(rows))
    weights, bias = np.zeros(FEATURES), 0.0
    random = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in random.permutation(len(rows)):
            items, x = rows[i], scaled[i]
            slack = sign[i] * (float(weights[items] @ x) + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[items] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return LinearModel(weights * ratios, bias)


def calibrate(model: LinearModel, margins: np.ndarray, y: np.ndarray) -> LinearModel:
    """Slope and offset of the probability, by Newton steps on held-out margins with smoothed targets."""
    positive, negative = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        hessian = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(max(a, 1e-3)), float(b)
    return model


def fit(rows: list[np.ndarray], y: np.ndarray, parts: np.ndarray) -> LinearModel:
    """Model of all rows, its probabilities calibrated on rows that a model did not see.

    Without rows of both classes the score is the share of the class that there is
    (0.5 without any row).
    """
    if not len(rows) or y.min() == y.max():
        return LinearModel(np.zeros(FEATURES), 0.0, 1.0, 0.0 if not len(rows) else (4.6 if y[0] == 1 else -4.6))

    def train(index: np.ndarray) -> LinearModel:
        chosen = [rows[i] for i in index]
        return dual_descent(chosen, y[index], log_ratios(chosen, y[index]))

    margins = np.zeros(len(rows))
    for part in range(PARTS):
        inside, outside = np.flatnonzero(parts != part), np.flatnonzero(parts == part)
        if len(outside) and len(np.unique(y[inside])) == 2:
            model = train(inside)
            margins[outside] = [model.margin(rows[i]) for i in outside]
    return calibrate(train(np.arange(len(rows))), margins, y)


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LABELLED_ROWS, key: str = "doc_id",
    text: str = "text",
) -> LinearModel:
    """Fit on at most ``limit`` labelled rows whose crc32 fold is not 0; only hashed n-grams reach the driver."""
    sample = labelled_sample(docs, labels, label, limit, key=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [indicators(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(items, pa.binary()), batch.column(2)], names=["part", "items", "y"]
            )

    part = F.pmod(F.xxhash64(F.lit(17), F.col(f"`{key}`")), F.lit(PARTS)).cast("int")
    packed = sample.select(part.alias("part"), F.col(f"`{text}`").alias("text"), "y").mapInArrow(
        run, "part int, items binary, y double"
    )
    found = sorted((r.part, bytes(r.items), r.y) for r in packed.toLocalIterator())
    rows = [np.frombuffer(items, np.int32) for _, items, _ in found]
    y = np.array([v for _, _, v in found])
    return fit(rows, y, np.array([p for p, _, _ in found], np.int64))


def score_quality(
    df: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, limit: int = LABELLED_ROWS,
    key: str = "doc_id", text: str = "text", train: DataFrame | None = None,
) -> DataFrame:
    """(key, held_out, score, predicted) of every whole text.

    ``score`` is the probability of label 1; ``predicted`` is 1 from ``threshold`` on.
    The model learns from labelled rows of ``train`` (``df`` unless given). A null text
    is empty; an empty text gets the score of no n-grams. Null keys belong to the fold
    of the empty text. Rows with repeated keys are scored one by one; other columns are
    ignored; an empty table gives an empty result.
    """
    work = scorer(df if train is None else train, labels, label, limit, key, text)
    held = whole_texts(df, key, text).select(key, (fold(key, 5) == 0).alias("held_out"), text)
    return map_texts(held, work, "score double", text).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scorer(train: DataFrame, labels: DataFrame, label: str, limit: int, key: str, text: str):
    """What ``map_texts`` needs to score texts with a model fitted on ``train``."""
    model = fit_quality(train, labels, label, limit, key, text)
    shared = train.sparkSession.sparkContext.broadcast(
        (model.weights.astype(np.float32), model.bias, model.slope, model.offset)
    )

    def make():
        fitted = LinearModel(*shared.value)
        return lambda batch: [np.array([fitted.score(indicators(t)) for t in batch], np.float64)]

    return make


def drop_low_quality(
    df: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, limit: int = LABELLED_ROWS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows, all columns, whose score reaches ``threshold``; scores as in ``score_quality``."""
    make = scorer(df, labels, label, limit, key, text)
    return add_columns(df, make, "__score double", text).where(F.col("__score") >= threshold).drop("__score")
