"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Features are densities of a lexicon, how near its words stand to words that address the
reader, and rates of capitals, marks and disguised words. The lexicon is learned from the
labelled rows: word stems whose documents are toxic far more often than others, so it
holds for every language that has labels. While the trees are fitted, a row's features
use a lexicon learned without that row's part of the sample.

Lexicon and trees are fitted on a bounded sample of labelled rows
(``common.LABELLED_ROWS``); scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, settle
from .common import LABELLED_ROWS, add_columns, fold, labelled_sample, map_texts, whole_texts, worker_table

#: Letters of a stem; shorter words stand for themselves.
STEM = 4
#: Documents a stem must occur in, and how far its log odds must lie above the average, to be in the lexicon.
LEAST_DOCS = 3
STRONG = 2.0
#: Lexicon size at most; the strongest stems stay.
LEXICON = 4_000
#: Parts of the sample; a row's features come from a lexicon of the other parts.
PARTS = 4
TREES = 60
TREE_DEPTH = 3
RATE = 0.2
BINS = 64
#: Words around a lexicon word in which an address counts.
NEAR = 4

# Words that address the reader, in English, French, German and Spanish.
ADDRESS = frozenset(
    "you your yours yourself yourselves u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
    "sie tú ti usted ustedes vosotros tus vuestro".split()
)
# Signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
TRIM = ".,;:!?\"'()[]{}|*%&#$-–—…«»<>/\\"

NAMES = (
    "lexicon_density", "lexicon_count", "lexicon_strongest", "lexicon_weight", "address_near", "address_density",
    "capital_share", "capital_words", "exclamations", "questions", "marks", "disguised", "stretched", "length",
)


def stem(word: str) -> str:
    """First letters of a word in lower case, signs that stand for letters put back."""
    word = word.strip(TRIM).lower()
    if not word.isalpha():
        plain = word.translate(DISGUISE)
        word = "".join(c for c in plain if c.isalpha()) if any(c.isalpha() for c in word) else ""
    return word[:STEM]


class StemTable(dict):
    """Word -> stem, kept by a worker up to a size."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        found = stem(word)
        if len(word) <= 48:
            self[word] = found
        return found


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = text.split()
    n = len(words) or 1
    stems = list(map(worker_table("stems", StemTable).__getitem__, words))
    hits = [i for i, s in enumerate(stems) if s in lexicon]
    weights = [lexicon[stems[i]] for i in hits]
    near = 0
    for i in hits:
        around = words[max(0, i - NEAR) : i + NEAR + 1]
        near += any(w.strip(TRIM).lower() in ADDRESS for w in around)
    distinct = set(words)
    address = sum(map(ADDRESS.__contains__, map(str.lower, words)))
    upper = sum(map(len, _UPPER(text)))
    size = len(text) or 1
    odd = [w for w in distinct if not w.isalpha()]
    disguised = sum(1 for w in odd if _disguised(w))
    stretched = sum(1 for w in distinct if _STRETCHED(w))
    return [
        len(hits) / n, math.log1p(len(hits)), max(weights, default=0.0), sum(weights) / math.sqrt(n), near / n,
        address / n, upper / size, sum(1 for w in distinct if len(w) > 1 and w.isupper()) / (len(distinct) or 1),
        text.count("!") / size, text.count("?") / size, sum(map(text.count, ".,;:*%&#$|")) / size,
        disguised / (len(distinct) or 1), stretched / (len(distinct) or 1), math.log1p(n),
    ]


_STRETCHED = re.compile(r"([A-Za-z])\1\1").search
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+").findall


def _disguised(word: str) -> bool:
    """Letters with a sign between them that may stand for a letter."""
    inner = word.strip(".,;:!?\"'()[]{}|-")
    return len(inner) > 2 and any(c in "013457@$!" for c in inner[1:-1]) and sum(map(str.isalpha, inner)) >= 2


def learn_lexicon(positive: Counter, negative: Counter, n_positive: int, n_negative: int) -> dict[str, float]:
    """Stems with their log odds of being toxic, smoothed, those far above the average only."""
    found = {}
    for s, p in positive.items():
        if s and p >= LEAST_DOCS:
            odds = math.log((p + 0.5) / (n_positive + 1)) - math.log((negative[s] + 0.5) / (n_negative + 1))
            if odds >= STRONG:
                found[s] = odds
    return dict(sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))[:LEXICON])


@dataclass
class Tree:
    """Complete tree: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def value(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(TREE_DEPTH):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.threshold[at])
        return self.leaf[at - (2**TREE_DEPTH - 1)]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    knots: list[float] = field(default_factory=list)
    levels: list[float] = field(default_factory=list)

    def packed(self) -> tuple:
        """Plain values, as they are sent to workers."""
        trees = [(t.feature, t.threshold, t.leaf) for t in self.trees]
        return self.lexicon, self.base, trees, self.knots, self.levels

    @classmethod
    def unpacked(cls, values: tuple) -> ToxicityModel:
        lexicon, base, trees, knots, levels = values
        return cls(lexicon, base, [Tree(*t) for t in trees], knots, levels)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + RATE * sum((t.value(x) for t in self.trees), np.zeros(len(x)))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Linear between the calibration's steps, with a trace of the raw value so that ranks stay."""
        if not self.knots:
            return 1 / (1 + np.exp(-raw))
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(level * 0.998 + 0.002 / (1 + np.exp(-raw)), 0.0, 1.0)


def fit_tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
    """Second-order splits level by level from histograms of the binned features."""
    inner = 2**TREE_DEPTH - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), np.int64)
    width = x.shape[1]
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        if len(rows):
            G, H = g[rows].sum(), h[rows].sum()
            best = 1e-6
            for f in range(width):
                sum_g = np.bincount(bins[rows, f], g[rows], BINS)[:-1].cumsum()
                sum_h = np.bincount(bins[rows, f], h[rows], BINS)[:-1].cumsum()
                other_g, other_h = G - sum_g, H - sum_h
                gain = sum_g**2 / (sum_h + 1) + other_g**2 / (other_h + 1) - G**2 / (H + 1)
                gain[(sum_h < 0.5) | (other_h < 0.5)] = 0
                gain = gain[: len(edges[f])]
                if len(gain) and gain.max() > best:
                    best = gain.max()
                    feature[node], threshold[node] = f, edges[f][int(gain.argmax())]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
    leaves = at - inner
    sum_g = np.bincount(leaves, g, inner + 1)
    sum_h = np.bincount(leaves, h, inner + 1)
    return Tree(feature, threshold, -sum_g / (sum_h + 1))


def boost(x: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Logistic loss, shrunken trees of fixed depth."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = ToxicityModel(base=math.log(share / (1 - share)))
    raw = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = fit_tree(x, bins, edges, p - y, p * (1 - p))
        model.trees.append(tree)
        raw += RATE * tree.value(x)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Non-decreasing steps of the label share by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, lowest and highest raw value
    for v, label in zip(raw[order], y[order]):
        blocks.append([label, 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    knots, levels = [], []
    for s, n, low, high in blocks:
        for v in (low, high) if high > low else (low,):
            knots.append(float(v))
            levels.append(float(s / n))
    return knots, levels


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LABELLED_ROWS, key: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """Fit on at most ``limit`` labelled rows whose crc32 fold is not 0. Stem counts and features reach the driver.

    Without rows of both classes the model gives every text the class there is.
    """
    part = F.pmod(F.xxhash64(F.lit(19), F.col(f"`{key}`")), F.lit(PARTS)).cast("int")
    sample = labelled_sample(docs, labels, label, limit, key=key, text=text).select(
        part.alias("part"), F.col(f"`{text}`").alias("text"), "y"
    )
    sample = settle(sample, "labelled")
    sizes = {(r.part, r.y): r.n for r in sample.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    if len({y for _, y in sizes}) < 2:
        release(sample)
        only = next(iter({y for _, y in sizes}), 0.5)
        return ToxicityModel(base={0.0: -4.6, 1.0: 4.6}.get(only, 0.0))

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        table = worker_table("stems", StemTable)
        for batch in batches:
            for p, t, y in zip(*(c.to_pylist() for c in batch.columns)):
                counts.update((p, y, s) for s in {table[w] for w in t.split()})
        if counts:
            p, y, s = zip(*counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "y": y, "stem": s, "n": list(counts.values())})

    counted = sample.mapInArrow(stems, "part int, y double, stem string, n long").groupBy("stem").agg(
        *[F.sum(F.when((F.col("y") == v) & (F.col("part") == p), F.col("n")).otherwise(0)).alias(f"n{v}_{p}")
          for v in (0, 1) for p in range(PARTS)]
    )
    total = [sum(F.col(f"n{v}_{p}") for p in range(PARTS)) for v in (0, 1)]
    # far weaker than what any lexicon below asks for, so that none misses a stem
    ratio = (total[1] + 0.5) / (total[0] + 0.5)
    n1 = sum(n for (_, y), n in sizes.items() if y == 1)
    n0 = sum(n for (_, y), n in sizes.items() if y == 0)
    strong = (total[1] >= LEAST_DOCS) & (ratio >= F.lit(math.exp(STRONG / 2) * n1 / max(n0, 1)))
    found = counted.where(strong).orderBy(F.desc(ratio), F.desc(total[1]), "stem").limit(8 * LEXICON).collect()
    tables = {v: [Counter({r.stem: r[f"n{v}_{p}"] for r in found}) for p in range(PARTS)] for v in (0, 1)}

    def lexicon(without: int | None) -> dict[str, float]:
        chosen = [p for p in range(PARTS) if p != without]
        pos, neg = (sum((tables[v][p] for p in chosen), Counter()) for v in (1, 0))
        return learn_lexicon(pos, neg, *(sum(sizes.get((p, float(v)), 0) for p in chosen) for v in (1, 0)))

    lexicons = [lexicon(p) for p in range(PARTS)]

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0)
            rows = [features(t, lexicons[p]) for p, t in zip(parts.to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [parts, pa.array(rows, pa.list_(pa.float64())), batch.column(2)], names=["part", "x", "y"]
            )

    rows = sorted((r.part, tuple(r.x), r.y) for r in sample.mapInArrow(dense, "part int, x array<double>, y double").collect())
    release(sample)
    part_of = np.array([r[0] for r in rows])
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    raw = np.zeros(len(y))
    for p in range(PARTS):
        inside = part_of != p
        if (~inside).any() and len(np.unique(y[inside])) == 2:
            raw[~inside] = boost(x[inside], y[inside]).raw(x[~inside])
    model = boost(x, y)
    model.lexicon = lexicon(None)
    model.knots, model.levels = isotonic(raw, y)
    return model


def score_toxicity(
    df: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, limit: int = LABELLED_ROWS,
    key: str = "doc_id", text: str = "text", train: DataFrame | None = None,
) -> DataFrame:
    """(key, held_out, score, predicted) of every whole text.

    ``score`` is the calibrated probability of label 1; ``predicted`` is 1 from
    ``threshold`` on. The model learns from labelled rows of ``train`` (``df`` unless
    given). A null text is empty and gets the score of features that are all zero. Null
    keys belong to the fold of the empty text. Rows with repeated keys are scored one by
    one; other columns are ignored; an empty table gives an empty result.
    """
    work = scorer(df if train is None else train, labels, label, limit, key, text)
    held = whole_texts(df, key, text).select(key, (fold(key, 5) == 0).alias("held_out"), text)
    return map_texts(held, work, "score double", text).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scorer(train: DataFrame, labels: DataFrame, label: str, limit: int, key: str, text: str):
    """What ``map_texts`` needs to score texts with a model fitted on ``train``."""
    shared = train.sparkSession.sparkContext.broadcast(fit_toxicity(train, labels, label, limit, key, text).packed())

    def make():
        fitted = ToxicityModel.unpacked(shared.value)

        def work(batch: list[str]) -> list:
            if not batch:
                return [np.empty(0)]
            x = np.array([features(t, fitted.lexicon) for t in batch])
            return [fitted.calibrated(fitted.raw(x))]

        return work

    return make


def drop_toxic(
    df: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, limit: int = LABELLED_ROWS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows, all columns, whose score stays below ``threshold``; scores as in ``score_toxicity``."""
    make = scorer(df, labels, label, limit, key, text)
    return add_columns(df, make, "__score double", text).where(F.col("__score") < threshold).drop("__score")
