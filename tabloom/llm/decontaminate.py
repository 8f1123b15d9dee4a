"""Benchmark decontamination: passages within a share of edits of a benchmark item.

A random walk embeds a sequence of words so that edit distance becomes Hamming distance:
at each step the current word is written and a random bit of it decides whether the walk
moves on, so two walks over similar sequences fall into step again after an edit. Keys
of a few sampled positions, over several walks, are matched between the items and
item-sized windows of a document; every match is confirmed by its exact edit distance.

Windows are taken at every word where a match is possible at all: an item of m words
within k edits of a passage shares all but 2k of its distinct word pairs with it, so
places with fewer distinct pairs of any item cannot hold one. Nothing else is left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import add_columns, whole_texts
from .shingles import U, mix, window_hashes, word_hashes

#: Edits per word of an item that still count as the same passage.
EDITS = 0.2
#: Items with fewer words are too common to be recognised.
LEAST_WORDS = 5
#: Random walks, keys per walk, and positions per key: a passage with a fifth of its words edited is missed about
#: once in a thousand times (tests/llm measure it).
WALKS = 6
KEYS = 40
SAMPLED = 3
#: Items per pass over the documents, and characters of their texts.
BLOCK_ITEMS = 5_000
BLOCK_CHARACTERS = 8_000_000


def allowed(words: int) -> int:
    return int(EDITS * words)


def embed(windows: np.ndarray) -> np.ndarray:
    """(walk, row, step): random walks over each row of word hashes, twice as many steps as words; 0 beyond the end."""
    n, m = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), U)], axis=1)
    at, rows = np.zeros((WALKS, n), np.int64), np.arange(n)
    # the bit that moves a walk on: the highest of the word's product with an odd number of its own for walk and step
    odd = mix(np.arange(1, WALKS * 2 * m + 1, dtype=U)).reshape(2 * m, WALKS, 1) | U(1)
    out = np.empty((2 * m, WALKS, n), U)
    for step in range(2 * m):
        out[step] = here = padded[rows, at]
        at += ((here * odd[step]) >> U(63)).view(np.int64)
        np.minimum(at, m, out=at)
    return out.transpose(1, 2, 0)


def sampled_keys(windows: np.ndarray) -> np.ndarray:
    """(row, key number) -> hash of the sampled positions; equal-sized rows only."""
    n, m = windows.shape
    out = np.empty((n, WALKS * KEYS), U)
    for walk, embedded in enumerate(embed(windows)):
        places = np.random.default_rng([m, walk]).integers(0, 2 * m, (KEYS, SAMPLED))
        key = np.zeros((n, KEYS), U)
        for j in range(SAMPLED):
            key = key * U(0x9E3779B97F4A7C15) + mix(embedded[:, places[:, j]])
        out[:, walk * KEYS : (walk + 1) * KEYS] = key
    return out


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits between the item and any passage of the words, and where that passage starts and ends."""
    previous = np.zeros(len(words) + 1, np.int64)
    starts = np.arange(len(words) + 1)
    steps = np.arange(len(words) + 1)
    for i, w in enumerate(item, 1):
        substitute = previous[:-1] + (words != w)
        delete = previous[1:] + 1
        now = np.empty_like(previous)
        now[0] = i
        now[1:] = np.minimum(substitute, delete)
        begin = np.empty_like(starts)
        begin[0] = 0
        begin[1:] = np.where(substitute <= delete, starts[:-1], starts[1:])
        # an insertion costs one per word, so the best way along the row is a running minimum
        low = np.minimum.accumulate(now - steps)
        source = np.maximum.accumulate(np.where(now - steps == low, steps, 0))
        previous, starts = low + steps, begin[source]
    end = int(previous.argmin())
    return int(previous[end]), int(starts[end]), end


class Matcher:
    """Finds the items of a block in one text."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t or "") for _, t in items]
        self.of_pair: dict[int, list[int]] = defaultdict(list)
        self.needed: dict[int, int] = {}  # distinct pairs of an item that any match of it has
        for n, words in enumerate(self.words):
            if len(words) >= LEAST_WORDS:
                pairs = set(window_hashes(words, 2).tolist())
                self.needed[n] = max(1, len(pairs) - 2 * allowed(len(words)))
                for pair in pairs:
                    self.of_pair[pair].append(n)
        self.least = min(self.needed.values(), default=1)
        self.span = max((len(w) + allowed(len(w)) for w in self.words), default=0)
        bits = max(16, (16 * max(1, len(self.of_pair))).bit_length())
        self.shift = U(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[np.fromiter(self.of_pair, U, len(self.of_pair)) >> self.shift] = True
        self.keys: dict[int, np.ndarray] = {}

    def _keys(self, n: int) -> np.ndarray:
        """Keys of an item."""
        if n not in self.keys:
            self.keys[n] = sampled_keys(self.words[n][None])[0]
        return self.keys[n]

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, edits, first word, words) of each item in the text, at its best place."""
        words = word_hashes(text)
        if len(words) < 2 or not self.of_pair:
            return []
        pairs = window_hashes(words, 2)
        hits = np.flatnonzero(self.known[pairs >> self.shift])
        if len(hits) < self.least or (hits[self.least - 1 :] - hits[: len(hits) - self.least + 1]).min() >= self.span:
            return []
        places: dict[int, list[int]] = defaultdict(list)
        distinct: dict[int, set[int]] = defaultdict(set)
        for at, pair in zip(hits.tolist(), pairs[hits].tolist()):
            for n in self.of_pair.get(pair, ()):
                places[n].append(at)
                distinct[n].add(pair)
        sizes: dict[int, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
        for n, at in places.items():
            m = len(self.words[n])
            k, least = allowed(m), self.needed[n]
            if len(distinct[n]) < least:
                continue
            # the pairs of one passage lie within its own length
            for first, last in zip(at, at[least - 1 :]):
                if last - first < m + k:
                    low, high = max(0, last - m - 2 * k), min(len(words) - 1, first + 2 * k + 1)
                    sizes[m][0].update(range(low, high + 1))
                    sizes[m][1].add(n)
        found: dict[int, tuple[int, int, int]] = {}
        for m, (starts, items) in sizes.items():
            k = allowed(m)
            padded = np.concatenate([words, np.zeros(m, U)])
            starts_ = np.array(sorted(starts))
            for begin in range(0, len(starts_), 1024):
                part = starts_[begin : begin + 1024]
                keys = sampled_keys(padded[part[:, None] + np.arange(m)])
                for n in items:
                    at = part[(keys == self._keys(n)).any(axis=1)]
                    for low, high in joined(at.tolist(), m) if len(at) else ():
                        low, high = max(0, low - k), min(len(words), high + m + k)
                        edits, first, end = best_match(self.words[n], words[low:high])
                        if edits <= k and (n not in found or edits < found[n][0]):
                            found[n] = (edits, low + first, end - first)
        return [(self.ids[n], *rest) for n, rest in sorted(found.items())]


def joined(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Runs of starts with no wider gap."""
    low = high = starts[0]
    for s in starts[1:]:
        if s - high > gap:
            yield low, high
            low = s
        high = s
    yield low, high


def blocks_of(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of a bounded size."""
    block: list[tuple[object, str]] = []
    size = 0
    for row in whole_texts(benchmark, item, text).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row[1]) > BLOCK_CHARACTERS):
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def benchmark_matches(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, item, edits, first_word, n_words) of each document row and each item that a passage of it matches.

    Words are cut at ASCII blanks, A-Z lower-cased. A passage matches an item within a
    fifth of the item's words in edits (words put in, left out or exchanged); of several
    the best and first is returned. Items of fewer than five words are not looked for.
    Null or empty texts match nothing; repeated rows and items are matched one by one;
    other columns are ignored; empty tables give an empty result.
    """
    texts = whole_texts(df, key, text)
    kinds = {key: texts.schema[key].dataType.simpleString(), item: benchmark.schema[item].dataType.simpleString()}
    schema = f"`{key}` {kinds[key]}, `{item}` {kinds[item]}, edits int, first_word long, n_words long"
    out = df.sparkSession.createDataFrame([], schema)
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    for block in blocks_of(benchmark, item, item_text):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                rows, ids, rest = [], [], ([], [], [])
                for n, t in enumerate(batch.column(1).to_pylist()):
                    for found, *numbers in matcher.find(t):
                        rows.append(n)
                        ids.append(found)
                        for column, v in zip(rest, numbers):
                            column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, item_type), pa.array(rest[0], pa.int32()),
                     pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.int64())],
                    names=[key, item, "edits", "first_word", "n_words"],
                ) if rows else _none(batch.schema.field(0).type, item_type, key, item)

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def _none(key_type: pa.DataType, item_type: pa.DataType, key: str, item: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(0, key_type), pa.nulls(0, item_type), pa.nulls(0, pa.int32()), pa.nulls(0, pa.int64()),
         pa.nulls(0, pa.int64())], names=[key, item, "edits", "first_word", "n_words"],
    )


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows, all columns, in which no item is found (see ``benchmark_matches``)."""
    for block in blocks_of(benchmark, item, item_text):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            matcher = Matcher(shared.value)
            return lambda batch: [np.array([not matcher.find(t) for t in batch], bool)]

        df = add_columns(df, make, "__clean boolean", text).where("__clean").drop("__clean")
    return df
