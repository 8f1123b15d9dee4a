"""Passages that occur more than once, found by a depth-limited radix ordering of suffixes.

A suffix matters only through its first ``length`` bytes, its window. Windows are ordered by
most-significant-digit passes, each of which deals them by more of their bytes and lets go of
windows that are alone; groups still equal at full depth are exactly the repeated windows.

The first digit of a window is its lowest gram of ``GRAM`` bytes (by a hash, leftmost of equal
ones). Neighbouring windows mostly share it, so that one row, an *anchor*, stands for a whole run
of suffixes: about one row for 77 bytes of text instead of one for each byte. Equal windows have
their gram at the same offset, so no pair is lost. An anchor serves the offsets ``lo..hi`` of its
gram in those windows. Later digits are the bytes around the gram that all windows of an interval
of offsets share; the intervals shrink from pass to pass to one offset, the full window.

* Documents under the length have no window. Null texts are empty. Repeated rows are documents of
  their own and repeat each other's windows; rows with a null key are kept.
* Long texts are read in blocks that overlap by a window. Extra columns are left out.
* Hot passages: counts are combined on the map side, and the joins back are plain equi-joins,
  whose skewed partitions Spark splits. No group is gathered but the runs of one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, settle
from .common import whole_texts
from .shingles import U, mix

LENGTH = 200
#: Bytes of the first digit.
GRAM = 48
#: Widths of the offset intervals of the later passes.
WIDTHS = (38, 1)
#: Bytes read at once; positions inside a block take BITS bits.
BITS = 18
BLOCK = 1 << BITS

DOCUMENT = ["t1", "t2"]


class Digits:
    """Digests of any run of bytes of a block, from one running sum of weighted bytes."""

    def __init__(self, size: int):
        seeds = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
        self.byte = seeds
        base, inverse = U(0xD1342543DE82EF95), U(pow(0xD1342543DE82EF95, -1, 1 << 64))
        self.up = np.cumprod(np.concatenate([[U(1)], np.full(size, base, U)]), dtype=U)
        self.down = np.cumprod(np.concatenate([[U(1)], np.full(size, inverse, U)]), dtype=U)

    def sums(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block) + 1, U)
        np.cumsum(self.byte[block] * self.up[: len(block)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digest of block[start:end]; it also tells runs of other lengths apart."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U) * U(0x9FB21C651E98DF25))

    def grams(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Digest of each run of one width."""
        return mix((sums[width:] - sums[:-width]) * self.down[: len(sums) - width])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have = 1
    low = values
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors_of(digits: Digits, block: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Runs of suffixes of texts that lie end to end in a block.

    Gives the number of the text, the place of the gram in the block, lo, hi, and the digests of
    the gram and of all bytes that the run's windows cover.
    """
    sums = digits.sums(block)
    grams = digits.grams(sums, GRAM)
    place = (U(1) << U(BITS + 1)) - U(1)
    low = lowest((grams & ~place) | np.arange(len(grams), dtype=U), length - GRAM + 1)
    counts = np.maximum(ends - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    anchor = (low[window] & place).astype(np.int64)
    new = np.empty(len(owner), bool)
    new[:1] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    a = anchor[first]
    lo, hi = a - window[last], a - window[first]
    span = digits.runs(sums, window[first], window[last] + length)
    return owner[first], a, lo, hi, grams[a], mix(span ^ (lo * 1024 + hi).astype(U))


def _blocks(column: pa.Array, length: int):
    """(bytes, texts, places in them, starts, ends): short texts end to end, long ones in overlapping pieces."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    held, size = [], 0

    def packed():
        parts = [data[b:e] for _, _, b, e in held]
        ends = np.cumsum([len(p) for p in parts])
        return (
            np.concatenate(parts), np.array([t for t, *_ in held]), np.array([p for _, p, *_ in held]),
            ends - [len(p) for p in parts], ends,
        )

    for text in range(len(column)):
        begin, end = int(offsets[text]), int(offsets[text + 1])
        for at in range(begin, max(end - length + 1, begin), BLOCK - length):
            stop = min(at + BLOCK - 1, end)  # windows that start before at + BLOCK - length end by here
            if size + stop - at > BLOCK and held:
                yield packed()
                held, size = [], 0
            held.append((text, at - begin, at, stop))
            size += stop - at
    if held:
        yield packed()


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, loc, gram, span): one row for each run of suffixes; loc holds place, lo and hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = Digits(BLOCK)
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in range(2))
            for block, texts, places, starts, ends in _blocks(batch.column(2), length):
                owner, a, lo, hi, gram, span = anchors_of(digits, block, starts, ends, length)
                loc = ((a - starts[owner] + places[owner]) << 16) | (lo << 8) | hi
                own = texts[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (t1[own], t2[own], loc, gram.view(np.int64), span.view(np.int64))],
                    names=["t1", "t2", "loc", "gram", "span"],
                )

    long_enough = docs.where(F.octet_length("text") >= length).select("t1", "t2", "text")
    return long_enough.mapInArrow(run, "t1 long, t2 long, loc long, gram long, span long")


def _contexts(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of chosen anchors cover, from the texts themselves."""
    lists = chosen.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("loc", "gram", "done")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"t1": [], "t2": [], "loc": [], "gram": [], "done": [], "bytes": []}
            for t1, t2, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = text.encode("utf-8")
                for p in places:
                    at, lo, hi = p["loc"] >> 16, p["loc"] >> 8 & 255, p["loc"] & 255
                    for k, v in zip(rows, (t1, t2, p["loc"], p["gram"], p["done"], whole[at - hi : at - lo + length]), strict=True):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=kind)

    kind = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("loc", pa.int64()), ("gram", pa.int64()), ("done", pa.bool_()), ("bytes", pa.binary())])
    return docs.join(lists, DOCUMENT).select(*DOCUMENT, "text", "places").mapInArrow(
        run, "t1 long, t2 long, loc long, gram long, done boolean, bytes binary"
    )


def _narrowed(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Each row cut into its intervals of offsets: digests of the bytes their windows share and of all they cover."""
    top = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = Digits(BLOCK)
        for batch in batches:
            step = BLOCK // (2 * length)
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                pieces = part.column(5).to_pylist()
                joined = b"".join(pieces)
                block = np.frombuffer(joined, np.uint8)
                sums = digits.sums(block)
                loc = part.column(2).to_numpy()
                at, lo, hi = loc >> 16, loc >> 8 & 255, loc & 255
                zero = np.cumsum([0, *map(len, pieces)])[:-1] + hi  # place of the gram in the block
                n = hi // width - lo // width + 1
                row = np.repeat(np.arange(len(loc)), n)
                step_of = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (lo // width)[row]
                wide_lo, wide_hi = step_of * width, np.minimum(step_of * width + width - 1, top)
                own_lo, own_hi = np.maximum(wide_lo, lo[row]), np.minimum(wide_hi, hi[row])
                z = zero[row]
                # bytes that every window of the interval holds, as far as this anchor's own windows tell
                shared = digits.runs(sums, z - wide_lo, z - wide_hi + length)
                full = digits.runs(sums, z - own_hi, z - own_lo + length)
                begin_at, end_at = z - own_hi, z - own_lo + length
                cut = [joined[b:e] for b, e in zip(begin_at.tolist(), end_at.tolist(), strict=True)] if width > 1 else [b""] * len(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.column(0).to_numpy()[row]), pa.array(part.column(1).to_numpy()[row]),
                        pa.array((at[row] << 16) | (own_lo << 8) | own_hi), part.column(3).take(pa.array(row)),
                        part.column(4).take(pa.array(row)), pa.array(cut, pa.binary()),
                        pa.array(mix(shared + step_of.astype(U)).view(np.int64)),
                        pa.array(mix(full ^ (own_lo * 1024 + own_hi).astype(U)).view(np.int64)),
                    ],
                    names=["t1", "t2", "loc", "gram", "done", "bytes", "shared", "full"],
                )

    return rows.mapInArrow(
        run, "t1 long, t2 long, loc long, gram long, done boolean, bytes binary, shared long, full long"
    )


def _marks(rows: DataFrame, length: int) -> DataFrame:
    """Bytes covered by the windows of a row."""
    at, lo, hi = F.shiftright("loc", 16), F.shiftright("loc", 8).bitwiseAND(255), F.col("loc").bitwiseAND(255)
    return rows.select(*DOCUMENT, (at - hi).alias("begin"), (at - lo + length).alias("end"))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, whole text, and 128 bits that stand for both."""
    return whole_texts(docs, key, text).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"),
    ).select("*", F.xxhash64("key", "text").alias("t1"), F.xxhash64(F.lit(29), "text", "key").alias("t2"))


def _repeated(docs: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """(t1, t2, begin, end) of covered bytes, and working tables to delete once they are read."""
    found = _anchors(docs, length)
    # settled groups make the joins back plain ones, whose skewed side Spark can split
    grams = settle(
        found.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high"))
        .where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")),
        "repeats-grams",
    )
    hits = settle(found.join(grams, "gram"), "repeats-anchors")
    mixed = hits.where("mixed")
    spans = settle(
        mixed.groupBy("gram", "span")
        .agg((F.count("*") > 1).alias("done"), F.min(F.struct("t1", "t2", "loc")).alias("one")),
        "repeats-spans",
    )
    marks = _marks(hits.where("NOT mixed"), length).unionByName(
        _marks(mixed.join(spans.where("done").select("gram", "span"), ["gram", "span"]), length)
    )
    rows = settle(_contexts(docs, spans.select("one.*", "gram", "done"), length), "repeats-contexts")
    tables = [grams, hits, spans, rows]
    for width in WIDTHS:
        cut = _narrowed(rows, width, length)
        groups = settle(
            cut.groupBy("gram", "shared").agg(
                F.sum(F.when(F.col("done"), 2).otherwise(1)).alias("n"), F.min("full").alias("low"),
                F.max("full").alias("high"), F.max(~F.col("done")).alias("open"),
            ).where("n > 1 AND open").select("gram", "shared", (F.col("low") != F.col("high")).alias("mixed")),
            "repeats-groups",
        )
        rows = settle(cut.join(groups, ["gram", "shared"]).drop("shared", "full"), "repeats-narrowed")
        tables += [groups, rows]
        marks = marks.unionByName(_marks(rows.where("NOT mixed AND NOT done"), length))
        rows = rows.where("mixed").select(*DOCUMENT, "loc", "gram", "done", "bytes")
    return marks, tables


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, spans, kept): each text without the bytes of repeated windows.

    A byte goes when some ``length``-byte string that covers it also starts anywhere else, in the same
    document or another. ``spans`` are the maximal removed runs as [begin, end) byte places; ``kept`` is
    binary, since a run may end inside a character. ``length`` is between 97 and 255.
    """
    if not 2 * GRAM < length <= 255:
        raise ValueError(f"length must be between {2 * GRAM + 1} and 255")
    named = _identified(docs, key, text)
    marks, tables = _repeated(named, length)
    runs = settle(
        marks.distinct().groupBy(*DOCUMENT).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs")),
        "repeats-runs",
    )
    for table in tables:
        release(table)
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text_, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole = text_.encode("utf-8")
                merged: list[list[int]] = []
                for r in own or ():
                    if merged and r["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["end"])
                    else:
                        merged.append([r["begin"], r["end"]])
                edges = [0, *(x for m in merged for x in m), len(whole)]
                kept.append(b"".join(whole[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(len(whole) - len(kept[-1]))
                spans.append([{"begin": b, "end": e} for b, e in merged])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([r + len(k) for r, k in zip(removed, kept, strict=True)], pa.int64()),
                    pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                    pa.array(spans, spans_type), pa.array(kept, pa.binary()),
                ],
                names=[key, "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    kind = named.schema["key"].dataType.simpleString()
    return named.join(runs, DOCUMENT, "left").select("key", "text", "runs").mapInArrow(
        run,
        f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<begin: long, end: long>>, kept binary",
    )
