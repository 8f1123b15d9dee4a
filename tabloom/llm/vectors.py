"""Near-duplicate vectors by product quantisation.

Vectors are assigned to coarse lists; what remains of each is coded by its nearest
centroids in several subspaces. A vector searches the lists that a near vector can
plausibly lie in, by table-lookup distances to the codes. A code's distance to its
vector is stored, so within a searched list the lookup passes every true neighbour on
to the exact cosine, whatever the code's quality.

Equal vectors are one node from the start. A list and those that search it are cut into
tiles of bounded size, which return counts and one edge per linked node, not pairs.
The index is fitted on a bounded sample and holds every vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..sources.shared import release, settle

#: Vectors that the centroids are fitted on at most.
SAMPLE = 8_192
#: Coarse lists at most; beyond it lists grow, and their tiles with them.
LISTS = 1_024
SUBSPACES = 8
CODES = 256
ROUNDS = 8
#: How far, in standard deviations of a random step of the greatest linked length, a list may lie behind its border.
PROBE = 3.5
#: Members and visitors of a tile at most.
MEMBERS = 4_096
VISITORS = 8_192
#: Pairs of a tile compared exactly at once; a group of copies that fills a tile has millions of them.
PAIRS = 16_384


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def centroids_of(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Plain k-means from random rows; an empty cluster keeps its place."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        label = nearest(x, c)
        n = np.bincount(label, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Index:
    """Coarse centroids, codebooks (subspace, code, dimensions; padded with zeros) and the search radius."""

    coarse: np.ndarray
    books: np.ndarray
    radius: float

    @classmethod
    def fit(cls, unit: np.ndarray, lists: int, cosine: float) -> Index:
        dim = unit.shape[1]
        coarse = centroids_of(unit, max(1, min(lists, len(unit) // 8 or 1)), 1)
        width = -(-dim // SUBSPACES)
        rest = np.pad(unit - coarse[nearest(unit, coarse)], ((0, 0), (0, SUBSPACES * width - dim)))
        books = np.zeros((SUBSPACES, CODES, width))
        for s in range(SUBSPACES):
            found = centroids_of(rest[:, s * width : (s + 1) * width], CODES, 2 + s)
            books[s, : len(found)] = found
            books[s, len(found) :] = found[0]
        return cls(coarse, books, float(np.sqrt(max(0.0, 2 - 2 * cosine))))

    def _cut(self, x: np.ndarray) -> np.ndarray:
        """(row, subspace, dimension)."""
        width = self.books.shape[2]
        return np.pad(x, ((0, 0), (0, SUBSPACES * width - x.shape[1]))).reshape(len(x), SUBSPACES, width)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of what the list centroids leave, and their distance to the vectors."""
        rest = self._cut(unit - self.coarse[lists])
        codes = np.stack([nearest(rest[:, s], self.books[s]) for s in range(SUBSPACES)], axis=1).astype(np.uint8)
        back = self.books[np.arange(SUBSPACES), codes]
        return codes, np.sqrt(((rest - back) ** 2).sum(axis=(1, 2)))

    def behind(self, unit: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far each vector is from the border between its own list and the other one."""
        a, b = self.coarse[own], self.coarse[other]
        gap = np.sqrt(((a - b) ** 2).sum(axis=1))
        return (((unit - b) ** 2).sum(axis=1) - ((unit - a) ** 2).sum(axis=1)) / np.maximum(2 * gap, 1e-12)

    def gaps(self) -> np.ndarray:
        """Distance of every list centroid to every other."""
        return np.stack([np.sqrt(((self.coarse - c) ** 2).sum(axis=1)) for c in self.coarse])

    def reach(self) -> float:
        """A linked vector is at most ``radius`` away, in a direction of which the border sees a share."""
        return min(self.radius, PROBE * self.radius / np.sqrt(self.coarse.shape[1])) + 1e-9

    def probes(self, unit: np.ndarray, own: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that each vector searches, its own included; ``gaps`` are those of the lists."""
        d = (self.coarse**2).sum(axis=1) - 2 * unit @ self.coarse.T
        behind = (d - d[np.arange(len(unit)), own][:, None]) / np.maximum(2 * gaps[own], 1e-12)
        behind[np.arange(len(unit)), own] = 0
        return np.nonzero(behind <= self.reach())

    def lookup(self, unit: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the coded members of a list."""
        rest = self._cut(unit - self.coarse[at])
        out = np.zeros((len(unit), len(codes)), np.float32)
        for s in range(SUBSPACES):
            table = ((rest[:, s, None] - self.books[s][None]) ** 2).sum(axis=2).astype(np.float32)
            out += table[:, codes[:, s]]
        return out


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, since squares of very small or large numbers leave the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _nodes(df: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(key, raw): the vector's bytes, null where it cannot be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column(1).to_pylist():
                x = None
                if v and None not in v:
                    x = np.array(v, kind)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                    else:
                        x = x + 0  # negative zeros are zeros
                raw.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[key, "raw"])

    return df.select(key, vector).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, raw binary")


def _indexed(nodes: DataFrame, index: Index, kind: str) -> DataFrame:
    """Every node with its list, codes and code error."""
    shared = nodes.sparkSession.sparkContext.broadcast((index.coarse, index.books, index.radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                unit = unit_rows(_matrix(part.column(1).to_pylist(), kind))
                own = nearest(unit, found.coarse)
                codes, error = found.encode(unit, own)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(error)],
                    names=["node", "raw", "n", "list", "codes", "error"],
                )

    return nodes.select("node", "raw", "n").mapInArrow(
        run, "node binary, raw binary, n long, list int, codes binary, error double"
    )


def _visits(members: DataFrame, index: Index, kind: str) -> DataFrame:
    """(node, raw, n, own, list): each node once for every list that it searches."""
    shared = members.sparkSession.sparkContext.broadcast((index.coarse, index.books, index.radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(*shared.value)
        gaps = found.gaps()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                own = part.column(3).to_numpy()
                rows, lists = found.probes(unit_rows(_matrix(part.column(1).to_pylist(), kind)), own, gaps)
                taken = part.select(["node", "raw", "n", "list"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(lists.astype(np.int32))], names=["node", "raw", "n", "own", "list"]
                )

    return members.select("node", "raw", "n", "list").mapInArrow(
        run, "node binary, raw binary, n long, own int, list int"
    )


def join(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lowest member of what each node is joined with, after links are added to a finished ``parent``."""
    while True:
        a, b = parent[left], parent[right]
        low = np.minimum(a, b)
        if (a == b).all():
            return parent
        new = parent.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        parent = new


def tile_links(index: Index, members: pd.DataFrame, visitors: pd.DataFrame, cosine: float, kind: str) -> pd.DataFrame:
    """Links in one tile: counts (b null), and edges that join what is linked."""
    empty = pd.DataFrame({"a": [], "b": [], "n": []})
    if not len(members) or not len(visitors):
        return empty
    at = int(members["list"].iloc[0])
    codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), SUBSPACES)
    x, q = unit_rows(_matrix(list(members["raw"]), kind)), unit_rows(_matrix(list(visitors["raw"]), kind))
    limit = ((index.radius + members["error"].to_numpy() + 1e-4) ** 2).astype(np.float32)
    ids, others = visitors["node"].to_numpy(), members["node"].to_numpy()
    q_rows, x_rows = visitors["n"].to_numpy(), members["n"].to_numpy()
    own = visitors["own"].to_numpy()
    counts, back = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
    # one edge for each linked node: to the first node of what it is joined with in this tile
    parent = np.arange(len(q) + len(x))
    for start in range(0, len(q), 512):
        rows, columns = np.nonzero(index.lookup(q[start : start + 512], at, codes) <= limit)
        # the links of a tile can be as many as its pairs, so they are used up piece by piece
        for cut in range(0, len(rows), PAIRS):
            left, right = start + rows[cut : cut + PAIRS], columns[cut : cut + PAIRS]
            linked = np.einsum("ij,ij->i", q[left], x[right]) >= cosine
            linked &= ids[left] != others[right]
            left, right = left[linked], right[linked]
            if not len(left):
                continue
            np.add.at(counts, left, x_rows[right])
            # a member that does not search its visitor's list learns of the link here
            away = own[left] != at
            l, r = left[away], right[away]
            alone = index.behind(x[r], np.full(len(r), at), own[l]) > index.reach()
            np.add.at(back, r[alone], q_rows[l[alone]])
            parent = join(parent, left, len(q) + right)
    if not counts.any():
        return empty
    nodes = np.concatenate([ids, others])
    joined = np.flatnonzero(parent != np.arange(len(parent)))
    return pd.DataFrame({
        "a": np.concatenate([ids[counts > 0], others[back > 0], nodes[joined]]),
        "b": np.concatenate([np.full((counts > 0).sum() + (back > 0).sum(), None, object), nodes[parent[joined]]]),
        "n": np.concatenate([counts[counts > 0], back[back > 0], np.zeros(len(joined), np.int64)]),
    })


def _of_one_length(rows: DataFrame, key: str, kind: str, cosine: float) -> DataFrame:
    """(node, n_links, component_id) of the distinct vectors of rows (key, raw, node) that all have one length."""
    spark = rows.sparkSession
    nodes = settle(
        rows.groupBy("node").agg(
            F.first("raw").alias("raw"), F.count("*").alias("n"), F.min(key).alias("first_key")
        ), "nodes",
    )
    total = nodes.count()
    sample = nodes.orderBy("node").limit(SAMPLE).select("raw").collect()  # digests are random already
    index = Index.fit(unit_rows(_matrix([r.raw for r in sample], kind)), min(LISTS, int(np.sqrt(total)) or 1), cosine)
    members = settle(_indexed(nodes, index, kind), "members")
    visits = settle(_visits(members, index, kind), "visits")

    # tiles: both sides of a list are dealt to blocks of bounded size by their digest; bounded by the number of lists
    counts: dict[int, list[int]] = {}
    for side, table in enumerate((members, visits)):
        for r in table.groupBy("list").count().collect():
            counts.setdefault(r["list"], [0, 0])[side] = r["count"]
    cuts = spark.createDataFrame(
        [(at, -(-m // MEMBERS) or 1, -(-v // VISITORS) or 1) for at, (m, v) in counts.items()],
        "list int, m_blocks int, v_blocks int",
    )
    dealt = F.xxhash64("node")
    own = members.join(F.broadcast(cuts), "list").withColumn("m", F.pmod(dealt, F.col("m_blocks")).cast("int"))
    own = own.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
    come = visits.join(F.broadcast(cuts), "list").withColumn("v", F.pmod(dealt, F.col("v_blocks")).cast("int"))
    come = come.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)))
    shared = spark.sparkContext.broadcast((index.coarse, index.books, index.radius))

    def links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return tile_links(Index(*shared.value), left, right, cosine, kind)

    tile = ("list", "m", "v")
    found = settle(
        own.select(*tile, "node", "raw", "n", "codes", "error").groupBy(*tile)
        .cogroup(come.select(*tile, "node", "raw", "n", "own").groupBy(*tile))
        .applyInPandas(links, "a binary, b binary, n long"), "links",
    )
    release(visits)
    linked = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"), "a", "b", small_edges=-1)
    labelled = (
        nodes.select("node", "first_key", "n").join(linked.withColumnRenamed("a", "node"), "node", "left")
        .join(roots, "node", "left")
    )
    lowest = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("first_key").alias("lowest"))
    return labelled.join(lowest, "root", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("lowest", "first_key").alias("component_id"),
    )


def near_vectors(df: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Two vectors are linked when their cosine, in double precision, is at least
    ``cosine``. ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest key reachable and ``kept`` marks it. A vector that is null, empty, all
    zeros, or holds a null or a number that is not finite is linked with nothing, and so
    is a row with a null key; each is its own component and kept. Vectors of different
    lengths are not linked; each length is searched by itself. Repeated rows are vectors of their own. Other columns
    are ignored; an empty table gives an empty result.
    """
    kind = "f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "f8"
    rows = settle(
        _nodes(df, key, vector, kind).withColumn("size", F.length("raw"))
        .withColumn("node", F.when(F.col(key).isNotNull(), F.unhex(F.sha2("raw", 256)))), "vectors",
    )
    known = rows.where("node IS NOT NULL")
    of_node = None
    for found in known.select("size").distinct().orderBy("size").collect():  # lengths, of which there are few
        part = _of_one_length(known.where(F.col("size") == found["size"]), key, kind, cosine)
        of_node = part if of_node is None else of_node.unionByName(part)
    if of_node is None:
        return rows.select(
            key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept")
        )
    out = rows.select(key, "node").join(of_node, "node", "left").select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col(key)).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
