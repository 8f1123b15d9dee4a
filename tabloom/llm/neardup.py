"""Near-duplicate documents by a forest of sorted MinHash signatures.

Texts with equal shingle sets are one node from the start, however many there are. Each
tree of the forest sorts the nodes by its own order of the signature; neighbours in an
order share the longest prefixes. A pair is a candidate from the depth on at which its
region of the order has become small, so sparse regions are searched at shallow depth
and crowded ones only deeper. In regions that stay crowded (large groups of near copies)
each row is compared with the next one and with the region's centre, the row on the path
of the largest subregions. Orders are range-partitioned by the whole prefix and the node, so a group
of any size spreads over partitions; rows at partition edges are matched in a second,
small step. Candidates are confirmed on full sets.

What these links leave apart in a region of a tree's own positions is then compared pair
by pair: a region of several components is cut into tiles of two blocks of rows, a task
holds one tile, confirms on full sets and returns only the links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.lookup import lookup
from ..sources.shared import release, settle
from .common import whole_texts
from .shingles import Signature, overlap, same_share, shingle_set

TREES = 20
#: Signature positions that a tree starts with of its own; it goes on with those of the next trees.
OWN = 3
SIGNATURE = TREES * OWN
DEPTH = 8
#: Depth below which no pair is a candidate.
SHALLOWEST = 2
#: Rows of a region from which on it is searched one level deeper.
CROWDED = 24
#: Following rows of an order that a row is compared with.
NEIGHBOURS = 4
#: Rows of a region of own positions that the orders all compare with each other; larger ones are cut into tiles.
COMPARED = NEIGHBOURS + 1
#: Rows of a block of a tile while a region has few blocks, and those of a larger region.
BLOCK, LARGE_BLOCK = 512, 4096
#: Blocks of BLOCK rows that a region has at most.
BLOCKS = 6
#: Shingles of a block on average.
BLOCK_SHINGLES = 2_000_000
#: Rows of an order held in memory at once.
SLICE = 400_000
#: Agreeing positions of a true pair lie below this share of what its similarity promises about once in a million.
SURE = 0.68


def sketch(texts: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, node, signature); node is a 128-bit digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        signature = Signature(SIGNATURE)
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for t in batch.column(1).to_pylist():
                items = shingle_set(t, width)
                sizes.append(len(items))
                nodes.append(xxh3_128_digest(items.tobytes()) if len(items) else None)
                signatures.append(signature.of(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(signatures, pa.binary())],
                names=[key, "n_shingles", "node", "signature"],
            )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_shingles long, node binary, signature binary"
    )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per tree and node with the tree's prefix."""
    columns = (np.arange(TREES)[:, None] * OWN + np.arange(DEPTH)) % SIGNATURE
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, SIGNATURE)
        prefixes = np.ascontiguousarray(signature[:, columns]).tobytes()  # n x trees x depth
        width = 2 * DEPTH
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                pa.array([prefixes[i : i + width] for i in range(0, len(prefixes), width)], pa.binary()),
                batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES))),
            ],
            names=["tree", "prefix", "node"],
        )


def common_depth(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Leading positions in which rows of two prefix matrices agree."""
    return np.cumprod(left == right, axis=1).sum(axis=1)


def slice_pairs(tree: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the candidate pairs in one sorted run of rows (see the module's text)."""
    n = len(tree)
    lcp = common_depth(prefix[1:], prefix[:-1])
    lcp[tree[1:] != tree[:-1]] = 0
    sizes = np.ones((DEPTH + 2, n), np.int64)
    regions = np.zeros((DEPTH + 1, n), np.int64)
    for d in range(1, DEPTH + 1):
        regions[d, 1:] = np.cumsum(lcp < d)
        sizes[d] = np.bincount(regions[d])[regions[d]]
    small = sizes[SHALLOWEST : DEPTH + 1] <= CROWDED
    enough = np.where(small.any(axis=0), SHALLOWEST + small.argmax(axis=0), DEPTH)
    crowded = sizes[: DEPTH + 1] > CROWDED
    deepest = np.where(crowded.any(axis=0), DEPTH - crowded[::-1].argmax(axis=0), 0)  # the deepest crowded region
    left, right = [], []
    shared = lcp
    for k in range(1, min(NEIGHBOURS, n - 1) + 1):
        shared = lcp[: n - k] if k == 1 else np.minimum(shared[: n - k], lcp[k - 1 :])
        at = np.flatnonzero(shared >= np.minimum(enough[: n - k], enough[k:]))
        if k > 1:  # a crowded region of own positions is cut into tiles later
            at = at[(deepest[at] < OWN) | (shared[at] < OWN)]
        left.append(at)
        right.append(at + k)
    # centres of crowded regions, if they are more than a shallow coincidence
    for d in range(OWN, DEPTH + 1):
        rows = np.flatnonzero(deepest >= d)
        if not len(rows):
            break
        order = np.lexsort((*(-sizes[e, rows] for e in range(DEPTH, d, -1)), regions[d, rows]))
        region = regions[d, rows[order]]
        first = np.r_[True, region[1:] != region[:-1]]
        centre = rows[order][first][np.cumsum(first) - 1]
        at = deepest[rows[order]] == d
        left.append(rows[order][at])
        right.append(centre[at])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a != b], b[a != b]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a sorted partition, and its first and last rows (b null)."""

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        n = rows.num_rows
        tree = rows.column("tree").to_numpy()
        raw = rows.column("prefix").to_pylist()
        prefix = np.frombuffer(b"".join(raw), ">u2").reshape(n, DEPTH)
        node = rows.column("node")
        a, b = slice_pairs(tree, prefix)
        edge = np.unique(np.r_[np.arange(min(n, NEIGHBOURS)), np.arange(max(0, n - NEIGHBOURS), n)])
        nodes = node.take(pa.array(np.r_[a, edge])).combine_chunks()
        others = pa.concat_arrays([
            pa.array(node.take(pa.array(b)).to_pylist(), pa.binary()), pa.nulls(len(edge), pa.binary()),
        ])
        trees = pa.array(np.r_[np.full(len(a), -1), tree[edge]].astype(np.int32))
        prefixes = pa.array([None] * len(a) + [raw[i] for i in edge], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes.to_pylist(), pa.binary()), others, trees, prefixes], names=["a", "b", "tree", "prefix"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= SLICE:
            yield found(held)
            held, size = [], 0
    if held:
        yield found(held)


def _across_edges(edges: DataFrame) -> DataFrame:
    """Pairs of near rows on both sides of partition edges."""
    order = Window.partitionBy("tree").orderBy("prefix", "a")
    ahead = range(1, NEIGHBOURS + 1)
    near = edges.select(
        "a", "prefix", *[F.struct(*[F.lead(c, k).over(order).alias(c) for c in ("a", "prefix")]).alias(f"n{k}") for k in ahead]
    ).select("a", "prefix", F.explode(F.array(*[f"n{k}" for k in ahead])).alias("next"))
    shared = F.substring("prefix", 1, 2 * OWN) == F.substring("next.prefix", 1, 2 * OWN)
    return near.where(F.col("next.a").isNotNull() & shared).select("a", F.col("next.a").alias("b"))


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a below b, from a table of (node, signature)."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = nodes.select("node", "signature").mapInArrow(_orders, "tree int, prefix binary, node binary")
    spread = orders.repartitionByRange(parts, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    found = settle(spread.mapInArrow(_search, "a binary, b binary, tree int, prefix binary"), "orders")
    pairs = found.where("b IS NOT NULL").select("a", "b").unionByName(_across_edges(found.where("b IS NULL")))
    return (
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a") != F.col("b")).distinct()
    )


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per tree and node with the number of the region of the tree's own positions."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        own = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, TREES, OWN).astype(np.int64)
        region = np.tile(np.arange(TREES, dtype=np.int64), (n, 1))
        for j in range(OWN):
            region = region << 16 | own[:, :, j]
        each = pa.array(np.repeat(np.arange(n), TREES))
        yield pa.RecordBatch.from_arrays(
            [pa.array(region.ravel()), *(batch.column(c).take(each) for c in (0, 2))], names=["region", "node", "n_shingles"],
        )


def gathered(nodes: DataFrame) -> DataFrame:
    """(region, node, n_shingles) of the rows in regions of more than COMPARED rows."""
    each = nodes.select("node", "signature", "n_shingles").mapInArrow(_regions, "region long, node binary, n_shingles long")
    large = settle(each.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > COMPARED), "regions")
    return lookup(each, large, "region", "size").where("size IS NOT NULL").select("region", "node", "n_shingles")


def _tiles(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(region, node, root, block, blocks) of the rows in regions with more than one component."""
    placed = settle(members.join(roots, "node"), "placed")
    few = F.least(F.ceil(F.col("size") / BLOCK), F.lit(BLOCKS))
    mixed = settle(
        placed.groupBy("region").agg(
            F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high"),
        ).where("low != high").select(
            "region", "size",
            F.greatest(few, F.ceil(F.col("size") / LARGE_BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        ), "mixed",
    )
    here = lookup(placed, mixed, "region", "size").where("blocks IS NOT NULL")
    return here.select(
        "region", "node", "root", F.pmod(F.xxhash64("node", "region"), F.col("blocks")).cast("int").alias("block"), "blocks"
    )


def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positions in which each row of one matrix of signatures agrees with each of another."""
    out = np.zeros((len(left), len(right)), np.uint8)
    for p in range(left.shape[1]):
        out += left[:, p][:, None] == right[:, p]
    return out


def tile_links(tile: pa.Table, percent: int) -> tuple[list[bytes], list[bytes]]:
    """Roots of components that a confirmed link between two rows of a tile joins.

    Pairs that meet in the region of an earlier tree are left to it.
    """
    tree, one, other = (tile.column(c)[0].as_py() for c in ("tree", "one", "other"))
    tile = tile.sort_by("node")
    n = tile.num_rows
    block = tile.column("block").to_numpy()
    signature = np.frombuffer(b"".join(tile.column("signature").to_pylist()), ">u2").reshape(n, SIGNATURE).astype(np.uint16)
    own = signature.reshape(n, TREES, OWN).astype(np.int64) @ np.array([1 << 32, 1 << 16, 1])
    sizes = tile.column("n_shingles").to_numpy()
    names = tile.column("root").to_pylist()
    number = {name: i for i, name in enumerate(dict.fromkeys(names))}
    root = np.array([number[name] for name in names])
    parent = list(range(len(number)))
    items = tile.column("items")
    least = int(SIGNATURE * SURE * percent / 100)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first, second = np.flatnonzero(block == one), np.flatnonzero(block == other)
    joined: tuple[list[bytes], list[bytes]] = ([], [])
    for start in range(0, len(first), 256):
        rows = first[start : start + 256]
        same = alike(signature[rows], signature[second])
        near = (same >= least) & (root[rows][:, None] != root[second])
        if one == other:
            near &= rows[:, None] < second
        near &= 100 * np.minimum(sizes[rows][:, None], sizes[second]) >= percent * np.maximum(sizes[rows][:, None], sizes[second])
        i, j = np.nonzero(near)
        for t in range(tree):
            new = own[rows[i], t] != own[second[j], t]
            i, j = i[new], j[new]
        for at in np.argsort(-same[i, j].astype(np.int16), kind="stable").tolist():
            x, y = rows[i[at]], second[j[at]]
            a, b = top(root[x]), top(root[y])
            if a == b:
                continue
            both, either = overlap(*(np.frombuffer(items[int(k)].as_py(), np.uint64) for k in (x, y)))
            if 100 * both >= percent * either:
                parent[a] = b
                joined[0].append(names[x])
                joined[1].append(names[y])
    return joined


def _between(tiles: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of roots that links between rows of one region join; ``held`` has each node's signature and set."""
    each = tiles.join(held, "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select(
        "region", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "block",
        F.shiftright("region", 16 * OWN).cast("int").alias("tree"), "node", "root", "n_shingles", "signature", "items",
    )

    def run(tile: pa.Table) -> pa.Table:
        a, b = tile_links(tile, percent)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return each.groupBy("region", "one", "other").applyInArrow(run, "a binary, b binary")


def _joined(roots: DataFrame, between: DataFrame) -> DataFrame:
    """(node, root) of every node after pairs (a, b) of roots are joined."""
    over = connected_components(between.select(F.hex("a").alias("a"), F.hex("b").alias("b")), "a", "b").select(
        F.unhex("node").alias("root"), F.unhex("root").alias("top")
    )
    return settle(roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _with_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs with the columns of both nodes, named with 1 and 2."""
    out = pairs
    for number, end in ((1, "a"), (2, "b")):
        named = table.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}{number}") for c in columns])
        out = out.join(named, end)
    return out


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures do not speak against it."""
    sized = _with_both(pairs, nodes, ["n_shingles", "signature"]).where(
        100 * F.least("n_shingles1", "n_shingles2") >= percent * F.greatest("n_shingles1", "n_shingles2")
    )
    least = int(SIGNATURE * SURE * percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = pa.array([same_share(x, y) >= least for x, y in two], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return sized.select("a", "b", "signature1", "signature2").mapInArrow(run, "a binary, b binary")


def _sets(texts: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(node, items) of the wanted nodes, computed anew from the texts of their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            nodes, items = [], []
            for t, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingle_set(t, width).tobytes()
                if xxh3_128_digest(found) == node:  # a repeated key may have another text
                    nodes.append(node)
                    items.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(items, pa.binary())], names=["node", "items"]
            )

    return texts.join(wanted, key).select(text, "node").mapInArrow(run, "node binary, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both, either = overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                keep.append(100 * both >= percent * either)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = _with_both(pairs, sets, ["items"])
    return full.select("a", "b", "items1", "items2").mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Documents are linked when their sets of ``width``-word shingles have at least
    ``percent`` per cent of their union in common. ``component_id`` is the smallest key
    reachable by links, the row's own included, and ``kept`` marks that row.

    A text with fewer words is one shingle; a null or empty text or one of blanks has
    an empty set, is linked with nothing and kept. A row with a null key is never
    linked, has no component and is kept. Repeated rows with one key are each kept or
    each dropped: keep one of them with ``dropDuplicates`` if they are not wanted.
    Other columns are ignored; an empty table gives an empty result.
    """
    texts = whole_texts(df, key, text)
    docs = settle(sketch(texts, key, text, width), "sketch")
    known = docs.where(F.col("node").isNotNull() & F.col(key).isNotNull())
    nodes = settle(
        known.groupBy("node").agg(
            F.min(key).alias("first_key"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        ), "nodes",
    )
    pairs = settle(candidates(nodes), "pairs")

    def sets_of(wanted: DataFrame, label: str) -> DataFrame:
        named = wanted.join(nodes.select("node", F.col("first_key").alias(key)), "node")
        return settle(_sets(texts, named, key, text, width), label)

    likely = settle(_likely(pairs, nodes, percent), "likely")
    release(pairs)
    sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "sets")
    links = settle(_confirmed(likely, sets, percent), "links")
    release(sets)
    release(likely)
    linked = connected_components(links, "a", "b", small_edges=-1)
    roots = settle(
        nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots"
    )
    tiles = settle(_tiles(gathered(nodes), roots), "tiles")
    sets = sets_of(tiles.select("node").distinct(), "tile-sets")
    held = nodes.select("node", "n_shingles", "signature").join(sets, "node")
    between = settle(_between(tiles, held, percent).distinct(), "between")
    release(sets)
    release(tiles)
    if not between.isEmpty():
        roots = _joined(roots, between)
    labelled = nodes.select("node", "first_key").join(roots, "node", "left")
    lowest = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("first_key").alias("lowest"))
    of_node = labelled.join(lowest, "root", "left").select(
        "node", F.coalesce("lowest", "first_key").alias("component_id")
    )
    out = docs.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.col("node")).alias("node"))
    out = out.join(of_node, "node", "left").select(
        key, "n_shingles", F.coalesce("component_id", F.col(key)).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
