"""Trie of shared conversation prefixes in balanced parentheses.

Conversations are ranges of a sorted order of their turn digests, so that every subtree is a
contiguous run of it. Each range, a *shard*, writes its part of the trie as balanced parentheses in
depth-first order. Range min-max blocks over the excess answer ``findclose``, which delimits a
subtree; rank counts its leaf pairs, and cumulative arrays over the nodes give members and savings.
Only nodes on a shard's first or last path can also lie in another shard. Such *spines* are sent on
as sums without their shared nodes, merged by key, and finished once all parts are known.

* Null roles and texts are empty; rows with a null conversation are left out, since they name none.
* Turns are in order of ``turn``, nulls first; equal turns by role, then by the turn's digest.
  Repeated rows are turns of their own. No conversations: no nodes, not even a root.
* A conversation is one row of 16 bytes a turn, whatever the length of its texts. Many equal
  conversations spread over shards, and the ids that end in a shared node are hashed as a stream.
* Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Bytes of a turn's digest.
WIDE = 16
#: Positions of a range min-max block.
BLOCK = 256
#: Conversations that share a base, and the number of remainders that say how many turns they take from it.
FAMILY, HEADS = 5, 9

PIECES = (
    "spine boolean, key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, size long, first_id long, ends string"
)
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
EMPTY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with range min-max blocks over its excess."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        self.rank = np.cumsum(bits, dtype=np.int64)
        pair = bits.astype(bool)
        pair[:-1] &= bits[1:] == 0
        self.leaf_rank = np.cumsum(pair, dtype=np.int64)
        self.opens = np.flatnonzero(bits)
        low = np.minimum.reduceat(self.excess, np.arange(0, len(bits), BLOCK))
        self.levels = [low]
        while len(low) > 1:
            low = np.minimum.reduceat(low, np.arange(0, len(low), 2))
            self.levels.append(low)

    def findclose(self, at: int) -> int:
        """Position of the parenthesis that closes the one at ``at``."""
        want = self.excess[at] - 1
        block = at // BLOCK
        near = self.excess[at + 1 : (block + 1) * BLOCK] <= want
        if near.any():
            return at + 1 + int(near.argmax())
        level, i = 0, block + 1
        while self.levels[level][i] > want:
            i += 1
            while i % 2 == 0 and level + 1 < len(self.levels):
                level, i = level + 1, i // 2
        while level:
            level, i = level - 1, 2 * i
            if self.levels[level][i] > want:
                i += 1
        return i * BLOCK + int((self.excess[i * BLOCK : (i + 1) * BLOCK] <= want).argmax())


class Shard:
    """Trie of paths in ascending order, ids ascending among equal paths."""

    def __init__(self, paths: list[bytes], ids: list[int], sizes: list[list[int]]):
        bits = bytearray(b"\1")
        depth, size, parent, ends = [0], [0], [-1], [[]]
        stack = [0]
        before = b""
        for path, conv, own in zip(paths, ids, sizes, strict=True):
            same = len(before) // WIDE if path.startswith(before) else 0
            if not same and before:
                most = min(len(before), len(path)) // WIDE
                while same < most and before[same * WIDE : same * WIDE + WIDE] == path[same * WIDE : same * WIDE + WIDE]:
                    same += 1
            bits += b"\0" * (len(stack) - 1 - same)
            del stack[same + 1 :]
            for d in range(same, len(path) // WIDE):
                parent.append(stack[-1])
                stack.append(len(depth))
                depth.append(d + 1)
                size.append(own[d])
                ends.append([])
                bits.append(1)
            ends[stack[-1]].append(conv)
            before = path
        last_path = list(stack)
        bits += b"\0" * len(stack)
        self.first, self.last = paths[0], paths[-1]
        self.depth, self.size, self.parent, self.ends = np.array(depth), np.array(size), np.array(parent), ends
        self.spine = np.zeros(len(depth), bool)
        self.spine[: len(paths[0]) // WIDE + 1] = True
        self.spine[last_path] = True
        self.last_path = last_path
        self._measure(np.frombuffer(bytes(bits), np.uint8))

    def _measure(self, bits: np.ndarray) -> None:
        tree = Parentheses(bits)
        opens = tree.opens
        closes = np.array([tree.findclose(int(p)) for p in opens])
        after = tree.rank[closes]  # subtree of node i: nodes i .. after[i] - 1 in depth-first order
        at = np.arange(len(opens))

        def within(own: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(own)])
            return total[after] - total[at]

        self.n_convs = within(np.array([len(e) for e in self.ends]))
        self.n_children = np.bincount(self.parent[1:], minlength=len(opens))
        own_saved = (self.n_convs - 1) * self.size
        self.saved = within(own_saved)
        before = np.concatenate([[0], tree.leaf_rank])
        self.n_leaves = tree.leaf_rank[closes] - before[opens]
        low = [min(e, default=None) for e in self.ends]
        for i in range(len(low) - 1, 0, -1):
            up = self.parent[i]
            if low[up] is None or low[i] < low[up]:
                low[up] = low[i]
        self.conv_id = low
        # what lies under a spine node but under no deeper one
        side = ~self.spine
        self.side_children = np.bincount(self.parent[1:][side[1:]], minlength=len(opens))
        leaves, saved = within((self.n_children == 0) & side), within(np.where(side, own_saved, 0))
        shared = np.flatnonzero(self.spine[1:]) + 1
        self.side_leaves, self.side_saved = leaves.copy(), saved.copy()
        np.subtract.at(self.side_leaves, self.parent[shared], leaves[shared])
        np.subtract.at(self.side_saved, self.parent[shared], saved[shared])

    def keys(self) -> dict[int, bytes]:
        """Key of each spine node, made from its path."""
        found: dict[int, bytes] = {}
        for path, nodes in ((self.first, range(len(self.first) // WIDE + 1)), (self.last, self.last_path)):
            key = b"root"
            for d, node in enumerate(nodes):
                if d:
                    key = hashlib.blake2b(key + path[(d - 1) * WIDE : d * WIDE], digest_size=WIDE).digest()
                found[node] = key
        return found

    def pieces(self) -> dict[str, list]:
        keys = self.keys()
        out: dict[str, list] = {part.split()[0]: [] for part in PIECES.split(", ")}
        for i in range(len(self.depth)):
            spine, up, ids = bool(self.spine[i]), int(self.parent[i]), self.ends[i]
            listed = ",".join(map(str, ids))
            row = {
                "spine": spine, "key": keys.get(i), "parent_key": keys.get(up), "conv_id": self.conv_id[i],
                "parent_conv_id": self.conv_id[up] if i else None, "depth": int(self.depth[i]),
                "n_convs": int(self.n_convs[i]), "size": int(self.size[i]),
                "n_children": int((self.side_children if spine else self.n_children)[i]),
                "n_leaves": int((self.side_leaves if spine else self.n_leaves)[i]),
                "saved_tokens": int((self.side_saved if spine else self.saved)[i]),
                "first_id": ids[0] if ids else None,
                "ends": listed if spine else hashlib.sha256(listed.encode()).hexdigest(),
            }
            for name, values in out.items():
                values.append(row[name])
        return out


def shared_heads(conversations: DataFrame) -> tuple[Column, Column]:
    """(base, taken): which conversation a conversation starts from, and how many turns it takes from it."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    return base, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")


def conversation_paths(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """(conv_id, path, sizes): turn digests end to end, and the UTF-8 bytes of each text.

    With ``rebuild`` a conversation's first turns are replaced by those of its base.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"),
            F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
            F.octet_length(text).cast("long").alias("size"),
        ).alias("one"),
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns")
    )
    if rebuild:
        base, taken = shared_heads(own)
        own = settle(own.select("conv_id", "turns", base.alias("base"), taken.alias("taken")), "own-turns")
        heads = own.where("conv_id = base").select("base", F.slice("turns", 1, HEADS - 1).alias("head"))
        none = F.slice("turns", 1, 0)
        own = own.join(heads, "base", "left").select("conv_id", F.concat(
            F.slice(F.coalesce("head", none), F.lit(1), F.col("taken")),
            F.slice("turns", F.col("taken") + 1, F.size("turns")),
        ).alias("turns"))
    return own.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )


def _shards(paths: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, sizes = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            own += batch.column(1).to_pylist()
            sizes += batch.column(2).to_pylist()
        if ids:
            yield pa.RecordBatch.from_pydict(Shard(own, ids, sizes).pieces(), schema=kind)

    types = {"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    kind = pa.schema([(n, types[t]) for n, t in (part.split() for part in PIECES.split(", "))])
    placed = settle(paths.select("conv_id", "path", "sizes"), "paths")
    return placed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(run, PIECES)


def _merged(pieces: DataFrame) -> DataFrame:
    """Spine nodes of all shards, finished. They are few: two paths for each shard."""
    sums = pieces.where("spine").groupBy("key", "parent_key", "depth", "size").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: -r["depth"])
        known = {r["key"]: r for r in rows}
        for r in rows:
            if r["depth"]:
                known[r["parent_key"]]["n_children"] += 1
        for r in rows:  # the deepest first, so that what lies below is complete
            r["n_leaves"] += not r["n_children"]
            r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
            if r["depth"]:
                up = known[r["parent_key"]]
                up["n_leaves"] += r["n_leaves"]
                up["saved_tokens"] += r["saved_tokens"]
        for r in rows:
            r["parent_conv_id"] = known[r["parent_key"]]["conv_id"] if r["depth"] else None
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in kind.names} for r in rows], schema=kind)

    names = ("conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    kind = pa.schema([("key", pa.binary()), *((n, pa.int64()) for n in names)])
    return sums.repartition(1).mapInArrow(run, ", ".join(["key binary", *(f"{n} long" for n in names)]))


def _ends(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256): ids that end in a spine node, shard after shard, hashed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(ids.encode())
            yield made(done)
        if key is not None:
            yield made([(key, digest.hexdigest())])

    def made(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"]
        )

    chunks = pieces.where("spine AND first_id IS NOT NULL").select("key", "first_id", "ends")
    return chunks.repartition("key").sortWithinPartitions("key", "first_id").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row for each node: a distinct sequence of first turns, from the root without any.

    conv_id is the smallest member, parent_conv_id the parent's (null at the root), n_convs the
    members, n_children the children, n_leaves the childless nodes of the subtree, saved_tokens the
    sum over the subtree of (n_convs - 1) x bytes of the node's last text, and ends_sha256 the hash
    of the ids that end in the node, ascending, joined by commas.
    """
    pieces = settle(_shards(conversation_paths(conversations, rebuild)), "trie-pieces")
    spines = settle(
        _merged(pieces).join(_ends(pieces), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))),
        "trie-spines",
    )
    inner = pieces.where("NOT spine").withColumnRenamed("ends", "ends_sha256")
    above = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    hung = inner.where("parent_key IS NOT NULL").join(above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    return (
        spines.select(*NODES)
        .unionByName(hung.select(*NODES))
        .unionByName(inner.where("parent_key IS NULL").select(*NODES))
    )
