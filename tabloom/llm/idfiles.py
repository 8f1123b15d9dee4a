"""Token ids in binary shards with a minimal perfect hash index.

Documents are dealt to shards by ranges of their key, so shards and the documents in
them are in ascending order. A shard is one file of raw little-endian ids (two bytes
each while the vocabulary allows) and one index file. The index maps a document's key to
a slot without holding keys in a tree or table: a key's slot is the rank of its bit in
the first of several bit fields in which it met no other key. The slot holds a
fingerprint of the key, which tells strangers, and the place of the ids, so a lookup
takes the same few steps whatever the number of documents.

Each task writes under a name of its own and reports it; the table of reports is the
store's manifest. A repeated task leaves a file that no manifest names.

Texts are encoded block by block: the words of a block are cut and numbered by array
operations, the library encodes each new word once, many in one run, and the ids of the
texts are laid out from those of their words, again by array operations.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle, shared_folder
from .common import vocabulary, whole_texts, worker_table
from .pretokens import LONGEST, PretokenTable, blocks, plainly_spaced
from .shingles import U, mix

#: Bits per key that is still without a slot, on each level.
ROOM = 2
#: Words whose ids a worker keeps; once full, others are encoded in each block they turn up in. So are longer ones.
WORDS = 1_000_000
#: Words that the library encodes in one run, and runs at a time.
RUN = 512
RUNS = 32
#: Characters of the texts that are laid out at once.
BLOCK = 1 << 23


class PerfectHash:
    """Distinct 64-bit hashes -> 0 .. n-1, in a little over three bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.bits = [np.unpackbits(level).astype(bool) for level in levels]
        ends = np.cumsum([0] + [int(b.sum()) for b in self.bits])
        self.ranks = [start + np.cumsum(b) - 1 for start, b in zip(ends, self.bits)]

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + U((level + 1) * 0x9E3779B9)) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("equal hashes have no slots of their own")
        levels = []
        while len(hashes):
            size = -(-max(64, ROOM * len(hashes)) // 8) * 8
            at = cls._place(hashes, len(levels), size)
            single = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(single))
            hashes = hashes[~single[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; of an unknown one any slot, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = self._place(hashes[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


def key_hashes(keys: list, times: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each key and of how often it came before in the shard."""
    from xxhash import xxh3_64_intdigest

    plain = np.fromiter((xxh3_64_intdigest(str(k), seed) for k in keys), U, len(keys))
    return mix(plain + times.astype(U) * U(0x9E3779B97F4A7C15 >> 1))


def occurrences(keys: list) -> np.ndarray:
    """How often each key came before; equal keys stand together."""
    n = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys)):
        if keys[i] == keys[i - 1]:
            n[i] = n[i - 1] + 1
    return n


@dataclass
class ShardIndex:
    keys: list
    seed: int
    hash: PerfectHash
    fingerprints: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def build(cls, keys: list, sizes: np.ndarray) -> ShardIndex:
        times = occurrences(keys)
        for seed in range(100):
            hashes = key_hashes(keys, times, seed)
            if len(np.unique(hashes)) == len(keys):
                break
        found = PerfectHash.build(hashes)
        slots = found.slots(hashes)
        out = [np.empty(len(keys), t) for t in (np.uint32, np.int64, np.int64)]
        starts = np.cumsum(sizes) - sizes
        for column, values in zip(out, ((mix(hashes) >> U(32)).astype(np.uint32), starts, sizes)):
            column[slots] = values
        return cls(keys, seed, found, *out)

    def find(self, keys: list, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of each key's given occurrence; -1 and 0 if it isn't here."""
        hashes = key_hashes(keys, times, self.seed)
        slots = self.hash.slots(hashes)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == (mix(hashes[known]) >> U(32)).astype(np.uint32)
        start, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        start[known], size[known] = self.starts[slots[known]], self.sizes[slots[known]]
        return start, size

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        batch = pa.RecordBatch.from_arrays([pa.array(self.keys)], names=["key"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        keys = sink.getvalue().to_pybytes()
        np.savez(
            out, keys=np.frombuffer(keys, np.uint8), seed=self.seed, fingerprints=self.fingerprints,
            starts=self.starts, sizes=self.sizes, **{f"level{i}": v for i, v in enumerate(self.hash.levels)},
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        held = np.load(io.BytesIO(data))
        keys = pa.ipc.open_stream(pa.py_buffer(held["keys"].tobytes())).read_all().column("key").to_pylist()
        levels = [held[f"level{i}"] for i in range(sum(n.startswith("level") for n in held.files))]
        return cls(keys, int(held["seed"]), PerfectHash(levels), held["fingerprints"], held["starts"], held["sizes"])


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def laid_out(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class IdTable:
    """Ids of whole texts. Word i of the table has ``sizes[i]`` ids from ``starts[i]`` on, as it stands behind a space.

    A space between two other characters always starts a piece, so a plainly spaced text
    is put together from its words; any other goes through the table of pieces.
    """

    def __init__(self, path: str):
        self.pieces = PretokenTable(path, lambda ids: np.array(ids, "<u4").tobytes(), b"".join)
        self.tokenizer = self.pieces.tokenizer
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(tokens.values()) + 1, np.int64)
        self.bytes[list(tokens.values())] = list(map(len, tokens))  # a character of a token stands for a byte
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, self.kind)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words behind a space, how many each has). Words are told apart in a run by the bytes of its tokens."""
        found, sizes = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for low in range(0, len(words), RUN * RUNS):
            part = words[low : low + RUN * RUNS]
            runs = [" " + " ".join(part[i : i + RUN]) for i in range(0, len(part), RUN)]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(lists), self.kind, sum(map(len, lists)))
            ends = np.cumsum(self.bytes[ids])
            places = np.cumsum(pc.binary_length(pa.array(part, pa.string())).to_numpy().astype(np.int64) + 1)
            last = np.searchsorted(ends, places)
            if len(ends) <= last[-1] or (ends[last] != places).any():
                raise ValueError("a token joins two words")
            found.append(ids)
            sizes.append(np.diff(last, prepend=-1))
        return np.concatenate(found), np.concatenate(sizes)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of each distinct word, and the ids, starts and sizes at these places)."""
        places = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = places < 0
        new = list(compress(words, missing.tolist()))
        ids, sizes = self.encode(new)
        starts = np.cumsum(sizes) - sizes
        places[missing] = len(self.sizes) + np.arange(len(new))
        out = places, np.append(self.ids, ids), np.append(self.starts, starts + len(self.ids)), np.append(self.sizes, sizes)
        keep = np.fromiter(map(len, new), np.int64, len(new)) <= LONGEST
        keep &= np.cumsum(keep) <= WORDS - len(self.index)
        if keep.any():
            at, held = np.cumsum(sizes[keep]) - sizes[keep], len(self.index)
            self.index.update(zip(compress(new, keep.tolist()), range(held, held + len(at))))
            self.starts = np.append(self.starts, at + len(self.ids))
            self.sizes = np.append(self.sizes, sizes[keep])
            self.ids = np.append(self.ids, laid_out(ids, starts[keep], sizes[keep]))
        return out

    def of_texts(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, each with ``end`` behind it; how many each has)."""
        heads: dict[str, int] = {}  # first words of plainly spaced texts
        odd: list[str] = []
        first, rests = np.empty(len(texts), np.int64), []
        for i, text in enumerate(texts):
            rest = None
            if plainly_spaced(text, self.pieces.wide) and not (self.pieces.cut and self.pieces.cut.search(text)):
                head, gap, rest = text.partition(" ")
                first[i] = heads.setdefault(head, len(heads))
            else:
                first[i] = -1 - len(odd)
                odd.append(text)
            rests.append(rest if rest else None)
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        met = lists.flatten().dictionary_encode()
        places, ids, starts, sizes = self.of_words(met.dictionary.to_numpy(zero_copy_only=False).tolist())
        alone = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(list(heads), add_special_tokens=False)]
        alone += [np.frombuffer(b, "<u4").astype(self.kind) for b in self.pieces.of_texts(odd)]
        alone.append(np.array([end], self.kind))
        of_alone = np.fromiter(map(len, alone), np.int64, len(alone))
        places_alone = len(sizes) + np.arange(len(alone))
        starts = np.append(starts, len(ids) + np.cumsum(of_alone) - of_alone)
        sizes, ids = np.append(sizes, of_alone), np.concatenate([ids, *alone])
        first = np.where(first < 0, len(heads) - 1 - first, first)
        stops = np.cumsum(counts + 2)
        begins = stops - counts - 2
        inside = np.ones(int(counts.sum()) + 2 * len(texts), bool)
        inside[begins] = inside[stops - 1] = False
        parts = np.full(len(inside), places_alone[-1])
        parts[begins] = places_alone[first]
        parts[inside] = places[met.indices.to_numpy()]
        own = sizes[parts]
        return laid_out(ids, starts[parts], own), np.add.reduceat(own, begins)


def ids_table(tokenizer: str) -> IdTable:
    """The worker's table of ids."""
    return worker_table(("ids", tokenizer), lambda: IdTable(vocabulary(tokenizer)))


@dataclass
class IdStore:
    """Manifest (shard, name, first_key, last_key, n_docs, n_ids, start) of the shards in a folder."""

    folder: str
    manifest: DataFrame
    kind: str
    key: str
    shards: int


def write_ids(
    df: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 2, key: str = "doc_id", text: str = "text",
    folder: str | None = None,
) -> IdStore:
    """Encode every whole text, append ``end`` and write the ids in ascending order of the keys.

    A null text is empty and gives the end id alone. Null keys come first; rows with one
    key are ordered by their text's hash. Other columns are ignored; an empty table
    gives a store without shards. ``folder`` is shared by all executors (a new one in
    ``spark.checkpoint.dir`` unless given).
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    system, root = _open(folder)
    system.create_dir(root)
    texts = whole_texts(df, key, text).withColumn("__order", F.xxhash64(text))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    spread = texts.repartitionByRange(parts, key, "__order").sortWithinPartitions(key, "__order")
    kind_of_key = texts.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ids_table(tokenizer)
        system, root = _open(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:07d}-{uuid.uuid4().hex}"
        keys: list = []
        sizes: list[np.ndarray] = []
        kept = None
        out = None
        for batch in batches:
            if batch.num_rows and out is None:
                out = system.open_output_stream(f"{root}/{name}.ids")
            kept = batch.schema.field(0).type
            keys += batch.column(0).to_pylist()
            for block in blocks(batch.column(1).to_pylist(), BLOCK):
                ids, size = table.of_texts(block, end)
                out.write(ids.tobytes())
                sizes.append(size)
        if out is not None:
            out.close()
            with system.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(ShardIndex.build(keys, np.concatenate(sizes)).to_bytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([keys[0]], kept),
                 pa.array([keys[-1]], kept), pa.array([len(keys)], pa.int64()), pa.array([sum(int(s.sum()) for s in sizes)], pa.int64())],
                names=["shard", "name", "first_key", "last_key", "n_docs", "n_ids"],
            )

    written = settle(
        spread.select(key, text).mapInArrow(
            write, f"shard int, name string, first_key {kind_of_key}, last_key {kind_of_key}, n_docs long, n_ids long"
        ), "manifest",
    )
    # one row per shard: where each begins is a running sum over them
    shards = sorted((r.shard, r.n_ids) for r in written.select("shard", "n_ids").toLocalIterator())
    starts = np.cumsum([0] + [n for _, n in shards]).tolist()
    begin = spark.createDataFrame([(s, at) for (s, _), at in zip(shards, starts)], "shard int, start long")
    kind = ids_table(tokenizer).kind
    return IdStore(folder, written.join(F.broadcast(begin), "shard"), kind, key, len(shards))


def _shard_reader(store: IdStore):
    """(index, ids) of a shard by its name, on a worker."""
    folder, kind = store.folder, store.kind

    def read(name: str) -> tuple[ShardIndex, np.ndarray]:
        system, root = _open(folder)
        with system.open_input_stream(f"{root}/{name}.idx") as f:
            index = ShardIndex.from_bytes(f.read())
        with system.open_input_stream(f"{root}/{name}.ids") as f:
            return index, np.frombuffer(f.read(), kind)

    return read


def read_ids(store: IdStore, digests: bool = False) -> DataFrame:
    """(key, start, n_tokens, and ids or ids_crc32) of every document, read back from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the unsigned
    crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    read = _shard_reader(store)
    key = store.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, typed in zip(*(batch.column(i).to_pylist() for i in (0, 1)), [batch.schema.field(2).type] * batch.num_rows):
                index, ids = read(name)
                at, size = index.find(index.keys, occurrences(index.keys))
                if (at < 0).any():
                    raise ValueError(f"{name}: a key of the index has no slot")
                for low in range(0, len(at), 2_000):
                    part = slice(low, low + 2_000)
                    slices = [ids[a : a + n].astype("<u4") for a, n in zip(at[part].tolist(), size[part].tolist())]
                    last = (
                        pa.array([crc32(s.tobytes()) for s in slices], pa.int64()) if digests
                        else pa.array(slices, pa.list_(pa.int64()))
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index.keys[part], typed), pa.array(at[part] + start), pa.array(size[part]), last],
                        names=[key, "start", "n_tokens", "ids_crc32" if digests else "ids"],
                    )

    kind = store.manifest.schema["first_key"].dataType.simpleString()
    last = "ids_crc32 long" if digests else "ids array<long>"
    # a stated number, else the few bytes of the manifest would bring all shards together in one task
    shards = store.manifest.select("name", "start", "first_key").repartition(max(1, store.shards), "name")
    return shards.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, {last}")


def fetch_ids(store: IdStore, keys: DataFrame) -> DataFrame:
    """(key, ids) of the documents with the given keys, one row for each of their occurrences; none for unknown keys."""
    read = _shard_reader(store)
    key = store.key
    shards = F.broadcast(store.manifest.select("name", "first_key", "last_key"))
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    placed = wanted.join(
        shards, (F.col(key) <= F.col("last_key")) & (F.col("first_key").isNull() | (F.col(key) >= F.col("first_key")))
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        index, ids = read(part["name"].iloc[0])
        open_, found = part[key].tolist(), ([], [])
        times = 0
        while open_:
            at, size = index.find(open_, np.full(len(open_), times))
            here = [(k, a, n) for k, a, n in zip(open_, at.tolist(), size.tolist()) if a >= 0]
            for k, a, n in here:
                found[0].append(k)
                found[1].append(ids[a : a + n].astype(np.int64))
            open_, times = [k for k, _, _ in here], times + 1
        return pd.DataFrame({key: found[0], "ids": found[1]})

    kind = store.manifest.schema["first_key"].dataType.simpleString()
    return placed.groupBy("name").applyInPandas(run, f"`{key}` {kind}, ids array<long>")
