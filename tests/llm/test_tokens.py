"""Token counts, SentencePiece encoding and id files against the tokenizer libraries."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from tabloom.llm import idfiles, queries, sentencepieces, token_counts
from tabloom.llm.common import vocabulary
from tabloom.llm.pretokens import PretokenTable, load_tokenizer

from ..conftest import DATA
from .edges import no_documents, odd_documents, same, texts

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SNIPPETS = [
    "a", "B", " ", " ", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "1", "٣", "Ⅷ", "!!", "***", "<|endoftext|>", "日本",
    "\x1c", "\x85", "\xa0", "​", "😀", "\x00", "don't", "_", "x" * 60, "²", "▁", "the", "tion", "aaaa", "<s>", "<0x41>", "ова",
]


def fuzz(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(SNIPPETS) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer(vocabulary(BYTES))


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))


def test_pretokens_give_the_library_ids(tokenizer):
    table = PretokenTable(vocabulary(BYTES), list, lambda parts: [i for p in parts for i in p])
    some = fuzz(1500, 1)
    assert table.of_texts(some) == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_words_after_a_newline_stay_apart(tokenizer):
    """Words that end a text with a newline and words that start one after it, next to each other in any order."""
    table = PretokenTable(vocabulary(BYTES), list, lambda parts: [i for p in parts for i in p])
    some = [t for i in range(200) for t in (f"x w{i}\n", f"\nv{i} y", f"\n{i} é")]
    assert table.of_texts(some) == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_frequent_pieces_are_those_of_all_texts(spark, monkeypatch):
    """Counted over every row, also where each has words of its own, against a plain count."""
    from collections import Counter

    table = PretokenTable(vocabulary(BYTES), len, sum)
    some = [f"the w{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[i // 260]} the don't" for i in range(2600)] + fuzz(300, 5)
    want: Counter = Counter()
    for t in some:
        for part in table.cut.split(t):
            if part not in table.special:
                want.update(p for p in table.split(part) if len(p) <= token_counts.LONGEST and "\0" not in p)
    monkeypatch.setattr(token_counts, "RUN", 500)
    monkeypatch.setattr(token_counts, "PARTIAL", 50)
    texts = spark.createDataFrame([(t,) for t in some], "text string").repartition(3)
    assert {r.piece: r.n for r in token_counts.piece_counts(texts, BYTES).collect()} == want
    pieces, lengths = token_counts.frequent_pieces(texts, BYTES)
    assert set(pieces.split("\0")) == want.keys() and len(lengths) == len(want)
    places = sorted(want.values(), reverse=True)
    monkeypatch.setattr(token_counts, "FREQUENT", 20)
    pieces = token_counts.frequent_pieces(texts, BYTES)[0].split("\0")
    assert set(pieces) == {p for p, n in want.items() if n > places[20] or places[19] > places[20] and n >= places[19]}
    assert "the" in pieces and len(pieces) <= 20


def test_full_tables_change_nothing(tokenizer, monkeypatch):
    from tabloom.llm import pretokens

    monkeypatch.setattr(pretokens, "PIECES", 20)
    monkeypatch.setattr(pretokens, "WORDS", 10)
    monkeypatch.setattr(pretokens, "LONGEST", 4)
    table = PretokenTable(vocabulary(BYTES), len, sum, {"the": 1})
    some = fuzz(300, 2)
    for start in range(0, 300, 50):
        part = some[start : start + 50]
        assert table.of_texts(part) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in part]


def test_token_counts_of_odd_documents(spark, tokenizer):
    got = token_counts.count_tokens(odd_documents(spark), limit=10)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    counts = [(k, t, len(tokenizer.encode(t, add_special_tokens=False).ids)) for k, t in texts()]
    same(got.collect(), [(k, len(t.encode()), n, n > 10) for k, t, n in counts])
    assert token_counts.count_tokens(no_documents(spark)).count() == 0


def test_token_count_query(spark, tokenizer):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_token_counts"](spark, DATA).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {
        k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in docs.items()
    }


def test_pieces_match_the_library(processor):
    table = sentencepieces.ChunkTable(vocabulary(PIECES))
    r = random.Random(4)
    words = ["".join(r.choice("etaoinshrdlucmfabg") for _ in range(r.randint(1, 24))) for _ in range(4000)]
    for t, (ids, back) in zip(some := fuzz(1500, 3) + words, table.of_texts(some)):
        want = processor.encode(t)
        assert ids == ",".join(map(str, want)), t
        assert back == processor.decode(want), t


def test_long_runs_take_little_time(processor):
    table = sentencepieces.ChunkTable(vocabulary(PIECES))
    some = [" " * 20_000 + "x", "a" * 20_000, "ab" * 5_000]
    assert [i for i, _ in table.of_texts(some)] == [",".join(map(str, processor.encode(t))) for t in some]


def test_sentencepiece_of_odd_documents(spark, processor):
    rows = sentencepieces.encoding_digests(odd_documents(spark)).collect()
    want = []
    for k, t in texts():
        ids = processor.encode(t)
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), processor.decode(ids))]
        want.append((k, len(ids), *digest))
    same(rows, want)
    full = sentencepieces.encode_texts(odd_documents(spark))
    decoded = sentencepieces.decode_ids(full.withColumnRenamed("decoded", "first")).collect()
    assert all(r.decoded == r.first == processor.decode(list(r.ids)) for r in decoded)
    assert sentencepieces.encode_texts(no_documents(spark)).count() == 0


def test_sentencepiece_query(spark, processor):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_sentencepiece"](spark, DATA).collect():
        ids = processor.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    hashes = np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64)
    found = idfiles.PerfectHash.build(np.unique(hashes))
    assert sorted(found.slots(np.unique(hashes)).tolist()) == list(range(len(np.unique(hashes))))


def test_strangers_are_told_by_their_fingerprint():
    index = idfiles.ShardIndex.build(list(range(5000)), np.ones(5000, np.int64))
    again = idfiles.ShardIndex.from_bytes(index.to_bytes())
    at, size = again.find(list(range(5000)), np.zeros(5000, np.int64))
    assert at.tolist() == list(range(5000)) and (size == 1).all()
    at, _ = again.find(list(range(10_000, 14_000)), np.zeros(4000, np.int64))
    assert (at >= 0).sum() <= 1


def test_id_files_of_odd_documents(spark, tokenizer):
    store = idfiles.write_ids(odd_documents(spark))
    rows = idfiles.read_ids(store).collect()
    want = {}
    for k, t in texts():
        want.setdefault(k, []).append(tokenizer.encode(t, add_special_tokens=False).ids + [2])
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and list(r.ids) in want[r.doc_id]
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(keys) == len(texts())
    wanted = spark.createDataFrame([(1,), (7,), (99,), (None,)], "doc_id long")
    found = [(r.doc_id, list(r.ids)) for r in idfiles.fetch_ids(store, wanted).collect()]
    assert sorted(found) == sorted([(1, want[1][0]), (1, want[1][0]), (7, want[7][0])])
    empty = idfiles.write_ids(no_documents(spark))
    assert idfiles.read_ids(empty).count() == 0 and idfiles.fetch_ids(empty, wanted).count() == 0


def test_id_file_query(spark, tokenizer):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op9_token_id_files"](spark, DATA).collect()}
    assert rows.keys() == docs.keys()
    at = 0
    for k in sorted(docs):
        ids = tokenizer.encode(docs[k], add_special_tokens=False).ids + [2]
        assert (rows[k].start, rows[k].n_tokens) == (at, len(ids))
        assert rows[k].ids_crc32 == crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


@pytest.mark.parametrize("words", [0, 30, 1_000_000])
def test_ids_laid_out_from_words(tokenizer, monkeypatch, words):
    """Blocks of plainly spaced and odd texts, with full, small and large tables of words."""
    monkeypatch.setattr(idfiles, "WORDS", words)
    monkeypatch.setattr(idfiles, "RUN", 3)
    monkeypatch.setattr(idfiles, "RUNS", 2)
    table = idfiles.IdTable(vocabulary(BYTES))
    some = fuzz(900, 3) + ["two words\n", "two words\n\n", "\ntwo words", "one", "", "ж слово día don't ' 's x's 't", "a\nb c\nd"] * 3
    some += [" ".join(x.strip() or "x" for x in fuzz(8, i)) for i in range(300)]
    for start in range(0, len(some), 100):
        part = some[start : start + 100]
        ids, sizes = table.of_texts(part, 2)
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(table.index) <= words


def test_the_library_is_asked_for_runs_of_words(monkeypatch):
    """Words go to the library many at a time, each once."""
    table = idfiles.IdTable(vocabulary(BYTES))
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    tokenizer, table.tokenizer = table.tokenizer, Counting()
    text = "first " + " ".join(f"w{i}" for i in range(1000))
    table.of_texts([text, text], 2)
    assert len(asked) <= 1000 // idfiles.RUN + 2
    asked.clear()
    table.of_texts([text], 2)
    assert asked == ["first"]
