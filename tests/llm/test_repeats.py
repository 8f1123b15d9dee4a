"""Repeated passages against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import queries, repeats

from ..conftest import DATA
from .edges import no_documents, odd_documents, same, texts

LENGTH = 200


def brute(docs, length=LENGTH):
    """(key, n_bytes, n_removed, n_spans, hash) with the places of every window counted."""
    seen = Counter()
    for _, text in docs:
        whole = text.encode()
        seen.update(whole[i : i + length] for i in range(len(whole) - length + 1))
    out = []
    for key, text in docs:
        whole = text.encode()
        covered = bytearray(len(whole) + 1)
        for i in range(len(whole) - length + 1):
            if seen[whole[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(c for c, gone in zip(whole, covered) if not gone)
        spans = sum(covered[i] and not covered[i - 1] for i in range(len(whole)))  # the last byte of covered is 0
        out.append((key, len(whole), len(whole) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, **options):
    out = repeats.remove_repeats(df, **options)
    return [tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]


def test_query(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = queries.QUERIES["op13_suffix_array_dedup"](spark, DATA)
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sum(r[2] for r in brute(docs)) > 0
    same(rows.collect(), brute(docs))


def passages(seed):
    """Texts made of shared passages cut at any byte, runs of one byte, short periods and own words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (30, 40, 45, 60, 100)]
    docs = []
    for k in range(80):
        parts = []
        for _ in range(r.randint(1, 6)):
            kind = r.random()
            if kind < 0.4:
                p, cut = r.choice(shared), r.randint(0, 60)
                parts.append(p[cut:] if kind < 0.2 else p[: len(p) - cut])
            elif kind < 0.5:
                parts.append("ab " * r.randint(1, 200))
            elif kind < 0.6:
                parts.append("x" * r.randint(150, 420))
            else:
                parts.append(" ".join(word() for _ in range(r.randint(1, 150))))
        docs.append((k, "".join(parts)))
    return [*docs, (500, docs[3][1]), (501, docs[3][1][:-1]), (502, ""), (503, "q" * 200), (504, "z" * 201)]


@pytest.mark.parametrize("seed, length", [(1, 200), (2, 120)])
def test_passages(spark, seed, length):
    docs = passages(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    same(found(df, length=length), brute(docs, length))


def test_hot_passage_between_own_words(spark):
    """A passage just under, at and over the length in many texts with different neighbours."""
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(230))
    own = lambda n: "".join(r.choice("mnopqrstu ") for _ in range(n))
    docs = [(k, own(r.randint(0, 300)) + passage[: r.choice([199, 200, 230])] + own(r.randint(0, 300))) for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    same(found(df), brute(docs))


def test_odd_documents(spark):
    same(found(odd_documents(spark)), brute([(k, t) for k, t in texts()]))


def test_no_documents(spark):
    out = repeats.remove_repeats(no_documents(spark))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"] and out.collect() == []


def test_long_text_over_blocks(spark):
    """A text of several blocks with a passage that crosses their border and comes again elsewhere."""
    r = random.Random(9)
    text = "".join(r.choice("abcdefghij") for _ in range(repeats.BLOCK * 2 + 500))
    across = text[repeats.BLOCK - 400 : repeats.BLOCK + 400]
    df = spark.createDataFrame([(1, text), (2, "q" + across + "z"), (3, None)], "doc_id long, text string")
    assert found(df) and {r[0]: r[1:4] for r in found(df)} == {
        1: (len(text), 800, 1), 2: (802, 800, 1), 3: (0, 0, 0),
    }


def test_spans_and_kept_bytes(spark):
    shared = "".join(random.Random(5).choice("abcdef") for _ in range(250))
    df = spark.createDataFrame([(1, "start" + shared + "é"), (2, shared)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(5, 255)] and bytes(rows[1].kept) == "starté".encode()
    assert bytes(rows[2].kept) == b""


def test_length_is_checked(spark):
    with pytest.raises(ValueError, match="length"):
        repeats.remove_repeats(no_documents(spark), length=300)


def test_lowest_and_digests():
    values = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    for width in (1, 2, 7, 64, 153):
        assert (repeats.lowest(values, width) == [values[i : i + width].min() for i in range(400 - width + 1)]).all()
    block = np.frombuffer(b"abcabcabcxabc", np.uint8)
    digits = repeats.Digits(64)
    sums = digits.sums(block)
    run = lambda b, e: int(digits.runs(sums, np.array([b]), np.array([e]))[0])
    assert run(0, 3) == run(3, 6) == run(10, 13) != run(1, 4) and run(0, 3) != run(0, 6)
