"""Benchmark passages: planted ones are found, clean texts are left alone."""

import random

import numpy as np
import pytest

from tabloom.llm import decontaminate, queries
from tabloom.llm.decontaminate import Matcher, allowed, best_match
from tabloom.llm.shingles import word_hashes

from ..conftest import DATA
from .edges import no_documents, odd_documents


def words(n, r):
    return [f"{r.choice(['the', 'of', 'and', 'x'])}{r.randrange(40)}" for _ in range(n)]


def edited(item, k, r):
    w = list(item)
    for _ in range(k):
        at, kind = r.randrange(len(w)), r.random()
        if kind < 0.34:
            w[at] = f"zz{r.random()}"
        elif kind < 0.67:
            w.insert(at, f"yy{r.random()}")
        else:
            del w[at]
    return w


def plain_edits(item, text):
    """Fewest edits between the item and any passage."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_best_match_is_exact():
    r = random.Random(2)
    for _ in range(200):
        item, text = ([r.randrange(4) for _ in range(r.randint(1, n))] for n in (8, 14))
        edits, start, end = best_match(np.array(item, np.uint64), np.array(text, np.uint64))
        assert edits == plain_edits(item, text)
        assert plain_edits(item, text[start:end]) == edits or end == start


def test_recall_at_the_edit_limit():
    r = random.Random(3)
    items = [words(r.randint(15, 55), r) for _ in range(60)]
    matcher = Matcher([(i, " ".join(w)) for i, w in enumerate(items)])
    found = 0
    for trial in range(300):
        i = trial % 60
        text = words(r.randint(0, 80), r) + edited(items[i], allowed(len(items[i])), r) + words(r.randint(0, 80), r)
        found += any(hit[0] == i for hit in matcher.find(" ".join(text)))
    assert found >= 297


def test_every_match_is_within_the_limit():
    r = random.Random(4)
    items = [words(r.randint(5, 12), r) for _ in range(80)]
    matcher = Matcher([(i, " ".join(w)) for i, w in enumerate(items)])
    for _ in range(60):
        text = words(120, r)
        for i, edits, first, n in matcher.find(" ".join(text)):
            assert edits <= allowed(len(items[i])) and plain_edits(items[i], text[first : first + n]) == edits
        close = {i for i, w in enumerate(items) if plain_edits(w, text) <= allowed(len(w))}
        assert close >= {i for i, *_ in matcher.find(" ".join(text))}


def test_query_finds_all_verbatim_items(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r.edits for r in queries.QUERIES["op3_benchmark_decontamination"](spark, DATA).collect()}
    verbatim = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert verbatim and all(found.get(pair) in (0, 1, 2) for pair in verbatim)
    for (d, i), edits in found.items():
        plain = plain_edits(word_hashes(items[i]).tolist(), word_hashes(docs[d]).tolist())
        assert edits == plain <= allowed(len(items[i].split()))


def test_odd_documents_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame(
        [(1, "The CAT sat on the mat and looked"), (1, "The CAT sat on the mat and looked"), (2, None), (3, "word"),
         (None, "sat on the mat and looked at"), (4, "never to be found anywhere in here")],
        "item_id long, text string",
    ).selectExpr("*", "1 AS doc_id", "2 AS edits")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    rows = decontaminate.benchmark_matches(odd_documents(spark), items).collect()
    hits = sorted((r.doc_id, r.item_id or 0, r.edits) for r in rows)
    assert hits == sorted([(d, i, 0) for d in (1, 1, 8) for i in (0, 1, 1)])
    kept = decontaminate.drop_contaminated(odd_documents(spark), items)
    assert kept.columns == odd_documents(spark).columns and kept.count() == 7
    assert decontaminate.benchmark_matches(no_documents(spark), items).count() == 0
    assert decontaminate.benchmark_matches(odd_documents(spark), items.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["byte", "short", "int", "long", "string", "decimal(4,0)"])
def test_item_ids_of_any_type(spark, kind):
    words = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(7, words), (9, "none of these words is in any text at all here")], "item_id int, text string")
    items = items.withColumn("item_id", items.item_id.cast(kind))
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "nothing")], "doc_id long, text string").repartition(3)
    rows = decontaminate.benchmark_matches(docs, items).collect()
    assert [(r.doc_id, str(r.item_id), r.edits) for r in rows] == [(1, "7", 0)]
