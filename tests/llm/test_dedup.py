"""Near duplicates of texts and vectors against comparing all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from tabloom.llm import neardup, queries, vectors
from tabloom.llm.shingles import shingle_set

from ..conftest import DATA
from .edges import no_documents, odd_documents


def components(ids, linked):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute(docs, width, percent=80):
    sets = {k: set(shingle_set(t, width).tolist()) for k, t in docs.items()}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    return {k: len(s) for k, s in sets.items()}, components(keys, links)


def check(rows, docs, width):
    sizes, roots = brute(docs, width)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (
            sizes[r.doc_id], roots[r.doc_id], roots[r.doc_id] == r.doc_id
        )


def test_near_dedup_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    check(queries.QUERIES["op6_minhash_near_dedup"](spark, DATA).collect(), docs, 2)


def test_large_group_of_near_copies(spark):
    """A hub with many variants that are closer to it than to each other, and a hot group of exact copies."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    docs = {}
    for k in range(150):
        words = list(base)
        for _ in range(r.randint(1, 5)):
            words[r.randrange(120)] = f"v{r.randrange(10**6)}"
        docs[k] = " ".join(words)
    docs |= {k: " ".join(base) for k in range(150, 230)}
    docs |= {k: " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(1, 40))) for k in range(230, 300)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    check(neardup.near_duplicates(df, width=2).collect(), docs, 2)


@pytest.mark.parametrize("n, hub", [(500, 0), (2000, 1234)])
def test_hub_with_disjoint_variants(spark, n, hub):
    """Variants that reach 0.8 with their hub only."""
    r = random.Random(n)
    base = [f"w{i}" for i in range(200)]
    docs = {hub: " ".join(base)}
    for k in range(n + 1):
        if k != hub:
            words = list(base)
            for at in r.sample(range(1, 200, 3), r.randint(9, 11)):
                words[at] = f"v{k}x{at}"
            docs[k] = " ".join(words)
    sets = {k: set(shingle_set(t, 2).tolist()) for k, t in docs.items()}
    alike = [len(s & sets[hub]) / len(s | sets[hub]) for k, s in sets.items() if k != hub]
    assert 0.8 <= min(alike) and max(alike) < 0.85
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    rows = neardup.near_duplicates(df, width=2).collect()
    assert [r.doc_id for r in rows if r.component_id != 0] == []


def crowd(n, changes, apart):
    """Texts near one base, in pairs: both halves share their changes but for ``apart`` words each."""
    r = random.Random(n)
    docs = {}
    for k in range(0, n, 2):
        words = [f"w{i}" for i in range(200)]
        for at in r.sample(range(0, 200, 2), changes):
            words[at] = f"v{k}x{at}"
        docs[k] = " ".join(words)
        for at in r.sample(range(1, 200, 2), apart):
            words[at] = f"u{k}x{at}"
        docs[k + 1] = " ".join(words)
    return docs


def test_pairs_in_a_crowd(spark, monkeypatch):
    """Links between members of a large group that are close to no other member, in tiles of several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 64, raising=False)
    docs = crowd(1000, 18, 9)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    check(neardup.near_duplicates(df, width=2).collect(), docs, 2)


def test_candidates_grow_with_the_rows_of_a_group(spark):
    """A group of near copies gives few pairs for each member, at any size."""
    df = spark.createDataFrame(list(crowd(1500, 18, 9).items()), "doc_id long, text string")
    nodes = neardup.sketch(df, "doc_id", "text", 2)
    found = neardup.candidates(nodes.select("node", "signature")).count()
    assert found <= 1500 * neardup.TREES


def test_odd_documents(spark):
    rows = neardup.near_duplicates(odd_documents(spark), width=5).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[8].component_id == 1 and not by[8].kept and by[None].kept
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[6].n_shingles == 1
    assert neardup.near_duplicates(no_documents(spark)).count() == 0


def vectors_table(spark, values):
    return spark.createDataFrame(values, "vec_id long, embedding array<float>")


def brute_vectors(values, cosine=0.95):
    good = [(k, np.array(v, np.float32).astype(float)) for k, v in values if v and None not in v]
    good = [(k, v / np.linalg.norm(v)) for k, v in good if np.isfinite(v).all() and v.any()]
    links = {k: 0 for k, _ in values}
    pairs = []
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1 :]:
            if x @ y >= cosine:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    return links, components([k for k, _ in values], pairs)


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 16)  # many tiles
    monkeypatch.setattr(vectors, "VISITORS", 16)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    values = [(k, (centres[k % 12] + 0.12 * r.normal(size=16)).tolist()) for k in range(240)]
    values += [(k, centres[0].tolist()) for k in range(240, 300)]
    values += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] + [1.0] * 15)]
    rows = vectors.near_vectors(vectors_table(spark, values)).collect()
    links, roots = brute_vectors(values)
    assert len(rows) == len(values)
    true = sum(links.values())
    found = sum(min(links[x.vec_id], x.n_links) for x in rows)
    assert true > 1000 and found >= 0.98 * true and all(x.n_links <= links[x.vec_id] for x in rows)
    assert sum(x.component_id != roots[x.vec_id] for x in rows) <= 2
    assert all(x.n_links == 0 and x.component_id == x.vec_id and x.kept for x in rows if x.vec_id >= 300)


def test_vector_query_and_edges(spark):
    found = queries.QUERIES["op8_embedding_near_dedup"](spark, DATA).collect()
    values = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    links, roots = brute_vectors(values)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {k: (links[k], roots[k]) for k, _ in values}
    odd = vectors_table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [1.0, 2.0]), (3, [1.0])])
    rows = sorted((tuple(r) for r in vectors.near_vectors(odd.selectExpr("*", "1 AS node", "2 AS n")).collect()), key=str)
    assert rows == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert vectors.near_vectors(vectors_table(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingles(width):
    assert len(shingle_set("A b\tc\x0bd É  é", 1)) == 6
    assert len(shingle_set("x y", width)) == (2 if width == 1 else 1)
    assert len(shingle_set(" \n", width)) == 0
    assert shingle_set("AB cd", width).tolist() == shingle_set("ab CD", width).tolist()


def test_tiny_huge_and_other_lengths(spark):
    """Numbers whose squares leave the range, and vectors of several lengths, link like any other."""
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, [1e-200, 1e200, 3.0]))]
    rows += [(200, [1.0, 2.0]), (201, [2.0, 4.0]), (202, [1.0, -2.0]), (203, [5.0])]
    got = {x.vec_id: x for x in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) and [got[100 + i].component_id for i in range(3)] == [0, 1, 2]
    assert (got[200].n_links, got[201].component_id, got[201].kept, got[202].n_links, got[203].kept) == (1, 200, False, 0, True)


def test_a_tile_full_of_copies_takes_bounded_memory():
    """600 vectors that are all linked: 360,000 pairs, of which few are held at once."""
    import tracemalloc

    random = np.random.default_rng(3)
    unit = vectors.unit_rows(random.normal(size=64) + random.normal(0, 0.01, (600, 64)))
    index = vectors.Index.fit(unit, 4, 0.95)
    own = vectors.nearest(unit, index.coarse)
    codes, error = index.encode(unit, np.zeros(600, int))
    members = pd.DataFrame({
        "list": 0, "node": [b"%04d" % i for i in range(600)], "raw": [u.tobytes() for u in unit], "n": 1,
        "codes": [c.tobytes() for c in codes], "error": error,
    })
    tracemalloc.start()
    try:
        out = vectors.tile_links(index, members, members.assign(own=own), 0.95, "f8")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150_000_000
    visits = out[out["b"].isna() & out["a"].isin(members["node"])].groupby("a")["n"].max()
    assert len(visits) == 600 and (visits >= 599).all()
    assert len(out[out["b"].notna()]["b"].unique()) == 1
