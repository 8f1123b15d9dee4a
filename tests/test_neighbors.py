"""Neighbour join, distance sums and density clusters against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import neighbors
from tabloom.operators.metrics.clustering import silhouette_samples
from tabloom.operators.missing import fill_by_neighbors
from tabloom.operators.models.cluster import single_linkage
from tabloom.operators.models.density import dbscan
from tabloom.operators.neighbors import distance_sums, nearest


def points(seed=0, copies=40):
    rng = np.random.default_rng(seed)
    x = np.concatenate([
        rng.normal([0, 0], 0.5, (120, 2)), rng.normal([5, 5], 0.7, (80, 2)), rng.uniform(-5, 12, (40, 2)), np.zeros((copies, 2)),
    ])
    return x


def table(spark, x):
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
    pdf.insert(0, "id", range(len(pdf)))
    return spark.createDataFrame(pdf), [c for c in pdf.columns if c != "id"]


def pairwise(x, metric="euclidean"):
    gap = np.abs(x[:, None] - x[None])
    return gap.sum(-1) if metric == "manhattan" else np.sqrt((gap**2).sum(-1))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_cells_equal_brute_force(spark, metric):
    # a seventh of the rows are copies of one point
    x = points()
    df, names = table(spark, x)
    d = pairwise(x, metric)
    np.fill_diagonal(d, np.inf)
    want = [(i, j) for i in range(len(x)) for j in np.lexsort((range(len(x)), d[i]))[:4]]
    for settings in ({}, {"small_values": 0, "tile_rows": 32}):
        got = nearest(df, df, "id", names, 4, metric, True, **settings).orderBy("left_key", "rank").toPandas()
        assert list(zip(got.left_key, got.right_key)) == want


def test_fewer_rows_than_neighbors(spark):
    df, names = table(spark, np.array([[0.0, 0.0], [1.0, 0.0], [3.0, 0.0]]))
    for settings in ({}, {"small_values": 0}):
        assert nearest(df, df, "id", names, 5, exclude_self=True, **settings).count() == 6


def test_distance_sums_by_tile(spark):
    x = points()
    df, names = table(spark, x)
    df = df.selectExpr("*", "cast(id % 3 as int) as g")
    got = distance_sums(df, "id", names, "g", small_values=0, tile_rows=50).toPandas()
    d = pairwise(x)
    for r in got.sample(30, random_state=1).itertuples():
        assert np.isclose(r.total, d[r.id, np.arange(len(x)) % 3 == r.other].sum())


def test_silhouette_of_singletons_is_zero(spark):
    df, names = table(spark, np.array([[0.0, 0.0], [0.1, 0.0], [5.0, 5.0]]))
    df = df.selectExpr("*", "case when id = 2 then 1 else 0 end as g")
    got = {r.id: r.silhouette for r in silhouette_samples(df, "id", names, "g").collect()}
    assert got[2] == 0.0 and got[0] > 0.9


def density_brute(x, eps, least, metric="euclidean"):
    near = pairwise(x, metric) <= eps
    core = near.sum(1) >= least
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = k
            while stack:
                for v in np.nonzero(near[stack.pop()] & core)[0]:
                    if label[v] < 0:
                        label[v] = k
                        stack.append(v)
            k += 1
    for i in np.nonzero(~core)[0]:
        reached = label[np.nonzero(near[i] & core)[0]]
        if len(reached):
            label[i] = reached.min()
    return label


@pytest.mark.parametrize("eps,least,metric,tile", [(0.5, 5, "euclidean", 4096), (0.3, 8, "euclidean", 16), (0.4, 6, "manhattan", 32)])
def test_density_clusters(spark, eps, least, metric, tile):
    x = points()
    df, names = table(spark, x)
    got = dbscan(df, "id", names, eps, least, metric, tile_rows=tile).orderBy("id").toPandas()
    assert (got.cluster.to_numpy() == density_brute(x, eps, least, metric)).all()


def test_density_clusters_beyond_grid_dimensions(spark):
    x = np.concatenate([points(), np.random.default_rng(1).normal(0, 0.1, (280, 3))], axis=1)
    df, names = table(spark, x)
    got = dbscan(df, "id", names, 0.6, 5, tile_rows=64).orderBy("id").toPandas()
    assert (got.cluster.to_numpy() == density_brute(x, 0.6, 5)).all()


def test_single_linkage(spark):
    x = points(2, copies=5)[::3]
    df, names = table(spark, x)
    d = pairwise(x)
    comp, left = np.arange(len(x)), len(x)
    for _, i, j in sorted((d[i, j], j, i) for i in range(len(x)) for j in range(i)):
        if left == 4:
            break
        if comp[i] != comp[j]:
            comp[comp == comp[i]] = comp[j]
            left -= 1
    _, first = np.unique(comp, return_index=True)
    order = {comp[f]: r for r, f in enumerate(sorted(first))}
    got = single_linkage(df, "id", names, 4).orderBy("id").toPandas()
    assert list(got.cluster) == [order[c] for c in comp]


def test_neighbor_fill_uses_shared_columns(spark):
    rows = [(0, 1.0, 10.0, 5.0), (1, 1.1, None, 6.0), (2, 9.0, 90.0, 50.0), (3, None, None, None), (4, 1.2, 12.0, None), (5, 8.8, 88.0, 52.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r.id: r for r in fill_by_neighbors(df, "id", ["a", "b", "c"], k=1).collect()}
    assert got[1].b == 12.0  # only a is shared with row 4, and it is nearest after scaling
    assert got[4].c == 6.0 or got[4].c == 5.0
    assert np.isclose(got[3].a, np.mean([1.0, 1.1, 9.0, 1.2, 8.8]))  # nothing shared: the column mean


def test_a_search_measures_few_pairs(monkeypatch):
    """Distances are taken dimension by dimension for few pairs, and boxes out of reach are left out."""
    random = np.random.default_rng(5)
    x = (random.normal(size=(40, 3)) * 100)[np.arange(8000) % 40] + random.normal(size=(8000, 3))
    x[4000:4100] = x[0]  # copies: ties go to the lower key
    keys = np.arange(8000)
    seen = []
    plain, exact = neighbors.distances, neighbors.pair_distances
    monkeypatch.setattr(neighbors, "distances", lambda a, b, m: seen.append(len(a) * len(b)) or plain(a, b, m))
    monkeypatch.setattr(neighbors, "pair_distances", lambda a, b, m: seen.append(len(a)) or exact(a, b, m))
    right = neighbors.RightSide(x, keys, None, {})
    left = pd.DataFrame({"left_key": keys, "_x": list(x)})
    out = neighbors.top_rows(left, right, 4, "euclidean", True, False).sort_values(["left_key", "rank"])
    assert sum(seen) < 8000 * 8000 / 20
    every = plain(x, x, "euclidean")
    np.fill_diagonal(every, np.inf)
    want = np.argsort(every, axis=1, kind="stable")[:, :4]
    assert (out["right_key"].to_numpy().reshape(-1, 4) == want).all()
    assert (out["distance"].to_numpy().reshape(-1, 4) == np.take_along_axis(every, want, axis=1)).all()


def test_label_sums_take_no_pair_by_dimension(monkeypatch):
    random = np.random.default_rng(6)
    x = np.concatenate([random.normal(size=(700, 5)) + 1e4, random.normal(size=(700, 5))])
    x[:50] = x[700]
    codes = np.sort(random.integers(0, 4, 1400))
    want = neighbors.distances(x, x, "euclidean") @ np.eye(4)[codes]

    def refuse(*_):
        raise AssertionError("all pairs were measured dimension by dimension")

    monkeypatch.setattr(neighbors, "distances", refuse)
    got = neighbors.label_sums(x, x, codes, 4, "euclidean")
    assert got == pytest.approx(want, rel=1e-9)


def test_tiles_without_visitors_carry_text(spark):
    """Cells that nobody visits again give no rows, whatever the types of key and carried columns."""
    df = spark.range(400).select(
        F.concat(F.lit("k"), "id").alias("key"), (F.col("id") * 3).cast("double").alias("a"), F.concat(F.lit("n"), "id").alias("name"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
    )
    hits = nearest(df, df, "key", ["a"], 1, carry=["name", "day"], small_values=0, tile_rows=50).collect()
    assert len(hits) == 400 and all(h.left_key == h.right_key and h.name == "n" + h.left_key[1:] for h in hits)
    # one label fills the buckets of one side only
    few = df.limit(3).withColumn("g", F.lit("x"))
    sums = distance_sums(few, "key", ["a"], "g", small_values=0, tile_rows=1).collect()
    assert {r.key: r.total for r in sums} == {"k0": 9.0, "k1": 6.0, "k2": 9.0}
