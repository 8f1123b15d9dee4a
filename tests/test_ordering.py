"""Order statistics, running totals and lookups on their large-data paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.components import connected_components
from tabloom.operators.encoding import fit_encoder
from tabloom.operators.lookup import lookup
from tabloom.operators.ordering import exact_quantiles, running_totals

PROBABILITIES = [0.0, 0.003, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


@pytest.mark.parametrize("kind", ["spread", "ties", "heavy", "exponential", "two"])
def test_narrowing_equals_numpy(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(0, 1, 5000), "ties": rng.integers(0, 7, 3000).astype(float),
        "heavy": np.where(rng.random(4000) < 0.34, 2.5, rng.normal(2.5, 1, 4000)),
        "exponential": np.exp(rng.normal(0, 8, 3000)), "two": np.array([1.0, 2.0] * 600),
    }[kind]
    found = exact_quantiles(frame(spark, values), {"v": F.col("v")}, PROBABILITIES, small_rows=15)["v"]
    assert np.allclose(found, np.quantile(values, PROBABILITIES), rtol=1e-12, atol=0)


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, {"v": F.col("v")}, [0.5])["v"] == [2.0]
    empty = df.where("v > 100 and not isnan(v)")
    assert exact_quantiles(empty, {"v": F.col("v")}, [0.5])["v"] == [None]


@pytest.mark.parametrize("partitions", [1, 16])
def test_running_totals_by_range(spark, partitions):
    rows = [(g, v, (v * 7) % 5 + 1) for g in "ab" for v in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, w int").repartition(partitions)
    plain = running_totals(df, ["v"], {"up": "w"}, by=["g"], descending=True)
    ranged = running_totals(df, ["v"], {"up": "w"}, by=["g"], descending=True, small_rows=10)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))


def test_lookup_with_hot_keys_and_nulls(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string")
    table = df.where("k is not null and k <> 'k5'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    small = lookup(df, table, "k", "n").select("id", "k", "n", "top")
    large = lookup(df, table, "k", "n", rows=3).select("id", "k", "n", "top")
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert large.count() == 3000


def test_label_codes_beyond_local_bound(spark):
    df = spark.createDataFrame([(f"c{i % 137:03d}",) for i in range(2000)], "c string")
    near = fit_encoder(df, "label", "c").mapping().collect()
    far = fit_encoder(df, "label", "c", local_categories=5).mapping().collect()
    assert sorted(map(tuple, near)) == sorted(map(tuple, far))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200) if i % 40 != 39] + [(1000, j) for j in range(1001, 1100)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    near = connected_components(df)
    far = connected_components(df, small_edges=0)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    assert near.select("root").distinct().count() == 7
