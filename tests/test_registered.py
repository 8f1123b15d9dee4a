"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def table(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    relation = duck.sql(oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(relation.columns, relation.fetchall())


SLOW = {"m8_svm_rbf", "m8_svm_poly", "m8_svm_linear", "m4_gradient_boosting_multiclass", "h1_grid_search", "c10_fill_trees"}


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_gives_rows(spark, name):
    assert queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert {r.metric for r in entry(spark).collect()} >= {"mse", "rmse", "mae", "r2"}
