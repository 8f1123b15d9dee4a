"""Registration, table access and shared fixture texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = plain(oracle)
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def plain(text: str) -> str:
    """The fixture text as DuckDB reads it."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def rows(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A fixture text over the given tables."""
    used = {n: table(spark, folder, n) for n in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **used)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero removed, integers widened: the form compared with SQL."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def rd(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


F1 = """
SELECT o_orderkey AS id, o_orderstatus AS status,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust,
       o_totalprice AS y
FROM {orders}
"""

F2 = """
SELECT p_partkey AS id, p_brand AS brand, p_type AS type,
       CASE WHEN p_partkey % 97 = 0 THEN p_retailprice * 20 ELSE p_retailprice END AS price,
       CAST(p_size AS DOUBLE) AS size,
       CAST(p_size AS DOUBLE) * 2 + (p_partkey % 5) AS size2,
       CAST(p_partkey % 10 AS DOUBLE) AS digit,
       CAST(7 AS DOUBLE) AS constant
FROM {part}
"""

F3 = """
SELECT o_orderkey AS id,
       CAST(o_custkey AS STRING) AS num_text,
       CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_90,
       CASE WHEN o_orderkey % 10 < 3 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_70,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_100,
       o_orderpriority AS cat,
       CAST(NULL AS STRING) AS empty
FROM {orders}
"""

F4 = """
SELECT c.c_custkey AS id, c.c_acctbal AS acctbal, c.c_mktsegment AS segment,
       CAST(c.c_nationkey AS DOUBLE) AS nation,
       CAST(COUNT(o.o_orderkey) AS DOUBLE) AS n_orders,
       CASE WHEN c.c_acctbal + 600 * COUNT(o.o_orderkey) > 10500 THEN 1 ELSE 0 END AS label,
       CASE WHEN c.c_acctbal > 6500 THEN 'high' WHEN c.c_acctbal > 2500 THEN 'mid' ELSE 'low' END AS label3
FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_acctbal, c.c_mktsegment, c.c_nationkey
"""

F5 = """
SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2,
       CAST(3 AS DOUBLE) * p_size + CAST(0.05 AS DOUBLE) * p_retailprice
         + CAST((p_partkey * 7919) % 101 - 50 AS DOUBLE) / CAST(10 AS DOUBLE) AS y
FROM {part}
"""

F6 = """
SELECT event_id AS id, y_true, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred,
       c_true, c_pred, r_true, r_pred
FROM (
  SELECT event_id,
         CASE WHEN value > 34 THEN 1 ELSE 0 END AS y_true,
         CAST(((event_id * 7919) % 97) * 6 + CASE WHEN value > 34 THEN 400 ELSE 0 END AS DOUBLE) / 1000 AS score,
         CAST(event_id % 3 AS INT) AS c_true,
         CAST(CASE WHEN event_id % 5 = 0 THEN (event_id + 1) % 3 ELSE event_id % 3 END AS INT) AS c_pred,
         value AS r_true,
         value * CAST(0.9 AS DOUBLE) + (event_id % 21) - 10 AS r_pred
  FROM {events}
) t
"""

DIMENSIONS = [f"e{i}" for i in range(1, 9)]

F7 = "SELECT vec_id, label, " + ", ".join(
    f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(1, 9)
) + " FROM embeddings"


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """First eight dimensions of every vector."""
    wide = table(spark, folder, "embeddings")
    return wide.select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(DIMENSIONS)]
    )


# Three blobs from every part and a row of isolated points from every supplier.
F8 = """
SELECT p_partkey AS id, CAST(p_partkey % 3 AS INT) AS blob,
       CAST((p_partkey % 3) * 10 AS DOUBLE) + ((p_partkey * 7) % 11) / CAST(10 AS DOUBLE) AS x,
       CAST((p_partkey % 3) * 5 AS DOUBLE) + ((p_partkey * 5) % 13) / CAST(10 AS DOUBLE) AS y
FROM {part}
UNION ALL
SELECT 100000000 + s_suppkey AS id, -1 AS blob, CAST(100 + 5 * s_suppkey AS DOUBLE) AS x, CAST(-100 AS DOUBLE) AS y
FROM {supplier}
"""

F9 = """
SELECT n_nationkey AS id, n_name AS name,
       CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - 1 END AS source_dataset_id,
       CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey END AS used_by_model
FROM {nation}
"""

PREDICTIONS = """
SELECT c_custkey AS id,
       c_nationkey - c_nationkey % 4 + CASE WHEN c_custkey % 50 = 0 THEN 100 ELSE 0 END AS model_id,
       CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS input_dataset_id
FROM {customer}
"""

MODELS = "SELECT DISTINCT n_nationkey - n_nationkey % 4 AS id, n_nationkey - n_nationkey % 4 AS dataset_id FROM {nation}"

FIT10 = "SELECT p_partkey AS id, p_brand AS brand, p_retailprice AS y" " FROM {part}"
F10 = """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 35 = 0 THEN 'Brand#unseen' WHEN p_partkey % 55 = 0 THEN NULL ELSE p_brand END AS brand,
       p_retailprice AS y
FROM {part}
"""

NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def duck_number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER}') THEN TRY_CAST({c} AS DOUBLE) END"


def duck_moment(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST({c} AS TIMESTAMP) END"


def duck_hash(key: str, seed: int | str = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 8)) AS BIGINT)"
