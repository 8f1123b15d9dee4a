"""Encoders, splits and folds."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import encoding, split
from tabloom.plans.train import train_model

from .base import F1, F10, FIT10, duck_hash, query, rd, rounded, rows, table, union

BRANDS = "SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS code, count(*) AS n, avg(y) AS m FROM f GROUP BY brand"
WITH = f"WITH f AS ({FIT10}), a AS ({F10}), c AS ({BRANDS})"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "e1_label_encoding",
    "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand, p_type FROM part",
)
def e1(spark, sf):
    frame = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return encoding.fit_encoder(frame, "label", "p_brand").apply(frame)


@query(
    "e1_label_mapping",
    "SELECT p_name AS category, CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name",
)
def e1b(spark, sf):
    # a tiny local bound sends the categories through the distributed ranking
    return encoding.fit_encoder(table(spark, sf, "part"), "label", "p_name", local_categories=4).mapping()


@query(
    "e2_onehot_encoding",
    "SELECT o_orderkey, " + ", ".join(
        f"CASE WHEN o_orderpriority = '{p}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"o_orderpriority_{p}\"" for p in PRIORITIES
    ) + " FROM orders",
)
def e2(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encoding.fit_encoder(frame, "onehot", "o_orderpriority").apply(frame)


@query(
    "e3_ordinal_encoding",
    "SELECT o_orderkey, CAST(array_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) - 1 AS DOUBLE)"
    " AS o_orderpriority FROM orders",
)
def e3(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encoding.fit_encoder(frame, "ordinal", "o_orderpriority", categories=PRIORITIES[::-1]).apply(frame)


@query(
    "e4_target_encoding",
    f"{WITH} SELECT a.id, {rd('coalesce((c.n * c.m + 10 * (SELECT avg(y) FROM f)) / (c.n + 10), (SELECT avg(y) FROM f))')} AS brand, a.y"
    " FROM a LEFT JOIN c ON c.brand = a.brand",
)
def e4(spark, sf):
    fitted = encoding.fit_encoder(rows(spark, sf, FIT10), "target", "brand", "y", smoothing=10)
    return rounded(fitted.apply(rows(spark, sf, F10)))


@query("e5_frequency_encoding", f"{WITH} SELECT a.id, CAST(coalesce(c.n, 0) AS DOUBLE) AS brand FROM a LEFT JOIN c ON c.brand = a.brand")
def e5(spark, sf):
    return encoding.fit_encoder(rows(spark, sf, FIT10), "frequency", "brand").apply(rows(spark, sf, F10)).select("id", "brand")


@query(
    "e5_frequency_share",
    f"{WITH} SELECT a.id, {rd('coalesce(CAST(c.n AS DOUBLE), 0) / (SELECT count(*) FROM f)')} AS brand FROM a LEFT JOIN c ON c.brand = a.brand",
)
def e5b(spark, sf):
    fitted = encoding.fit_encoder(rows(spark, sf, FIT10), "frequency", "brand", normalize=True)
    return rounded(fitted.apply(rows(spark, sf, F10)).select("id", "brand"))


# the brands number 25, so a code takes five bits
@query(
    "e6_binary_encoding",
    f"{WITH} SELECT a.id, " + ", ".join(
        f"CAST((CAST(coalesce(c.code, 0) AS BIGINT) >> {4 - i}) & 1 AS DOUBLE) AS brand_bin_{i}" for i in range(5)
    ) + " FROM a LEFT JOIN c ON c.brand = a.brand",
)
def e6(spark, sf):
    return encoding.fit_encoder(rows(spark, sf, FIT10), "binary", "brand").apply(rows(spark, sf, F10)).drop("y")


_BUCKET = "CAST(('0x' || substr(md5(brand), 1, 8)) AS BIGINT) % 8"
_SIGN = "CASE WHEN CAST(('0x' || substr(md5(brand), 9, 1)) AS BIGINT) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END"


@query(
    "e7_hash_encoding",
    f"{WITH} SELECT id, " + ", ".join(
        f"CASE WHEN {_BUCKET} = {i} THEN {_SIGN} ELSE CAST(0 AS DOUBLE) END AS brand_hash_{i}" for i in range(8)
    ) + " FROM a",
)
def e7(spark, sf):
    return encoding.fit_encoder(rows(spark, sf, FIT10), "hash", "brand", n_features=8).apply(rows(spark, sf, F10)).drop("y")


KINDS = ("label", "onehot", "ordinal", "binary")


@query(
    "e8_inverse_encoding",
    union([f"SELECT '{k}' AS method, p_partkey AS id, p_brand AS brand FROM part" for k in KINDS]),
)
def e8(spark, sf):
    frame = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    out = None
    for kind in KINDS:
        fitted = encoding.fit_encoder(frame, kind, "brand")
        back = fitted.invert(fitted.apply(frame)).select(F.lit(kind).alias("method"), "id", "brand")
        out = back if out is None else out.unionByName(back)
    return out


CONFIGS = [
    {"column_name": "id", "encoding_method": "none"},
    {"column_name": "brand", "encoding_method": "target", "smoothing": 5},
    {"column_name": "type", "encoding_method": "frequency"},
    {"column_name": "y", "is_target": True},
]
AUTO = "SELECT p_partkey AS id, p_brand AS brand, p_type AS type, concat('s', p_size % 2) AS parity, p_retailprice AS y FROM {part}"


@query(
    "e9_auto_encoding",
    f"WITH t AS ({AUTO}), g AS (SELECT avg(y) AS g FROM t), b AS (SELECT brand, (count(*) * avg(y) + 5 * max(g)) / (count(*) + 5) AS v FROM t, g GROUP BY brand),"
    " k AS (SELECT type, count(*) AS n FROM t GROUP BY type)"
    f" SELECT t.id, {rd('b.v')} AS brand, CAST(k.n AS DOUBLE) AS type, CASE WHEN parity = 's0' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS parity_s0,"
    " CASE WHEN parity = 's1' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS parity_s1, y FROM t JOIN b ON b.brand = t.brand JOIN k ON k.type = t.type",
)
def e9(spark, sf):
    frame = rows(spark, sf, AUTO)
    return rounded(encoding.fit_auto_encoding(frame, CONFIGS).apply(frame))


@query(
    "e10_encoding_report",
    "SELECT 'brand' AS column_name, 'binary' AS method, string_agg('brand_bin_' || i, ',' ORDER BY i) AS new_columns, CAST(NULL AS VARCHAR) AS error"
    " FROM range(0, (SELECT CAST(ceil(log2(count(DISTINCT p_brand))) AS BIGINT) FROM part)) r(i)"
    " UNION ALL SELECT 'parity', 'onehot', string_agg('parity_' || p, ',' ORDER BY p), NULL FROM (SELECT DISTINCT 's' || (p_size % 2) AS p FROM part) q"
    " UNION ALL SELECT 'type', NULL, NULL, 'unknown encoding ''nonsense''' FROM part HAVING count(*) > 0",
)
def e10(spark, sf):
    frame = rows(spark, sf, AUTO)
    configs = [
        {"column_name": "id", "encoding_method": "none"}, {"column_name": "brand", "encoding_method": "binary"},
        {"column_name": "type", "encoding_method": "nonsense"}, {"column_name": "y", "is_target": True},
    ]
    return encoding.fit_auto_encoding(frame, configs).report(spark)


@query(
    "t1_train_test_split",
    f"SELECT o_orderkey, CASE WHEN {duck_hash('CAST(o_orderkey AS VARCHAR)')} < 3435973836.8 THEN 'train' ELSE 'test' END AS part FROM orders",
)
def t1(spark, sf):
    return split.with_part(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "t2_label_indexing",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment FROM customer",
)
def t2(spark, sf):
    frame = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encoding.fit_encoder(frame, "label", "c_mktsegment").apply(frame)


@query(
    "h5_fold_assignment",
    "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY "
    + duck_hash("c_mktsegment || '|' || CAST(c_custkey AS VARCHAR)")
    + ", c_custkey) - 1) % 5 AS BIGINT) AS fold FROM customer",
)
def h5(spark, sf):
    frame = table(spark, sf, "customer")
    return rounded(split.with_fold(frame, "c_custkey", 5, "c_mktsegment").select("c_custkey", "fold"))


@query(
    "e2_sparse_onehot",
    """WITH f AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM f)
    SELECT p.p_partkey AS id, c.code AS place, CAST(CASE WHEN c.code IS NULL THEN 0 ELSE 1 END AS BIGINT) AS ones, (SELECT count(*) FROM c) AS size
    FROM part p LEFT JOIN c ON c.p_name = p.p_name""",
)
def e2b(spark, sf):
    """A one-hot code as a sparse vector; names that were not fitted are all zero."""
    frame = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    coder = encoding.fit_encoder(frame.where("id % 3 <> 0"), "onehot", "p_name", sparse=True)
    shown = coder.apply(frame).withColumn("v", vector_to_array("p_name_onehot"))
    place = F.array_position("v", F.lit(1.0)) - 1
    return shown.select(
        "id", F.when(place >= 0, place).alias("place"), F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("ones"),
        F.size("v").cast("long").alias("size"),
    )


@query(
    "e9_sparse_training",
    f"""WITH t AS (SELECT p_partkey AS id, p_brand || p_size AS kind, p_retailprice AS y,
      CASE WHEN {duck_hash('CAST(p_partkey AS VARCHAR)')} < 3435973836.8 THEN 1 ELSE 0 END AS train FROM part),
    m AS (SELECT kind, avg(y) AS v FROM t WHERE train = 1 GROUP BY kind)
    SELECT t.id, {rd('coalesce(m.v, 0)', 3)} AS prediction FROM t LEFT JOIN m ON m.kind = t.kind""",
)
def e9b(spark, sf):
    """Least squares on a sparse one-hot column alone: the mean of each category, zero for an unseen one."""
    frame = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_brand", "p_size").alias("kind"), F.col("p_retailprice").alias("y")
    )
    done = train_model(
        frame, "id", "linear_regression", "y", parameters={"fit_intercept": False}, scale="standard",
        encoding=[{"column_name": "kind", "encoding_method": "onehot", "sparse": True}],
    )
    return rounded(done.bundle.score(frame).select("id", "prediction"), 3)


@query(
    "m7_ordered_statistics",
    f"""WITH t AS ({F1}), w AS (SELECT id, priority, y, count(*) OVER o AS n, sum(y) OVER o AS s FROM t WHERE priority IS NOT NULL
      WINDOW o AS (PARTITION BY priority ORDER BY {duck_hash('id')}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT t.id, {rd('coalesce((coalesce(w.s, 0) + g.m) / (w.n + 1), g.m)', 3)} AS priority
    FROM t LEFT JOIN w ON w.id = t.id, (SELECT avg(y) AS m FROM t) g""",
)
def m7b(spark, sf):
    """The target mean of the rows before each one, in a hashed order within its category."""
    frame = rows(spark, sf, F1).select("id", "priority", "y")
    return rounded(encoding.ordered_target(frame, "priority", "y", "id").select("id", "priority"), 3)
