"""Files, profiles and column roles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabloom.operators import profiling
from tabloom.sources import files, registry
from tabloom.sources.shared import shared_folder

from .base import F1, F2, F3, duck_moment, duck_number, query, rd, rounded, rows, table, union

PART_SQL = """
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
       p_retailprice FROM part
"""


def _path(spark, ending: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.{ending}"


def _part(df):
    return rounded(df).withColumn("p_partkey", F.col("p_partkey").cast("bigint")).select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )


@query("s1_csv_round_trip", PART_SQL)
def s1(spark, sf):
    path = _path(spark, "csv")
    files.write_dataset(table(spark, sf, "part"), path, "csv")
    return _part(files.read_dataset(spark, path))


@query("s2_json_round_trip", PART_SQL)
def s2(spark, sf):
    path = _path(spark, "json")
    source = table(spark, sf, "part")
    files.write_dataset(source, path, "json")
    return _part(files.read_dataset(spark, path, "jsonl", source.schema))


@query("s4_records_to_table", "SELECT n_nationkey AS id, n_name AS name, CAST(n_nationkey AS DOUBLE) / 2 AS half FROM nation")
def s4(spark, sf):
    # the records a caller would post: a list of objects, one of them without a field
    records = [
        {"id": r.n_nationkey, "name": r.n_name, "half": r.n_nationkey / 2} for r in table(spark, sf, "nation").collect()
    ]
    return files.from_records(spark, records, "id int, name string, half double")


@query(
    "s5_derived_dataset",
    "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand, "
    + rd("(p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part)")
    + " AS p_retailprice FROM part",
)
def s5(spark, sf):
    from tabloom.operators.scaling import fit_scaler

    source = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    path = _path(spark, "csv")
    files.write_dataset(fit_scaler(source, "standard", ["p_retailprice"]).apply(source), path)
    back = files.read_dataset(spark, path)
    return rounded(back).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query(
    "s5_registered_columns",
    union([
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, {x} AS is_excluded, CAST(count(*) - count({c}) AS BIGINT) AS missing_count,"
        f" CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM (SELECT o_orderkey AS id, o_orderpriority AS priority,"
        " CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 4 AS grp FROM orders) t"
        for c, t, x in [("id", "numeric", "false"), ("priority", "categorical", "false"), ("price", "numeric", "true"), ("grp", "categorical", "false")]
    ]),
)
def s5b(spark, sf):
    frame = rows(spark, sf, """
        SELECT o_orderkey AS id, o_orderpriority AS priority,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 4 AS grp FROM {orders}""")
    book = registry.Registry(spark, _path(spark, "registry"))
    first = book.add_dataset(frame, "orders", "orders.parquet", "parquet")
    # the user declares grp categorical and excludes price; the derived dataset inherits both
    book.append("columns", [
        {"dataset_id": first, "column_name": "grp", "data_type": "categorical", "is_target": False, "is_excluded": False},
        {"dataset_id": first, "column_name": "price", "data_type": "numeric", "is_target": False, "is_excluded": True},
    ])
    second = book.add_dataset(frame, files.derived_name("orders"), "orders_processed.parquet", "parquet", first)
    return book.table("columns").where(F.col("dataset_id") == second).select(
        "column_name", "data_type", "is_excluded", "missing_count", "unique_count"
    )


@query("s6_overwrite_dataset", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(2 AS BIGINT) AS version FROM supplier")
def s6(spark, sf):
    path = _path(spark, "parquet")
    source = table(spark, sf, "supplier").select("s_suppkey")
    files.write_dataset(source.withColumn("version", F.lit(1)), path, "parquet")
    files.write_dataset(source.withColumn("version", F.lit(2)), path, "parquet", overwrite=True)
    return rounded(files.read_dataset(spark, path))


@query("s7_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def s7(spark, sf):
    return files.page(table(spark, sf, "orders"), "o_orderkey", 3, 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("s8_preview", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def s8(spark, sf):
    return files.preview(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "s9_declared_types",
    f"SELECT CAST(id AS VARCHAR) AS id, {duck_number('num_text')} AS num_text, {duck_number('date_90')} AS date_90, cat FROM ({F3}) t",
)
def s9(spark, sf):
    typed = files.apply_types(rows(spark, sf, F3), {"id": "categorical", "num_text": "numeric", "date_90": "numeric"})
    return typed.select("id", "num_text", "date_90", "cat")


@query(
    "s11_result_document",
    "SELECT '{\"algorithm\":\"count\",\"metrics\":{\"high\":' || CAST(CAST(max(o_orderkey) AS DOUBLE) AS VARCHAR) || ',\"rows\":' ||"
    " CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) || '}}' AS document FROM orders",
)
def s11(spark, sf):
    from tabloom.operators.metrics.common import metric_rows

    row = table(spark, sf, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("h"))
    return files.result_document(metric_rows(row, {"rows": F.col("n"), "high": F.col("h")}), algorithm="count")


TEXTS = ["num_text", "date_90", "date_70", "date_100", "cat", "empty"]


@query(
    "p1_column_types",
    union(
        [f"SELECT 'id' AS column_name, CAST(0 AS BIGINT) AS column_index, 'numeric' AS data_type FROM ({F3}) t HAVING count(id) >= 0"]
        + [
            f"SELECT '{c}', {i + 1}, CASE WHEN count({c}) > 0 AND count({duck_number(c)}) = count({c}) THEN 'numeric'"
            f" WHEN count({c}) > 0 AND count({duck_moment(c)}) = count({c}) AND bool_or(regexp_matches({c}, '[-/:]'))"
            f" THEN 'datetime' ELSE 'categorical' END FROM ({F3}) t"
            for i, c in enumerate(TEXTS)
        ]
    ),
)
def p1(spark, sf):
    return rounded(profiling.column_types(rows(spark, sf, F3)))


F1_COLUMNS = ["id", "status", "price", "priority", "cust", "y"]


@query(
    "p2_missing_and_distinct",
    union([
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing_count,"
        f" CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM ({F1}) t"
        for c in F1_COLUMNS
    ]),
)
def p2(spark, sf):
    return profiling.missing_and_distinct(rows(spark, sf, F1))


@query(
    "p3_numeric_statistics",
    union([
        f"SELECT '{c}' AS column_name, {rd(f'avg({c})', 4)} AS mean, {rd(f'quantile_cont({c}, 0.5)', 4)} AS median,"
        f" {rd(f'stddev_samp({c})', 4)} AS std, {rd(f'min({c})', 4)} AS min, {rd(f'max({c})', 4)} AS max,"
        f" {rd(f'quantile_cont({c}, 0.25)', 4)} AS q25, {rd(f'quantile_cont({c}, 0.75)', 4)} AS q75 FROM ({F1}) t"
        for c in ("price", "cust", "y")
    ]),
)
def p3(spark, sf):
    return rounded(profiling.numeric_statistics(rows(spark, sf, F1), ["price", "cust", "y"]), 4)


def _ranked(column: str, order: str, shown: str, top: int) -> str:
    return (
        f"SELECT {shown} FROM (SELECT '{column}' AS column_name, {column} AS value, CAST(count(*) AS BIGINT) AS n,"
        f" CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position FROM part WHERE {column} IS NOT NULL"
        f" GROUP BY {column}) t WHERE position <= {top}"
    )


@query("p4_top_values", union([_ranked(c, f"count(*) DESC, {c}", "column_name, value, n, position", 10) for c in ("p_brand", "p_type")]))
def p4(spark, sf):
    return rounded(profiling.top_values(table(spark, sf, "part"), ["p_brand", "p_type"]))


@query("p4_modes", union([_ranked(c, f"count(*) DESC, {c}", "column_name, value AS mode", 1) for c in ("p_brand", "p_type", "p_name")]))
def p4b(spark, sf):
    return profiling.modes(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


@query("p4_distinct_values", union([_ranked(c, c, "column_name, position, value", 50) for c in ("p_brand", "p_name")]))
def p4c(spark, sf):
    return rounded(profiling.distinct_values(table(spark, sf, "part"), ["p_brand", "p_name"]))


@query(
    "p5_datetime_statistics",
    union([
        f"SELECT '{c}' AS column_name, CAST(epoch(min(m)) AS BIGINT) AS first_second, CAST(epoch(max(m)) AS BIGINT) AS last_second,"
        f" CAST(floor((epoch(max(m)) - epoch(min(m))) / 86400) AS BIGINT) AS date_range_days"
        f" FROM (SELECT {duck_moment(c)} AS m FROM ({F3}) t) u"
        for c in ("date_90", "date_100")
    ]),
)
def p5(spark, sf):
    found = profiling.datetime_statistics(rows(spark, sf, F3), ["date_90", "date_100"])
    return found.select(
        "column_name", F.unix_seconds("min_date").alias("first_second"), F.unix_seconds("max_date").alias("last_second"),
        "date_range_days",
    )


def _schema_sql(c: str, role: str) -> str:
    sample = ", ".join(
        f"(SELECT CAST({c} AS DOUBLE) FROM ({F2}) t ORDER BY id LIMIT 1 OFFSET {i}) AS sample_{i}" if role == "feature"
        else f"CAST(NULL AS DOUBLE) AS sample_{i}" for i in range(3)
    )
    shape = f"{rd(f'avg({c})')} AS mean, {rd(f'stddev_pop({c})')} AS std" if role == "feature" else "NULL AS mean, NULL AS std"
    return (
        f"SELECT '{c}' AS name, '{role}' AS role, 'numeric' AS type, min({c}) AS low, max({c}) AS high, {shape}, {sample},"
        f" CAST(NULL AS VARCHAR) AS classes FROM ({F2}) t"
    )


@query(
    "p6_training_schema",
    union([
        _schema_sql("size", "feature"), _schema_sql("digit", "feature"), _schema_sql("price", "target"),
        "SELECT 'brand', 'target', 'categorical', NULL, NULL, NULL, NULL, NULL, NULL, NULL, string_agg(b, '|' ORDER BY b)"
        f" FROM (SELECT DISTINCT brand AS b FROM ({F2}) t ORDER BY b LIMIT 50) u",
    ]),
)
def p6(spark, sf):
    found = profiling.training_schema(rows(spark, sf, F2), ["size", "digit"], ["price", "brand"], "id")
    return rounded(found.select(
        "name", "role", "type", "low", "high", "mean", "std",
        *[F.get("samples", F.lit(i)).alias(f"sample_{i}") for i in range(3)], F.array_join("classes", "|").alias("classes"),
    ))


@query(
    "p7_input_requirements",
    union([f"SELECT '{c}' AS column_name, 'numeric' AS type, min({c}) AS min, max({c}) AS max FROM ({F2}) t" for c in ("size", "price")]),
)
def p7(spark, sf):
    frame = rows(spark, sf, F2)
    return profiling.input_requirements(profiling.training_schema(frame, ["size", "price"], ["digit"], "id"))


@query(
    "p8_column_roles",
    """
    SELECT i.column_name, coalesce(o.data_type, i.data_type) AS data_type, coalesce(o.is_target, false) AS is_target,
           coalesce(o.is_excluded, false) AS is_excluded, o.encoding_method
    FROM (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS column_name, CASE WHEN p_partkey % 2 = 0 THEN 'numeric' ELSE 'categorical' END AS data_type FROM part) i
    LEFT JOIN (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS column_name, CASE WHEN p_partkey % 6 = 0 THEN 'categorical' END AS data_type,
                      CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 9 = 0 END AS is_target, p_partkey % 12 = 0 AS is_excluded,
                      CASE WHEN p_partkey % 3 = 0 THEN p_type END AS encoding_method
               FROM part) o ON o.column_name = i.column_name
    """,
)
def p8(spark, sf):
    # one registry row per part stands for the columns of many wide datasets
    left = rows(spark, sf, """SELECT concat('p', p_partkey) AS column_name,
        CASE WHEN p_partkey % 2 = 0 THEN 'numeric' ELSE 'categorical' END AS data_type FROM {part}""")
    right = rows(spark, sf, """SELECT concat('p', p_partkey) AS column_name,
        CASE WHEN p_partkey % 6 = 0 THEN 'categorical' END AS data_type,
        CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 9 = 0 END AS is_target, p_partkey % 12 = 0 AS is_excluded,
        CASE WHEN p_partkey % 3 = 0 THEN p_type END AS encoding_method FROM {part}""")
    return profiling.merge_roles(left, right)


@query(
    "p9_validate_input",
    f"""
    SELECT 'error' AS level, 'missing_column' AS check_name, 'absent' AS column_name, '' AS detail
    UNION ALL SELECT 'warning', 'extra_column', c, '' FROM (VALUES ('id'), ('y')) v(c)
    UNION ALL SELECT 'error', 'type_mismatch', 'status', 'numeric'
    UNION ALL SELECT 'warning', 'type_mismatch', 'cust', 'categorical'
    UNION ALL SELECT 'warning', 'missing_values', 'price', CAST(count(*) - count(price) AS VARCHAR) FROM ({F1}) t
    UNION ALL SELECT 'warning', 'missing_values', 'priority', CAST(count(*) - count(priority) AS VARCHAR) FROM ({F1}) t
    UNION ALL SELECT 'warning', 'missing_values', 'cust', CAST(count(*) - count(cust) AS VARCHAR) FROM ({F1}) t
    """,
)
def p9(spark, sf):
    return profiling.validate_input(
        rows(spark, sf, F1), ["price", "priority", "cust", "status", "absent"],
        {"price": "numeric", "status": "numeric", "cust": "categorical", "priority": "categorical"},
    )
