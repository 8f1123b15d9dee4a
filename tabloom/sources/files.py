"""Datasets in CSV, JSON and Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ref
from ..functions.parsing import clean_number, nan_to_null, to_number

FORMATS = ("csv", "json", "parquet")

# Name endings that a derived dataset's name drops.
DERIVED_SUFFIXES = (
    "_missing_handled", "_encoded", "_scaled", "_outliers_handled", "_features_selected", "_processed",
    "_处理后的数据集",
)


def file_format(path: str) -> str:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"unsupported file format: {path!r} (supported: {', '.join(FORMATS)})")
    return ending


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """A headed CSV, an array of JSON records (or one per line), or Parquet; NaN becomes null.

    Give a ``schema`` for large CSV or JSON files: inferring one costs a pass.
    """
    fmt = fmt or file_format(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return nan_to_null(reader.option("header", True).option("inferSchema", schema is None).csv(path))
    if fmt == "json":
        return nan_to_null(reader.option("multiLine", True).json(path))
    if fmt == "jsonl":
        return nan_to_null(reader.json(path))
    return nan_to_null(reader.parquet(path))


def from_records(spark: SparkSession, records: Sequence[dict], schema: str | T.StructType | None = None) -> DataFrame:
    """Rows offered as objects; columns missing from an object are null."""
    if schema is None:
        names = list(dict.fromkeys(k for r in records for k in r))
        rows = [tuple(r.get(n) for n in names) for r in records]
        return nan_to_null(spark.createDataFrame(rows, names))
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = [tuple(r.get(f.name) for f in wanted.fields) for r in records]
    return nan_to_null(spark.createDataFrame(rows, wanted))


def write_dataset(df: DataFrame, path: str, fmt: str = "csv", overwrite: bool = False) -> None:
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported file format: {fmt!r}")


def derived_name(name: str) -> str:
    """Name of a processed dataset; known endings do not pile up."""
    while True:
        ending = next((s for s in DERIVED_SUFFIXES if name.endswith(s)), None)
        if ending is None:
            return name + "_processed"
        name = name[: -len(ending)]


def page(df: DataFrame, key: str, number: int = 1, size: int = 100) -> DataFrame:
    """Rows of one page in key order, counted from page 1."""
    return df.orderBy(ref(key)).offset((number - 1) * size).limit(size)


def preview(df: DataFrame, key: str, rows: int = 10) -> DataFrame:
    return df.orderBy(ref(key)).limit(rows)


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Declared types on reload: categorical to text, numeric to a coercing number; nulls stay null."""
    out = []
    for f in df.schema.fields:
        c = ref(f.name)
        kind = types.get(f.name)
        if kind == "categorical":
            c = c.cast("string")
        elif kind == "numeric":
            c = to_number(c) if isinstance(f.dataType, T.StringType) else clean_number(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def result_document(metrics: DataFrame, **facts: object) -> DataFrame:
    """One JSON text with the metrics as a map, beside constant facts."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    extra = [F.lit(v).alias(k) for k, v in sorted(facts.items())]
    body = metrics.agg(entries.alias("metrics")).select(F.to_json(F.struct(*extra, "metrics")).alias("document"))
    return body
