"""Datasets, columns, models and predictions as append-only tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import ref

SCHEMAS = {
    "datasets": "id string, name string, path string, format string, row_count long, column_count int,"
    " source_dataset_id string, created double",
    "columns": "dataset_id string, column_name string, column_index int, data_type string, is_target boolean,"
    " is_excluded boolean, encoding_method string, missing_count long, unique_count long, created double",
    "models": "id string, dataset_id string, algorithm string, parameters string, metrics string, path string,"
    " created double",
    "predictions": "id string, model_id string, input_dataset_id string, path string, row_count long, created double",
    "history": "dataset_id string, position int, operation string, info string, created double",
    "tuning": "id string, algorithm string, method string, best_parameters string, best_score double, trials int,"
    " created double",
}


class Registry:
    """Tables under one shared folder; every change is an appended row."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: Sequence[dict]) -> list[str]:
        """Add rows; an id and a time are given where missing."""
        names = [part.split()[0] for part in SCHEMAS[name].split(",")]
        ids, out = [], []
        for r in rows:
            full = {"id": uuid.uuid4().hex, "created": time.time(), **r}
            ids.append(full["id"])
            out.append(tuple(full.get(n) for n in names))
        self.spark.createDataFrame(out, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        return ids

    def add_dataset(self, df: DataFrame, name: str, path: str, fmt: str, source: str | None = None) -> str:
        """Register a written dataset with its profile; roles come over from its source."""
        from ..operators.profiling import column_types, merge_roles, missing_and_distinct

        counts = {r.column_name: r for r in missing_and_distinct(df).collect()}
        found = column_types(df)
        if source is not None:
            latest = Window.partitionBy("column_name").orderBy(F.desc("created"))
            roles = self.table("columns").where(F.col("dataset_id") == source)
            roles = roles.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
            # only a declared 'categorical' outlives a new inference
            kept = F.when(F.col("data_type") == "categorical", F.col("data_type"))
            merged = merge_roles(found, roles.withColumn("data_type", kept))
            found = found.drop("data_type").join(merged, "column_name", "left")
        dataset = self.append(
            "datasets",
            [{
                "name": name, "path": path, "format": fmt, "row_count": df.count(), "column_count": len(df.columns),
                "source_dataset_id": source,
            }],
        )[0]
        rows = []
        for r in found.collect():
            d = r.asDict()
            c = counts.get(d["column_name"])
            rows.append({
                "is_target": False, "is_excluded": False, **{k: v for k, v in d.items() if v is not None},
                "dataset_id": dataset, "missing_count": c.missing_count if c else 0, "unique_count": c.unique_count if c else 0,
            })
        self.append("columns", rows)
        return dataset

    def record_step(self, dataset: str, position: int, operation: str, info: str) -> None:
        self.append("history", [{"dataset_id": dataset, "position": position, "operation": operation, "info": info}])


def history(table: DataFrame, dataset: str) -> DataFrame:
    return table.where(F.col("dataset_id") == dataset).orderBy("position")


def newest(table: DataFrame, order: str = "created", limit: int | None = None, **equal: object) -> DataFrame:
    """Rows newest first, optionally of one kind and limited."""
    for c, v in equal.items():
        table = table.where(ref(c) == F.lit(v))
    ordered = table.orderBy(ref(order).desc())
    return ordered if limit is None else ordered.limit(limit)


def unused_derived(datasets: DataFrame, models: DataFrame, predictions: DataFrame) -> DataFrame:
    """Derived datasets that no model, prediction or other dataset uses."""
    derived = datasets.where(F.col("source_dataset_id").isNotNull())
    used = (
        models.select(F.col("dataset_id").alias("id"))
        .unionByName(predictions.select(F.col("input_dataset_id").alias("id")))
        .unionByName(datasets.select(F.col("source_dataset_id").alias("id")))
        .where(F.col("id").isNotNull()).distinct()
    )
    return derived.join(used, "id", "left_anti")


def orphan_predictions(predictions: DataFrame, models: DataFrame) -> DataFrame:
    known = models.select(F.col("id").alias("model_id")).distinct()
    return predictions.join(known, "model_id", "left_anti")


def unreferenced_files(
    files: DataFrame, referenced: DataFrame, live_folders: DataFrame, now: float, protect_seconds: float = 3600.0
) -> DataFrame:
    """Files (path, folder, modified) that nothing refers to and that are older than the protected span.

    ``referenced`` lists paths in use, ``live_folders`` folders that live models protect.
    A report only: nothing is deleted.
    """
    old = files.where(F.lit(now) - F.col("modified") >= protect_seconds)
    names = referenced.select(F.element_at(F.split("path", "/"), -1).alias("_name")).distinct()
    return (
        old.withColumn("_name", F.element_at(F.split("path", "/"), -1))
        .join(names, "_name", "left_anti")
        .join(live_folders.select("folder").distinct(), "folder", "left_anti")
        .select("path", "folder", "modified")
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, modified, bytes) of all files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(
        "path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"),
        F.unix_timestamp("modificationTime").cast("double").alias("modified"), F.col("length").alias("bytes"),
    )


def can_delete(datasets: DataFrame, models: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, model_uses, prediction_uses, deletable): a dataset in use must stay."""
    m = models.groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("model_uses"))
    p = predictions.groupBy(F.col("input_dataset_id").alias("id")).agg(F.count("*").alias("prediction_uses"))
    out = datasets.select("id").join(m, "id", "left").join(p, "id", "left")
    out = out.select("id", F.coalesce("model_uses", F.lit(0)).alias("model_uses"), F.coalesce("prediction_uses", F.lit(0)).alias("prediction_uses"))
    return out.withColumn("deletable", (F.col("model_uses") + F.col("prediction_uses")) == 0)
