"""Where a dataset comes from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, settle


def newest(datasets: DataFrame) -> DataFrame:
    """One source per id; of several rows with an id the one with the largest source counts."""
    return datasets.groupBy("id").agg(F.max("source_dataset_id").alias("source_dataset_id"))


def lineage_roots(datasets: DataFrame) -> DataFrame:
    """(id, root, depth): the original dataset behind each one and the steps to it.

    Every round doubles the distance covered, so a chain of n steps takes log2(n)
    rounds. A source that is not registered ends its chain; a cycle is an error.
    """
    datasets = newest(datasets)
    rounds = math.ceil(math.log2(datasets.count() + 1)) + 2
    known = datasets.select(F.col("id").alias("up")).distinct()
    start = datasets.select("id", F.col("source_dataset_id").alias("up")).join(
        known.withColumn("_known", F.lit(True)), "up", "left"
    )
    here = F.col("_known").isNotNull()
    state = settle(
        start.select("id", F.when(here, F.col("up")).otherwise(F.col("id")).alias("root"), here.cast("int").alias("depth")),
        "lineage",
    )
    reached = None
    while True:
        total = state.agg(F.sum("depth")).first()[0]
        if total == reached:
            return state
        rounds -= 1
        if rounds < 0:
            raise ValueError("a dataset is its own ancestor")
        reached = total
        above = state.select(F.col("id").alias("root"), F.col("root").alias("top"), F.col("depth").alias("more"))
        new = settle(
            state.join(above, "root").select("id", F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth")),
            "lineage",
        )
        release(state)
        state = new


def lineage_path(datasets: DataFrame, start) -> DataFrame:
    """(id, depth) from a dataset up to its original, each once even in a cycle.

    Every round doubles the part of the path that is known, so it may have any length.
    """
    registered = newest(datasets)
    jump = settle(
        registered.select("id", F.col("source_dataset_id").alias("up"))
        .join(registered.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"), "jumps",
    )
    path = settle(registered.where(F.col("id") == F.lit(start)).select("id", F.lit(0).alias("depth")), "path")
    length, step = path.count(), 1
    while length:
        further = path.join(jump, "id").select(F.col("up").alias("id"), (F.col("depth") + step).alias("depth"))
        new = settle(path.unionByName(further).groupBy("id").agg(F.min("depth").alias("depth")), "path")
        release(path)
        path, known, length = new, length, new.count()
        if length == known:
            break
        twice = settle(
            jump.select("id", F.col("up").alias("middle")).join(jump.select(F.col("id").alias("middle"), "up"), "middle")
            .select("id", "up"), "jumps",
        )
        release(jump)
        jump, step = twice, 2 * step
    release(jump)
    return path


def inherited_components(path: DataFrame, components: DataFrame) -> DataFrame:
    """Components (dataset_id, position, ...) of all datasets on a path, in the order they were applied."""
    steps = path.select(F.col("id").alias("dataset_id"), "depth")
    return components.join(steps, "dataset_id").orderBy(F.desc("depth"), F.asc("position"))
