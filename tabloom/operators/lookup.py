"""Joining a large table to a per-key table that may be small, large or skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ref

BROADCAST_ROWS = 200_000
HOT_SHARE = 1000


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return table.limit(rows + 1).count() <= rows


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    rows: int = BROADCAST_ROWS,
    size: int | None = None,
) -> DataFrame:
    """Left join ``df`` to ``table`` (one row per ``key``) on ``key``.

    ``weight`` is the column of ``table`` that counts the rows of each key in the
    data it was fitted on. A table within ``rows`` is broadcast. Beyond that, keys
    with at least a thousandth of all rows (no more than a thousand keys) are
    broadcast, and only the rest is shuffled; rows that already matched, or have
    no key, are spread over random partitions so that none becomes hot. ``size`` is the
    row count of ``table`` where it is known from fitting; else it is counted here.
    """
    values = [c for c in table.columns if c != key]
    if (fits_broadcast(table, rows) if size is None else size <= rows):
        return df.join(F.broadcast(table), key, "left")
    total = table.agg(F.sum(ref(weight))).first()[0]
    is_hot = ref(weight) * HOT_SHARE >= F.lit(total)
    hot = table.where(is_hot).select(
        ref(key).alias("_hot_key"), *[ref(c).alias(f"_hot_{c}") for c in values]
    )
    cold = table.where(~is_hot).select(
        ref(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), *[ref(c).alias(f"_cold_{c}") for c in values]
    )
    near = df.join(F.broadcast(hot), ref(key) == F.col("_hot_key"), "left")
    done = F.col("_hot_key").isNotNull() | ref(key).isNull()
    salted = near.withColumn(
        "_salt", F.when(done, 1 + F.xxhash64(*[ref(c) for c in df.columns]) % 100_000).otherwise(0)
    ).withColumn("_probe", F.when(done, F.lit(None)).otherwise(ref(key)))
    # rows that are done carry a non-null salt, so they hash to many partitions
    far = salted.join(
        cold, (F.col("_probe") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left"
    )
    return far.select(
        *[ref(c) for c in df.columns],
        *[
            F.when(F.col("_hot_key").isNotNull(), ref(f"_hot_{c}")).otherwise(ref(f"_cold_{c}")).alias(c)
            for c in values
        ],
    )


def constant(columns: dict[str, object]) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in columns.items()]


def rows_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small driver-side findings as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)
