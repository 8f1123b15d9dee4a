"""Reproducible train/test splits and folds from key hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE, hash_bucket, seeded_hash
from ..functions.names import ref
from .ordering import running_totals


def _trains(key: str, test_size: float, seed: int) -> Column:
    """Whether the row's hash lies in the train share; the share is as fine as the hash."""
    return seeded_hash(ref(key), seed) < F.lit((1 - test_size) * HASH_RANGE)


def with_part(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, name: str = "part") -> DataFrame:
    return df.withColumn(name, F.when(_trains(key, test_size, seed), "train").otherwise("test"))


def train_test(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    trains = _trains(key, test_size, seed)
    return df.where(trains), df.where(~trains)


def with_fold(
    df: DataFrame, key: str, folds: int = 5, label: str | None = None, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Fold number per row.

    With a label the rows of each class are ranked by their hash and dealt out in turn,
    so a class has the same number of rows in every fold, or one more.
    """
    if label is None:
        return df.withColumn(name, hash_bucket(ref(key).cast("string"), folds, seed).cast("int"))
    text = F.concat_ws("|", ref(label).cast("string"), ref(key).cast("string"))
    own = F.coalesce(ref(label).cast("string"), F.lit(""))  # rows without a label are a class
    placed = df.withColumn("_class", own).withColumn("_place", seeded_hash(text, seed)).withColumn("_one", F.lit(1))
    ranked = running_totals(placed, ["_place", key], {"_rank": "_one"}, by=["_class"])
    return ranked.withColumn(name, ((F.col("_rank") - 1) % folds).cast("int")).drop("_class", "_place", "_one", "_rank")
