"""Reproducible pseudo-random numbers derived from row keys.

The md5 of ``seed|key`` gives the same bucket in any engine and in any
partitioning, so splits, folds and samples never depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 16**8


def seeded_hash(key: Column, seed: int | str = 42) -> Column:
    """Integer in [0, 2^32) from the first eight hex digits of the md5."""
    text = F.concat(F.lit(f"{seed}|"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column, buckets: int, seed: int | str = 42) -> Column:
    return seeded_hash(key, seed) % F.lit(buckets)


def hash_share(key: Column, seed: int | str = 42) -> Column:
    """Number in [0, 1)."""
    return seeded_hash(key, seed) / F.lit(float(HASH_RANGE))


def hash_feature(text: Column, buckets: int) -> tuple[Column, Column]:
    """Bucket and sign (+1 or -1) of a category for feature hashing."""
    digest = F.md5(text)
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)
    odd = F.conv(F.substring(digest, 9, 1), 16, 10).cast("bigint") % F.lit(2)
    return bucket, F.when(odd == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
