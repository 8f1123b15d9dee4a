"""Date texts to epoch seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ref, replace_columns, text_columns
from ..functions.parsing import epoch_seconds, to_moment

MIN_SHARE = 0.8
MAX_TEXT = 100


def date_columns(df: DataFrame, categorical: Sequence[str] = ()) -> list[str]:
    """Text columns of which more than 80 % of the values are dates.

    Columns of which that share no longer holds without the texts above 100 characters
    and the values made only of digits and dots are left alone: those are long texts and
    plain numbers. A stray one among dates becomes null like any text that is no date.
    """
    texts = [c for c in text_columns(df) if c not in categorical]
    if not texts:
        return []
    row = df.agg(
        *[
            F.struct(
                F.count(ref(c)).alias("n"),
                F.count(
                    F.when((F.length(ref(c)) <= MAX_TEXT) & ~ref(c).rlike(r"^[0-9.]+$"), to_moment(ref(c)))
                ).alias("moments"),
            ).alias(c)
            for c in texts
        ]
    ).first()
    return [c for c in texts if row[c].n and row[c].moments / row[c].n > MIN_SHARE]


def to_epoch(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace date texts by epoch seconds; texts that are no date become null."""
    return replace_columns(df, {c: epoch_seconds(to_moment(ref(c))) for c in columns})


def convert_dates(df: DataFrame, categorical: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    found = date_columns(df, categorical)
    return to_epoch(df, found), found
