"""Text to number, text to timestamp, NaN to null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import ref

# Accepted spellings of numbers and dates.
NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
CLOCK = r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}" + CLOCK + "$"
SLASH_YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})" + CLOCK + "$"
SLASH_MONTH_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4})" + CLOCK + "$"
MONTH_NAME_FIRST = r"^[A-Z][a-z]{2} \d{1,2},? \d{4}$"
DAY_THEN_MONTH_NAME = r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"


def to_number(c: Column) -> Column:
    """Number held by a text, null when the text is not a number."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def to_moment(c: Column) -> Column:
    """Timestamp held by a text, null when the text has no known date shape."""
    text = F.trim(c)
    iso = (
        F.when(text.rlike(ISO_DATE), text)
        .when(
            text.rlike(SLASH_YEAR_FIRST),
            F.regexp_replace(text, SLASH_YEAR_FIRST, "$1-$2-$3$4"),
        )
        .when(
            text.rlike(SLASH_MONTH_FIRST),
            F.regexp_replace(text, SLASH_MONTH_FIRST, "$3-$1-$2$4"),
        )
    )
    named = (
        F.when(
            text.rlike(MONTH_NAME_FIRST),
            F.try_to_timestamp(F.regexp_replace(text, ",", ""), F.lit("MMM d yyyy")),
        )
        .when(text.rlike(DAY_THEN_MONTH_NAME), F.try_to_timestamp(text, F.lit("d MMM yyyy")))
    )
    return F.coalesce(F.try_to_timestamp(iso), named)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def clean_number(c: Column) -> Column:
    """Double without NaN: a NaN counts as missing everywhere."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~F.isnan(ref(f.name)), ref(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else ref(f.name)
            for f in df.schema.fields
        ]
    )
