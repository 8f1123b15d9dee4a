"""Column references and column-name matching."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.NumericType, T.BooleanType)


def ref(name: str) -> Column:
    """Reference a column whose name may hold dots, spaces or parentheses."""
    return F.col("`" + name.replace("`", "``") + "`")


def normal_name(name: str) -> str:
    """Spaces and underscores are the same in a column name."""
    return name.strip().replace(" ", "_")


def loose_name(name: str) -> str:
    """Ignore case, spaces, underscores and parentheses."""
    return re.sub(r"[\s_()]", "", name).lower()


def match_names(present: Sequence[str], wanted: Iterable[str]) -> dict[str, str]:
    """Map present column names to wanted ones, exact first, then by looser spelling."""
    free = [c for c in present]
    mapping: dict[str, str] = {}
    missing = []
    for name in wanted:
        if name in free:
            mapping[name] = name
            free.remove(name)
        else:
            missing.append(name)
    for spelling in (normal_name, loose_name):
        left = []
        for name in missing:
            hit = next((c for c in free if spelling(c) == spelling(name)), None)
            if hit is None:
                left.append(name)
            else:
                mapping[hit] = name
                free.remove(hit)
        missing = left
    return mapping


def rename_to(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rename columns to the wanted spelling; other columns stay as they are."""
    mapping = match_names(df.columns, wanted)
    return df.select(*[ref(c).alias(mapping.get(c, c)) for c in df.columns])


def numeric_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    categorical: Sequence[str] = (),
) -> list[str]:
    """Numeric columns among the requested ones, without those declared categorical."""
    declared = {c.strip() for c in categorical}
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NUMERIC_TYPES)
        and (columns is None or f.name in columns)
        and f.name.strip() not in declared
    ]


def text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns in place and appends new ones."""
    kept = [new[c].alias(c) if c in new else ref(c) for c in df.columns]
    added = [e.alias(c) for c, e in new.items() if c not in df.columns]
    return df.select(*kept, *added)
