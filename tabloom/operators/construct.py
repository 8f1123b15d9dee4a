"""Polynomial and interaction features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, ref
from ..functions.parsing import clean_number


def term_name(term: Sequence[str]) -> str:
    return " ".join(c if n == 1 else f"{c}^{n}" for c, n in Counter(term).items())


@dataclass
class Products:
    """Products of up to ``degree`` columns, fixed when fitted; an absent column makes its products null."""

    columns: list[str]
    degree: int = 2
    interaction_only: bool = False

    @property
    def terms(self) -> list[tuple[str, ...]]:
        pick = combinations if self.interaction_only else combinations_with_replacement
        return [t for d in range(2, self.degree + 1) for t in pick(self.columns, d)]

    def apply(self, df: DataFrame) -> DataFrame:
        value = {c: clean_number(ref(c)) if c in df.columns else F.lit(None).cast("double") for c in self.columns}
        return df.select("*", *[reduce(lambda a, b: a * b, [value[c] for c in t]).alias(term_name(t)) for t in self.terms])

    def inputs(self, wanted: Iterable[str]) -> set[str]:
        made = {term_name(t): t for t in self.terms}
        return {c for w in wanted for c in made.get(w, (w,))}


def polynomial_features(
    df: DataFrame, columns: Sequence[str] | None = None, degree: int = 2, interaction_only: bool = False
) -> DataFrame:
    """Append all products of up to ``degree`` columns; single columns are not repeated."""
    return Products(numeric_columns(df, columns), degree, interaction_only).apply(df)
