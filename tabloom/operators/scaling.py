"""Standard, min-max and robust scaling and their inverses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, ref, replace_columns
from ..functions.parsing import clean_number
from .lookup import rows_table
from .ordering import exact_quantiles


@dataclass
class Scaler:
    """x becomes (x - centre) / spread; a spread of zero counts as one."""

    method: str
    role: str = "features"
    parameters: dict[str, tuple[float, float]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return replace_columns(
            df,
            {
                c: (clean_number(ref(c)) - F.lit(centre)) / F.lit(spread)
                for c, (centre, spread) in self.parameters.items()
                if c in df.columns
            },
        )

    def invert(self, df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
        """Back to original units; ``names`` maps a column of ``df`` to the fitted one."""
        names = names or {c: c for c in self.parameters if c in df.columns}
        new = {}
        for c, fitted in names.items():
            centre, spread = self.parameters[fitted]
            new[c] = ref(c) * F.lit(spread) + F.lit(centre)
        return replace_columns(df, new)

    def then(self, later: Scaler | None, column: str) -> Scaler:
        """One scaler for ``column`` that does the work of this one and a later one."""
        centre, spread = self.parameters[column]
        if later is not None and column in later.parameters:
            more, wider = later.parameters[column]
            centre, spread = centre + spread * more, spread * wider
        return Scaler(self.method, self.role, {column: (centre, spread)})

    def table(self, spark) -> DataFrame:
        rows = [(self.role, self.method, c, a, b) for c, (a, b) in self.parameters.items()]
        return rows_table(spark, rows, "role string, method string, column_name string, center double, scale double")


def fit_scaler(
    df: DataFrame,
    method: str = "standard",
    columns: Sequence[str] | None = None,
    role: str = "features",
    categorical: Sequence[str] = (),
) -> Scaler:
    columns = numeric_columns(df, columns, categorical)
    value = {c: clean_number(ref(c)) for c in columns}
    pairs: dict[str, tuple[float, float]] = {}
    if not columns:
        return Scaler(method, role)
    if method == "robust":
        for c, (q25, mid, q75) in exact_quantiles(df, value, [0.25, 0.5, 0.75]).items():
            pairs[c] = (mid, None if mid is None else q75 - q25)
    elif method in ("standard", "minmax"):
        first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        row = df.agg(
            *[F.struct(first(value[c]).alias("a"), second(value[c]).alias("b")).alias(c) for c in columns]
        ).first()
        for c in columns:
            a, b = row[c]
            pairs[c] = (a, b if method == "standard" or a is None else b - a)
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    usable = {c: (a, b or 1.0) for c, (a, b) in pairs.items() if a is not None}
    return Scaler(method, role, usable)


def fit_scalers(
    df: DataFrame, method: str, features: Sequence[str], targets: Sequence[str] = ()
) -> list[Scaler]:
    """Separate parameters for features and numeric targets."""
    plain = [c for c in features if c not in targets]
    fitted = [fit_scaler(df, method, plain)]
    if targets:
        fitted.append(fit_scaler(df, method, targets, role="target"))
    return fitted
