"""Filling and dropping missing values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import numeric_columns, ref, replace_columns
from ..functions.parsing import clean_number, nan_to_null
from ..sources.shared import release, settle
from .lookup import rows_table
from .neighbors import nearest
from .ordering import exact_quantiles

NUMERIC_FILLS = ("mean", "median", "mode", "most_frequent")


def check_target(df: DataFrame, target: str) -> None:
    """A missing target cannot be filled, so it is an error."""
    missing = df.agg(F.count_if(ref(target).isNull())).first()[0]
    if missing:
        raise ValueError(f"target column {target!r} has {missing} missing values")


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(ref(c).isNull()).alias(c) for c in columns]).first()
    return rows_table(df.sparkSession, [(c, row[c]) for c in columns], "column_name string, missing_count long")


def missing_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per processed column before and after."""
    left = missing_counts(before, columns).withColumnRenamed("missing_count", "missing_before")
    right = missing_counts(after, [c for c in columns if c in after.columns])
    return left.join(right.withColumnRenamed("missing_count", "missing_after"), "column_name")


@dataclass
class Filler:
    """Fill values per column; applying it is one projection."""

    strategy: str
    values: dict[str, object] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, v in self.values.items():
            if c not in df.columns or v is None:
                continue
            kind = df.schema[c].dataType
            # an average must not be cut back to a whole number
            widened = isinstance(kind, T.IntegralType) and isinstance(v, float)
            base = clean_number(ref(c)) if widened or isinstance(kind, T.FractionalType) else ref(c)
            new[c] = F.coalesce(base, F.lit(v) if widened else F.lit(v).cast(kind if not isinstance(kind, T.FractionalType) else "double"))
        return replace_columns(df, new)

    def table(self, spark) -> DataFrame:
        rows = [(c, self.strategy, None if v is None else str(v)) for c, v in self.values.items()]
        return rows_table(spark, rows, "column_name string, strategy string, fill_value string")


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, lowest value on ties.

    ``mode`` keeps every distinct value in one task; counting by value first keeps
    that table distributed.
    """
    found = {}
    for c in columns:
        top = (
            df.where(ref(c).isNotNull()).groupBy(ref(c).alias("v")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc("v")).first()
        )
        found[c] = None if top is None else top.v
    return found


def fit_filler(
    df: DataFrame,
    strategy: str,
    columns: Sequence[str] | None = None,
    target: str | None = None,
    fill_value: object = None,
    categorical: Sequence[str] = (),
) -> Filler:
    """Fill values for mean, median, most frequent or constant.

    Text columns (and numbers declared categorical) take their most frequent value.
    A column without any value is left null.
    """
    chosen = [c for c in (columns or df.columns) if c != target]
    if strategy == "constant":
        return Filler(strategy, {c: fill_value for c in chosen})
    numeric = [] if strategy not in NUMERIC_FILLS else numeric_columns(df, chosen, categorical)
    other = [c for c in chosen if c not in numeric]
    values: dict[str, object] = {}
    if strategy == "mean" and numeric:
        row = df.agg(*[F.avg(clean_number(ref(c))).alias(c) for c in numeric]).first()
        values = row.asDict()
    elif strategy == "median" and numeric:
        values = {c: q[0] for c, q in exact_quantiles(df, {c: ref(c) for c in numeric}, [0.5]).items()}
    elif strategy in ("mode", "most_frequent"):
        values = most_frequent(nan_to_null(df), numeric)
    elif strategy not in NUMERIC_FILLS:
        raise ValueError(f"unknown strategy {strategy!r}")
    values.update(most_frequent(df, other))
    return Filler(strategy, values)


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    return df.dropna(subset=[c for c in (columns or df.columns) if c != target])


def fill_by_neighbors(df: DataFrame, key: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Fill each gap with the mean of the k nearest rows that hold a value there.

    The distance uses the columns both rows have, scaled up by the share of columns
    they lack. Rows are grouped by which columns they hold: within one pair of such
    patterns the shared columns are fixed, so the distance is plain Euclidean times a
    constant and the exact neighbour join applies. Gaps without any comparable donor
    get the column mean.
    """
    columns = list(columns)
    numbers = df.select(ref(key).alias("_key"), *[clean_number(ref(c)).alias(c) for c in columns])
    pattern = F.concat(*[F.when(ref(c).isNull(), "0").otherwise("1") for c in columns])
    marked = settle(numbers.withColumn("_has", pattern), "gaps")
    patterns = [r[0] for r in marked.select("_has").distinct().collect()]
    means = marked.agg(*[F.avg(ref(c)).alias(c) for c in columns]).first()
    candidates = None
    for gaps in (p for p in patterns if "0" in p):
        for donors in patterns:
            shared = [c for c, a, b in zip(columns, gaps, donors) if a == b == "1"]
            offered = [c for c, a, b in zip(columns, gaps, donors) if a == "0" and b == "1"]
            if not shared or not offered:
                continue
            hits = nearest(
                marked.where(F.col("_has") == gaps),
                marked.where(F.col("_has") == donors),
                "_key",
                shared,
                k,
                carry=offered,
            )
            scale = (len(columns) / len(shared)) ** 0.5
            given = F.array(
                *[F.struct(F.lit(c).alias("column_name"), ref(c).alias("value")) for c in offered]
            )
            found = hits.select(
                "left_key", "right_key", (F.col("distance") * scale).alias("distance"), F.inline(given)
            )
            candidates = found if candidates is None else candidates.unionByName(found)
    filled = df
    if candidates is not None:
        order = Window.partitionBy("left_key", "column_name").orderBy("distance", "right_key")
        best = candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        averages = (
            best.groupBy("left_key")
            .agg(*[F.avg(F.when(F.col("column_name") == c, F.col("value"))).alias(f"_fill_{c}") for c in columns])
        )
        filled = df.join(averages, ref(key) == F.col("left_key"), "left")
    new = {}
    for c in columns:
        parts = [clean_number(ref(c))]
        if candidates is not None:
            parts.append(ref(f"_fill_{c}"))
        if means[c] is not None:
            parts.append(F.lit(means[c]))
        new[c] = F.coalesce(*parts)
    return filled.select(*[new[c].alias(c) if c in new else ref(c) for c in df.columns])


def fill_by_trees(
    df: DataFrame, key: str, columns: Sequence[str], rounds: int = 10, trees: int = 100,
    tolerance: float = 1e-3, seed: int = 42,
) -> DataFrame:
    """Fill gaps by random-forest regressions on the other columns, round after round.

    Gaps start from column means; the fewest-gaps column goes first; the loop stops
    when the filled values move less than ``tolerance`` times the largest value.
    """
    columns = list(columns)
    base = settle(nan_to_null(df).select(
        ref(key), *[clean_number(ref(c)).alias(c) for c in columns],
        *[ref(c).isNull().alias(f"_gap_{c}") for c in columns],
    ), "trees")
    facts = base.agg(
        *[F.avg(ref(c)).alias(c) for c in columns],
        *[F.count_if(ref(f"_gap_{c}")).alias(f"_gap_{c}") for c in columns],
        *[F.max(F.abs(ref(c))).alias(f"_top_{c}") for c in columns],
    ).first()
    usable = [c for c in columns if facts[c] is not None]
    state = replace_columns(base, {c: F.coalesce(ref(c), F.lit(facts[c])) for c in usable})
    gappy = sorted((c for c in usable if facts[f"_gap_{c}"]), key=lambda c: facts[f"_gap_{c}"])
    scale = max((facts[f"_top_{c}"] for c in usable), default=0.0)
    owned = base
    for _ in range(rounds if gappy else 0):
        start = state
        for c in gappy:
            inputs = [o for o in usable if o != c]
            if not inputs:
                continue
            packed = VectorAssembler(inputCols=inputs, outputCol="_x").transform(state)
            model = RandomForestRegressor(
                featuresCol="_x", labelCol=c, predictionCol="_p", numTrees=trees, seed=seed
            ).fit(packed.where(~ref(f"_gap_{c}")))
            scored = model.transform(packed)
            state = scored.select(
                *[
                    F.when(ref(f"_gap_{c}"), F.col("_p")).otherwise(ref(c)).alias(c) if o == c else ref(o)
                    for o in base.columns
                ]
            )
        state = settle(state, "trees")
        both = state.alias("n").join(start.alias("o"), key)
        moved = both.agg(
            *[F.max(F.abs(F.col(f"n.`{c}`") - F.col(f"o.`{c}`"))).alias(c) for c in gappy]
        ).first()
        release(owned)
        owned = state
        if max(moved) < tolerance * scale:
            break
    rest = [c for c in df.columns if c not in columns and c != key]
    return df.select(ref(key), *[ref(c) for c in rest]).join(state.select(key, *columns), key).select(*df.columns)
