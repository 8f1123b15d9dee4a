"""Column types, counts and statistics of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import numeric_columns, ref, text_columns
from ..functions.parsing import clean_number, to_moment, to_number
from .lookup import rows_table
from .ordering import exact_quantiles

NUMERIC, CATEGORICAL, DATETIME = "numeric", "categorical", "datetime"


def infer_types(df: DataFrame) -> dict[str, str]:
    """Logical type per column from one aggregate over the text columns.

    A text column is numeric when every value is a number, a datetime when every
    value is a date and some value holds a separator, and categorical otherwise.
    """
    texts = text_columns(df)
    kinds = {}
    if texts:
        row = df.agg(
            *[
                F.struct(
                    F.count(ref(c)).alias("n"),
                    F.count(to_number(ref(c))).alias("numbers"),
                    F.count(to_moment(ref(c))).alias("moments"),
                    F.coalesce(F.bool_or(ref(c).rlike("[-/:]")), F.lit(False)).alias("separated"),
                ).alias(c)
                for c in texts
            ]
        ).first()
        for c in texts:
            seen = row[c]
            if seen.n and seen.numbers == seen.n:
                kinds[c] = NUMERIC
            elif seen.n and seen.moments == seen.n and seen.separated:
                kinds[c] = DATETIME
            else:
                kinds[c] = CATEGORICAL
    for f in df.schema.fields:
        if f.name in kinds:
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds[f.name] = DATETIME
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            kinds[f.name] = NUMERIC
        else:
            kinds[f.name] = CATEGORICAL
    return {c: kinds[c] for c in df.columns}


def column_types(df: DataFrame) -> DataFrame:
    rows = [(c, i, k) for i, (c, k) in enumerate(infer_types(df).items())]
    return rows_table(df.sparkSession, rows, "column_name string, column_index int, data_type string")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) for all columns in one shuffle, nulls left out."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), ref(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )


def missing_and_distinct(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, missing_count, unique_count); NaN counts as missing."""
    columns = list(columns or df.columns)
    cleaned = df.select(
        *[
            (clean_number(ref(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else ref(f.name)).alias(f.name)
            for f in df.schema.fields
            if f.name in columns
        ]
    )
    if not exact:
        row = cleaned.agg(
            F.count("*").alias("_rows"),
            *[F.struct(F.count(ref(c)).alias("n"), F.approx_count_distinct(ref(c)).alias("d")).alias(c) for c in columns],
        ).first()
        rows = [(c, row["_rows"] - row[c].n, row[c].d) for c in columns]
        return rows_table(df.sparkSession, rows, "column_name string, missing_count long, unique_count long")
    # the row count rides along as a constant column so that one shuffle gives both numbers
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), ref(c).cast("string").alias("value")) for c in columns]
    )
    counts = cleaned.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    found = counts.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
    )
    return found


def numeric_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, median, sample deviation, min, max and quartiles per numeric column."""
    columns = list(columns or numeric_columns(df))
    value = {
        c: to_number(ref(c)) if isinstance(df.schema[c].dataType, T.StringType) else clean_number(ref(c))
        for c in columns
    }
    row = df.agg(
        *[
            F.struct(
                F.avg(value[c]).alias("mean"),
                F.stddev_samp(value[c]).alias("std"),
                F.min(value[c]).alias("min"),
                F.max(value[c]).alias("max"),
            ).alias(c)
            for c in columns
        ]
    ).first()
    quartiles = exact_quantiles(df, value, [0.25, 0.5, 0.75])
    rows = [
        (c, row[c].mean, quartiles[c][1], row[c].std, row[c].min, row[c].max, quartiles[c][0], quartiles[c][2])
        for c in columns
    ]
    return rows_table(
        df.sparkSession,
        rows,
        "column_name string, mean double, median double, std double, min double, max double, q25 double, q75 double",
    )


def top_values(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Most frequent values per column; equal counts go by value."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    ranked = value_counts(df, columns).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= top)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return top_values(df, columns, 1).select("column_name", F.col("value").alias("mode"))


def distinct_values(df: DataFrame, columns: Sequence[str], first: int = 50) -> DataFrame:
    """First distinct values of each column in value order."""
    order = Window.partitionBy("column_name").orderBy("value")
    ranked = value_counts(df, columns).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= first).select("column_name", "position", "value")


def moment_of(df: DataFrame, column: str):
    c = ref(column)
    return to_moment(c) if isinstance(df.schema[column].dataType, T.StringType) else c.cast("timestamp")


def datetime_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Earliest and latest moment and the whole days between them."""
    parts = F.array(
        *[F.struct(F.lit(c).alias("column_name"), moment_of(df, c).alias("moment")) for c in columns]
    )
    spread = F.unix_seconds("max_date") - F.unix_seconds("min_date")
    return (
        df.select(F.inline(parts))
        .groupBy("column_name")
        .agg(F.min("moment").alias("min_date"), F.max("moment").alias("max_date"))
        .select("column_name", "min_date", "max_date", F.floor(spread / 86400).cast("bigint").alias("date_range_days"))
    )


def training_schema(df: DataFrame, features: Sequence[str], targets: Sequence[str], key: str) -> DataFrame:
    """Range, mean, population deviation and three samples per feature; range or classes per target."""
    numeric_targets = [t for t in targets if t in numeric_columns(df)]
    class_targets = [t for t in targets if t not in numeric_targets]
    measured = [*features, *numeric_targets]
    row = df.agg(
        *[
            F.struct(
                F.min(clean_number(ref(c))).alias("low"),
                F.max(clean_number(ref(c))).alias("high"),
                F.avg(clean_number(ref(c))).alias("mean"),
                F.stddev_pop(clean_number(ref(c))).alias("std"),
            ).alias(c)
            for c in measured
        ]
    ).first()
    head = df.orderBy(ref(key)).select(*[ref(c).cast("double") for c in features]).take(3)
    rows = []
    for c in features:
        s = row[c]
        rows.append((c, "feature", NUMERIC, s.low, s.high, s.mean, s.std, [r[c] for r in head], None))
    for c in numeric_targets:
        rows.append((c, "target", NUMERIC, row[c].low, row[c].high, None, None, None, None))
    if class_targets:
        classes: dict[str, list[str]] = {c: [] for c in class_targets}
        for r in distinct_values(df, class_targets, 50).orderBy("column_name", "position").collect():
            classes[r.column_name].append(r.value)
        rows += [(c, "target", CATEGORICAL, None, None, None, None, None, classes[c]) for c in class_targets]
    return rows_table(
        df.sparkSession,
        rows,
        "name string, role string, type string, low double, high double, mean double, std double,"
        " samples array<double>, classes array<string>",
    )


def input_requirements(schema: DataFrame) -> DataFrame:
    """Minimum and maximum constraint of every feature in a training schema."""
    return schema.where(F.col("role") == "feature").select(
        F.col("name").alias("column_name"), F.col("type"), F.col("low").alias("min"), F.col("high").alias("max")
    )


def merge_roles(inferred: DataFrame, overrides: DataFrame) -> DataFrame:
    """Column roles after the user's overrides; a declared ``categorical`` survives re-inference."""
    left, right = inferred.alias("i"), overrides.alias("o")
    return left.join(right, "column_name", "left").select(
        "column_name",
        F.coalesce("o.data_type", "i.data_type").alias("data_type"),
        F.coalesce("o.is_target", F.lit(False)).alias("is_target"),
        F.coalesce("o.is_excluded", F.lit(False)).alias("is_excluded"),
        F.col("o.encoding_method").alias("encoding_method"),
    )


def validate_input(df: DataFrame, required: Sequence[str], types: dict[str, str]) -> DataFrame:
    """Findings (level, check, column_name, detail) about rows offered to a model."""
    findings = [("error", "missing_column", c, "") for c in required if c not in df.columns]
    findings += [("warning", "extra_column", c, "") for c in df.columns if c not in required]
    numeric = set(numeric_columns(df))
    texts = set(text_columns(df))
    for c, expected in types.items():
        if c not in df.columns:
            continue
        if expected == NUMERIC and c not in numeric:
            findings.append(("error", "type_mismatch", c, NUMERIC))
        if expected == CATEGORICAL and c not in texts:
            findings.append(("warning", "type_mismatch", c, CATEGORICAL))
    present = [c for c in required if c in df.columns]
    if present:
        counts = df.agg(*[F.count_if(ref(c).isNull()).alias(c) for c in present]).first()
        findings += [("warning", "missing_values", c, str(counts[c])) for c in present if counts[c]]
    return rows_table(
        df.sparkSession, findings, "level string, check_name string, column_name string, detail string"
    )
