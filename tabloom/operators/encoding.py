"""Category encoders: a fitted category table plus a join or projection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_feature, seeded_hash
from ..functions.names import numeric_columns, ref, text_columns
from ..functions.parsing import clean_number, to_number
from ..sources.shared import settle
from .lookup import lookup, rows_table
from .models.base import sized
from .ordering import running_totals

LOCAL_CATEGORIES = 10_000
#: Beyond so many categories a one-hot code is one sparse vector column instead of a column for each.
WIDE_ONE_HOT = 1000
METHODS = ("label", "onehot", "ordinal", "target", "frequency", "binary", "hash")


@dataclass
class Encoder:
    """One fitted encoder.

    ``categories`` holds (category, code, n, mean) with one row per category. Up to
    ``LOCAL_CATEGORIES`` rows it is a driver-side list, beyond that a settled table.
    """

    method: str
    column: str
    names: list[str] | None = None
    size: int = 0
    table: DataFrame | None = None
    options: dict[str, object] = field(default_factory=dict)

    @property
    def sparse(self) -> bool:
        return self.method == "onehot" and bool(self.options.get("sparse"))

    @property
    def bits(self) -> int:
        return max(1, math.ceil(math.log2(self.size))) if self.size > 1 else 1

    @property
    def new_columns(self) -> list[str]:
        if self.sparse:
            return [f"{self.column}_onehot"]
        if self.method == "onehot":
            return [f"{self.column}_{c}" for c in self.names]
        if self.method == "binary":
            return [f"{self.column}_bin_{i}" for i in range(self.bits)]
        if self.method == "hash":
            return [f"{self.column}_hash_{i}" for i in range(self.options["n_features"])]
        return [self.column]

    def apply(self, df: DataFrame) -> DataFrame:
        """Replace the column by its encoding; new columns stand where it stood."""
        text = ref(self.column).cast("string")
        if self.method == "hash":
            return self._swap(df, self._hashed(text))
        if self.method == "onehot" and not self.sparse:
            return self._swap(df, self._hot(text))
        probe = df.select(*[ref(c) for c in df.columns], text.alias("category"))
        joined = lookup(probe, self.table, "category", "n", size=self.size)
        if self.sparse:
            return self._swap(self._vectors(joined), [sized(F.col("_hot"), self.new_columns[0], self.size)], df.columns)
        return self._swap(joined, self._from_code(), df.columns)

    def _swap(self, df: DataFrame, new: list[Column], columns: Sequence[str] | None = None) -> DataFrame:
        out: list[Column] = []
        for c in columns or df.columns:
            out += new if c == self.column else [ref(c)]
        return df.select(*out)

    def _hashed(self, text: Column) -> list[Column]:
        n = self.options["n_features"]
        bucket, sign = hash_feature(text, n)
        return [
            F.when(bucket == i, sign).otherwise(0.0).alias(name) for i, name in enumerate(self.new_columns)
        ]

    def _hot(self, text: Column) -> list[Column]:
        flags = [
            F.when(text == c, 1.0).otherwise(0.0) for c in self.names
        ]
        if self.options.get("handle_unknown", "ignore") == "error":
            known = F.coalesce(text.isin(self.names), F.lit(True))
            flags = [F.when(known, f).otherwise(self._unseen(text)) for f in flags]
        return [f.alias(name) for f, name in zip(flags, self.new_columns)]

    def _vectors(self, df: DataFrame) -> DataFrame:
        """Codes as sparse vectors; null and unseen categories are all zero."""
        code = F.col("code")
        if self.options.get("handle_unknown", "ignore") == "error":
            code = F.when(F.col("category").isNull() | code.isNotNull(), code.cast("double")).otherwise(self._unseen(F.col("category")))
        # fitted on the last code alone, which says how many there are
        last = df.sparkSession.createDataFrame([(float(max(self.size - 1, 0)),)], "_at double")
        coder = OneHotEncoder(inputCols=["_at"], outputCols=["_hot"], handleInvalid="keep", dropLast=True).fit(last)
        return coder.transform(df.withColumn("_at", F.coalesce(code.cast("double"), F.lit(float(self.size)))))

    def _unseen(self, text: Column) -> Column:
        return F.raise_error(F.concat(F.lit(f"unseen category in {self.column}: "), text)).cast("double")

    def _from_code(self) -> list[Column]:
        text, code = F.col("category"), F.col("code")
        if self.method in ("label", "ordinal"):
            kind = "bigint" if self.method == "label" else "double"
            checked = F.when(text.isNull() | code.isNotNull(), code.cast(kind)).otherwise(
                self._unseen(text).cast(kind)
            )
            return [checked.alias(self.column)]
        if self.method == "target":
            smooth, overall = self.options["smoothing"], self.options["global_mean"]
            n, mean = F.col("n"), F.col("mean")
            value = (n * mean + F.lit(smooth * overall)) / (n + F.lit(smooth))
            return [F.coalesce(value, F.lit(overall)).alias(self.column)]
        if self.method == "frequency":
            share = F.col("n") / F.lit(float(self.options["total"])) if self.options["normalize"] else F.col("n").cast("double")
            return [F.coalesce(share, F.lit(0.0)).alias(self.column)]
        place = F.coalesce(code, F.lit(0)).cast("bigint")
        return [
            F.shiftright(place, self.bits - 1 - i).bitwiseAND(F.lit(1)).cast("double").alias(name)
            for i, name in enumerate(self.new_columns)
        ]

    def invert(self, df: DataFrame, column: str | None = None) -> DataFrame:
        """Codes back to categories; target, frequency and hash codes have no inverse."""
        if self.method not in ("label", "onehot", "ordinal", "binary"):
            raise ValueError(f"{self.method} encoding cannot be inverted")
        used = [column or self.column] if self.method in ("label", "ordinal") else self.new_columns
        rest = [c for c in df.columns if c not in used]
        if self.sparse:
            code = F.array_position(vector_to_array(ref(used[0])), F.lit(1.0)) - 1
            code = F.when(code >= 0, code)
        elif self.method == "onehot":
            place = F.array_position(F.array(*[ref(c) for c in used]), F.lit(1.0))
            name = F.when(place > 0, F.element_at(F.array(*[F.lit(c) for c in self.names]), place.cast("int")))
            return df.select(*[ref(c) for c in rest], name.alias(self.column))
        elif self.method == "binary":
            code = sum(
                (ref(c).cast("bigint") * (1 << (self.bits - 1 - i)) for i, c in enumerate(used)), F.lit(0)
            )
            code = F.when(code < self.size, code).otherwise(0)
        else:
            code = F.round(ref(used[0])).cast("bigint")
        back = self.table.select("code", "n", F.col("category").alias("_name"))
        joined = lookup(df.select(*[ref(c) for c in rest], code.alias("code")), back, "code", "n", size=self.size)
        return joined.select(*[ref(c) for c in rest], F.col("_name").alias(column or self.column))

    def mapping(self) -> DataFrame:
        """(category, code) in category order, or in the given order."""
        return self.table.select("category", "code", "n")

    def describe(self) -> tuple:
        return (self.column, self.method, self.new_columns, self.size)


def _target_number(df: DataFrame, target: str) -> Column | None:
    """Numeric form of a target column; None when a text is no number."""
    if target in numeric_columns(df):
        return clean_number(ref(target))
    row = df.agg(F.count(ref(target)).alias("n"), F.count(to_number(ref(target))).alias("k")).first()
    return to_number(ref(target)) if row.n == row.k else None


def fit_encoder(
    df: DataFrame,
    method: str,
    column: str,
    target: str | None = None,
    categories: Sequence[str] | None = None,
    smoothing: float = 0.0,
    normalize: bool = False,
    n_features: int = 8,
    handle_unknown: str = "ignore",
    sparse: bool | None = None,
    local_categories: int = LOCAL_CATEGORIES,
) -> Encoder:
    if method not in METHODS:
        raise ValueError(f"unknown encoding {method!r}")
    if method == "hash":
        return Encoder(method, column, options={"n_features": n_features})
    spark = df.sparkSession
    goal = F.lit(None).cast("double")
    if method == "target":
        goal = _target_number(df, target)
        if goal is None:
            # a text target that is no number is replaced by its label codes
            coder = fit_encoder(df, "label", target)
            df = coder.apply(df)
            goal = ref(target).cast("double")
    rows = df.select(ref(column).cast("string").alias("category"), goal.alias("y"))
    counted = rows.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean")
    )
    found = counted.limit(local_categories + 1).collect()
    schema = "category string, code long, n long, mean double"
    options: dict[str, object] = {}
    if len(found) <= local_categories:
        stats = {r.category: (r.n, r.mean) for r in found}
        order = [str(c) for c in categories] if categories is not None else sorted(stats)
        table = rows_table(spark, [(c, i, *stats.get(c, (0, None))) for i, c in enumerate(order)], schema)
        names, size, total = order, len(order), sum(n for n, _ in stats.values())
    else:
        if categories is not None:
            given = rows_table(spark, [(str(c), i) for i, c in enumerate(categories)], "category string, code long")
            table = settle(given.join(counted, "category", "left").select(
                "category", "code", F.coalesce("n", F.lit(0)).alias("n"), "mean"), "categories")
        else:
            # equal spacing of one per category turns a running total into the sorted code
            once = settle(counted.withColumn("one", F.lit(1)), "categories")
            ranked = running_totals(once, ["category"], {"upto": "one"})
            table = settle(ranked.select(
                "category", (F.col("upto") - 1).cast("long").alias("code"), "n", "mean"), "categories")
        names = None
        size, total = table.agg(F.count("*"), F.sum("n")).first()
    if method == "target":
        options = {"smoothing": float(smoothing), "global_mean": df.agg(F.avg(goal)).first()[0]}
    elif method == "frequency":
        options = {"normalize": normalize, "total": total}
    elif method == "onehot":
        options = {"handle_unknown": handle_unknown, "sparse": size > WIDE_ONE_HOT if sparse is None else sparse and size > 0}
    return Encoder(method, column, names, size, table, options)


def ordered_target(
    df: DataFrame, column: str, target: str, key: str | None = None, smoothing: float = 1.0, seed: int = 42
) -> DataFrame:
    """Replace a category by the smoothed target mean of the rows before it in a hashed order.

    No row sees its own target, so the code of a rare category does not give its target away. The order is
    that of the key's hash, or of the whole row's where there is no key; rows that are equal in it share
    what came before them. Null categories and first rows get the overall mean. Sums run over range
    partitions, so a category with most of the rows is spread like any other.
    """
    place = seeded_hash(ref(key), seed) if key else F.xxhash64(F.lit(seed), *[ref(c) for c in df.columns])
    tie = ref(key) if key else F.lit(0)
    rows = df.select(*[ref(c) for c in df.columns], ref(column).cast("string").alias("_cat"), place.alias("_at"), tie.alias("_tie"))
    known = rows.where(F.col("_cat").isNotNull())
    steps = known.groupBy("_cat", "_at", "_tie").agg(
        F.count(ref(target)).alias("_n"), F.coalesce(F.sum(ref(target).cast("double")), F.lit(0.0)).alias("_y")
    )
    mean = df.agg(F.avg(ref(target).cast("double"))).first()[0]
    overall = F.lit(0.0 if mean is None else float(mean))
    upto = running_totals(settle(steps, "ordered"), ["_at", "_tie"], {"_rows": "_n", "_sum": "_y"}, by=["_cat"])
    before = upto.select(
        "_cat", "_at", "_tie",
        ((F.col("_sum") - F.col("_y") + F.lit(smoothing) * overall) / (F.col("_rows") - F.col("_n") + F.lit(smoothing))).alias("_ordered"),
    )
    joined = rows.join(before, ["_cat", "_at", "_tie"], "left")
    return joined.select(*[F.coalesce("_ordered", overall).alias(c) if c == column else ref(c) for c in df.columns])


@dataclass
class AutoEncoding:
    encoders: list[Encoder]
    errors: list[tuple[str, str]]

    def apply(self, df: DataFrame) -> DataFrame:
        for e in self.encoders:
            if e.sparse and e.column not in df.columns:
                df = df.withColumn(e.column, F.lit(None).cast("string"))  # models need the vector, if only zeros
            if e.column in df.columns:
                df = e.apply(df)
        return df

    def report(self, spark: SparkSession) -> DataFrame:
        rows = [(e.column, e.method, ",".join(e.new_columns), None) for e in self.encoders]
        rows += [(c, None, None, message) for c, message in self.errors]
        return rows_table(spark, rows, "column_name string, method string, new_columns string, error string")


def fit_auto_encoding(
    df: DataFrame, configs: Sequence[dict] = (), target: str | None = None
) -> AutoEncoding:
    """Configured encoding per column; text columns without one become one-hot.

    A config is ``{column_name, encoding_method, is_target, is_excluded, ...options}``.
    Excluded columns, ``none``, and a target without a method are left alone. A column
    that cannot be encoded is reported and the rest goes on.
    """
    by_name = {c["column_name"]: c for c in configs}
    target = target or next((n for n, c in by_name.items() if c.get("is_target")), None)
    texts = set(text_columns(df))
    out = AutoEncoding([], [])
    for c in df.columns:
        config = by_name.get(c, {})
        method = config.get("encoding_method")
        if config.get("is_excluded") or method == "none" or (c == target and not method):
            continue
        if method is None and c not in texts:
            continue
        options = {k: config[k] for k in ("categories", "smoothing", "normalize", "n_features", "handle_unknown", "sparse") if k in config}
        try:
            if method == "target" and target is None:
                raise ValueError("target encoding needs a target column")
            out.encoders.append(fit_encoder(df, method or "onehot", c, target, **options))
        except ValueError as problem:
            out.errors.append((c, str(problem)))
    return out
