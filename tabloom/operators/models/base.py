"""What every fitted estimator offers, and class labels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.names import ref, text_columns
from ..lookup import lookup

#: Up to so many classes, class names are literals and every class has a probability column. With more,
#: names come from a joined table and ``probabilities`` is one array column in class order.
WIDE_CLASSES = 1000


def is_vector(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, VectorUDT)


def widths(df: DataFrame, features: Sequence[str]) -> list[int]:
    """Numbers that each feature stands for: one, or the length of a vector column."""
    return [df.schema[c].metadata["ml_attr"]["num_attrs"] if is_vector(df, c) else 1 for c in features]


def sized(column: Column, name: str, width: int) -> Column:
    """A vector column that says its length."""
    return column.alias(name, metadata={"ml_attr": {"num_attrs": width}})


def feature_array(df: DataFrame, features: Sequence[str]) -> Column:
    """All features as one array; vector columns are written out, so a row takes as many numbers as they are wide."""
    if not any(is_vector(df, c) for c in features):
        return F.array(*[ref(c).cast("double") for c in features])
    return F.concat(*[vector_to_array(ref(c)) if is_vector(df, c) else F.array(ref(c).cast("double")) for c in features])


def fold(values: Sequence[float], spans: Sequence[int]) -> list[float]:
    """Values of single numbers summed for the features they belong to."""
    out, at = [], 0
    for n in spans:
        out.append(float(sum(values[at : at + n])))
        at += n
    return out


def require_numeric(df: DataFrame, features: Sequence[str]) -> None:
    texts = text_columns(df, features)
    if texts:
        raise ValueError(f"text features must be encoded first: {', '.join(texts)}")


def require_columns(df: DataFrame, features: Sequence[str], what: str) -> None:
    """For estimators that look at single columns."""
    require_numeric(df, features)
    wide = [c for c in features if is_vector(df, c)]
    if wide:
        raise ValueError(f"{what} takes no vector columns: {', '.join(wide)}; use target, frequency or hash encoding")


def class_list(df: DataFrame, label: str) -> list:
    """Sorted classes of a target. A model holds numbers for each of them, so they fit where it does."""
    rows = df.select(ref(label).alias("c")).where(F.col("c").isNotNull()).distinct().collect()
    return sorted(r.c for r in rows)


def class_code(label: Column, classes: Sequence) -> Column:
    """Position of the class in sorted order as a double, null for an unknown class."""
    spot = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(spot > 0, (spot - 1).cast("double"))


def class_name(code: Column, classes: Sequence) -> Column:
    names = F.array(*[F.lit(c) for c in classes])
    return F.when(code.isNotNull(), F.element_at(names, code.cast("int") + 1))


def _class_table(df: DataFrame, classes: Sequence, kind: T.DataType, name: str, code: str) -> DataFrame:
    schema = T.StructType([T.StructField(name, kind), T.StructField(code, T.IntegerType()), T.StructField("_n", T.LongType())])
    return df.sparkSession.createDataFrame([(c, i, 1) for i, c in enumerate(classes)], schema)


def with_code(df: DataFrame, label: str, classes: Sequence, name: str = "_code") -> DataFrame:
    """Add the class code of each row; many classes are looked up in a table instead of a literal."""
    if len(classes) <= WIDE_CLASSES:
        return df.withColumn(name, class_code(ref(label), classes))
    table = _class_table(df, classes, df.schema[label].dataType, "_class", "_place")
    found = lookup(df.withColumn("_class", ref(label)), table, "_class", "_n", size=len(classes))
    return found.select(*[ref(c) for c in df.columns], F.col("_place").cast("double").alias(name))


def assemble(
    df: DataFrame, features: Sequence[str], label: Column | None = None, weight: Column | None = None, classes: int | None = None
) -> DataFrame:
    """(_x vector, _y, _w) of the complete rows, nothing else carried along; ``classes`` states the number of them."""
    require_numeric(df, features)
    cols = [ref(c).alias(f"x{i}") if is_vector(df, c) else ref(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    if label is not None:
        cols.append(label.cast("double").alias("_y"))
    if weight is not None:
        cols.append(weight.alias("_w"))
    packer = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="_x")
    packed = packer.transform(df.select(*cols).dropna())
    out = packed.select("_x", *[c for c in ("_y", "_w") if c in packed.columns])
    return out if classes is None else out.withMetadata("_y", {"ml_attr": {"type": "nominal", "num_vals": classes}})


def right_size(df: DataFrame, rows: int, per_partition: int = 20_000) -> DataFrame:
    """Fewer partitions for few rows: an iterative fit pays for every task in every pass."""
    return df.coalesce(max(1, math.ceil(rows / per_partition)))


def attach_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``_x`` beside the given columns."""
    packer = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_x", handleInvalid="keep")
    wide = df.select("*", *[
        ref(c).alias(f"_x{i}") if is_vector(df, c) else ref(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)
    ])
    return packer.transform(wide).drop(*[f"_x{i}" for i in range(len(features))])


@dataclass
class Fitted:
    features: list[str]
    notes: dict[str, str] = field(default_factory=dict)

    classes = None

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def importances(self) -> dict[str, float] | None:
        return None


def with_probabilities(df: DataFrame, probabilities: Column, classes: Sequence, best: Column | None = None) -> DataFrame:
    """Append ``prediction`` (lowest class on ties) and a probability column for each class, or one array for many."""
    staged = df.withColumn("_p", probabilities)
    top = F.array_position("_p", F.array_max("_p")) - 1 if best is None else best
    if len(classes) <= WIDE_CLASSES:
        return staged.select(
            *[ref(c) for c in df.columns],
            class_name(top, classes).alias("prediction"),
            *[F.col("_p")[i].alias(f"probability_{c}") for i, c in enumerate(classes)],
        )
    kind = T._infer_type(classes[0])
    table = _class_table(df, classes, kind, "prediction", "_place")
    found = lookup(staged.withColumn("_place", top.cast("int")), table, "_place", "_n", size=len(classes))
    return found.select(*[ref(c) for c in df.columns], "prediction", F.col("_p").alias("probabilities"))


@dataclass
class MlClassifier(Fitted):
    """One pyspark.ml model with class probabilities."""

    model: object = None
    classes: list = field(default_factory=list)
    spans: list[int] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(attach_vector(df, self.features))
        kept = out.select(*[ref(c) for c in df.columns], vector_to_array("probability").alias("_v"))
        done = with_probabilities(kept, F.col("_v"), self.classes)
        return done.drop("_v")

    def importances(self) -> dict[str, float] | None:
        spans = self.spans or [1] * len(self.features)
        if hasattr(self.model, "featureImportances"):
            return dict(zip(self.features, fold(self.model.featureImportances.toArray(), spans)))
        if hasattr(self.model, "coefficientMatrix"):
            return dict(zip(self.features, fold(abs(self.model.coefficientMatrix.toArray()).mean(axis=0), spans)))
        return None


@dataclass
class RestClassifier(Fitted):
    """One binary model per class; scores are scaled to sum to one."""

    models: list = field(default_factory=list)
    classes: list = field(default_factory=list)
    spans: list[int] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        out = attach_vector(df, self.features)
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"_s{i}", vector_to_array("probability")[1])
            out = out.drop("rawPrediction", "probability", "prediction")
        scores = [F.col(f"_s{i}") for i in range(len(self.models))]
        total = sum(scores, F.lit(0.0))
        shares = F.array(*[F.when(total > 0, s / total).otherwise(1.0 / len(scores)) for s in scores])
        kept = out.select(*[ref(c) for c in df.columns], shares.alias("_v"))
        return with_probabilities(kept, F.col("_v"), self.classes).drop("_v")

    def importances(self) -> dict[str, float]:
        rows = [m.featureImportances.toArray() for m in self.models]
        return dict(zip(self.features, fold(sum(rows) / len(rows), self.spans or [1] * len(self.features))))


@dataclass
class MlRegressor(Fitted):
    model: object = None
    spans: list[int] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(attach_vector(df, self.features))
        return out.select(*[ref(c) for c in df.columns], "prediction")

    def importances(self) -> dict[str, float]:
        return dict(zip(self.features, fold(self.model.featureImportances.toArray(), self.spans or [1] * len(self.features))))
