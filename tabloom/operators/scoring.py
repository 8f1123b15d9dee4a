"""Applying a stored preparation and model to new rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, ref, rename_to, replace_columns, text_columns
from ..functions.parsing import clean_number
from .construct import Products
from .dates import to_epoch
from .encoding import AutoEncoding, Encoder
from .missing import Filler
from .models.base import is_vector
from .outliers import Treatment
from .profiling import validate_input
from .scaling import Scaler
from .selection import Selection


@dataclass
class DateStep:
    columns: list[str]

    def apply(self, df: DataFrame) -> DataFrame:
        return to_epoch(df, [c for c in self.columns if c in text_columns(df)])


Step = Filler | Encoder | AutoEncoding | Scaler | DateStep | Treatment | Products | Selection


def needed(steps: Sequence[Step], wanted: Sequence[str]) -> set[str]:
    """Columns that the first step has to be given so that the last one leaves the wanted ones."""
    names = set(wanted)
    for step in reversed(steps):
        if isinstance(step, Products):
            names = step.inputs(names)
        for e in step.encoders if isinstance(step, AutoEncoding) else [step] if isinstance(step, Encoder) else []:
            if names & set(e.new_columns):
                names = names - set(e.new_columns) | {e.column}
    return names


@dataclass
class Preparation:
    """Fitted steps in the one order that training and scoring share."""

    steps: list[Step] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            if isinstance(step, Encoder) and step.column not in df.columns:
                continue
            df = step.apply(df)
        return df

    def reordered(self, order: Sequence[type]) -> Preparation:
        """The same steps sorted by kind, e.g. fillers before encoders before scalers."""
        spot = {kind: i for i, kind in enumerate(order)}
        return Preparation(sorted(self.steps, key=lambda s: spot.get(type(s), len(spot))))

    def history(self, spark) -> DataFrame:
        """(position, operation, columns) of the applied steps."""
        rows = []
        for i, s in enumerate(self.steps):
            if isinstance(s, Filler):
                rows.append((i, f"fill_{s.strategy}", ",".join(s.values)))
            elif isinstance(s, Scaler):
                rows.append((i, f"scale_{s.method}", ",".join(s.parameters)))
            elif isinstance(s, Encoder):
                rows.append((i, f"encode_{s.method}", s.column))
            elif isinstance(s, DateStep):
                rows.append((i, "dates", ",".join(s.columns)))
            elif isinstance(s, Treatment):
                rows.append((i, f"outliers_{s.action}", ",".join(s.bounds.limits)))
            elif isinstance(s, Products):
                rows.append((i, "polynomial", ",".join(s.columns)))
            elif isinstance(s, Selection):
                rows.append((i, f"select_{s.method}", ",".join(s.selected)))
            else:
                rows.append((i, "encode_auto", ",".join(e.column for e in s.encoders)))
        return spark.createDataFrame(rows, "position int, operation string, columns string")


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Training columns in training order; absent columns and leftover nulls are 0, others are dropped.

    Vector columns pass as they are; their encoder gives zeros where there is nothing.
    """
    present = set(df.columns)
    out = [
        F.lit(0.0).alias(c) if c not in present else ref(c) if is_vector(df, c)
        else F.coalesce(clean_number(ref(c)), F.lit(0.0)).alias(c)
        for c in features
    ]
    return df.select(*[ref(c) for c in keep], *out)


def restore(df: DataFrame, column: str, scaler: Scaler | None = None, encoder: Encoder | None = None, target: str | None = None) -> DataFrame:
    """Predictions back to original units, then back to labels."""
    if scaler is not None and target in scaler.parameters:
        df = scaler.invert(df, {column: target})
    if encoder is not None:
        df = encoder.invert(df, column)
    return df


@dataclass
class ScoringBundle:
    """All that scoring needs: raw columns, preparation, model columns, model, target inverse."""

    key: str
    required: list[str]
    types: dict[str, str]
    preparation: Preparation
    features: list[str]
    model: object
    target: str | None = None
    target_scaler: Scaler | None = None
    target_encoder: Encoder | None = None

    def findings(self, df: DataFrame) -> DataFrame:
        return validate_input(rename_to(df, self.required).drop(self.key), self.required, self.types)

    def score(self, df: DataFrame) -> DataFrame:
        """Input columns, prediction and class probabilities."""
        named = rename_to(df, [self.key, *self.required])
        names = named.columns
        if not _row_local(self.model):
            ready = align(self.preparation.apply(named), self.features, [self.key])
            scored = restore(self.model.predict(ready), "prediction", self.target_scaler, self.target_encoder, self.target)
            added = [c for c in scored.columns if c not in self.features and c != self.key]
            return named.join(scored.select(ref(self.key), *[ref(c) for c in added]), self.key)
        # the inputs ride along under other names, so no join is needed
        inputs = [f"_in_{c}" for c in names]
        carried = named.select("*", *[ref(c).alias(n) for c, n in zip(names, inputs)])
        ready = align(self.preparation.apply(carried), self.features, inputs)
        scored = restore(self.model.predict(ready), "prediction", self.target_scaler, self.target_encoder, self.target)
        added = [c for c in scored.columns if c not in self.features and c not in inputs]
        return scored.select(*[ref(n).alias(c) for c, n in zip(names, inputs)], *[ref(c) for c in added])


def _row_local(model: object) -> bool:
    """Whether prediction looks at one row at a time (all models but neighbour voting)."""
    return not hasattr(model, "votes")


def prediction_summary(scored: DataFrame) -> DataFrame:
    """Row count with statistics of numeric predictions or counts of classes."""
    if "prediction" in numeric_columns(scored):
        return scored.agg(
            F.count("*").alias("rows"), F.avg("prediction").alias("mean"), F.min("prediction").alias("min"),
            F.max("prediction").alias("max"),
        )
    return scored.groupBy("prediction").agg(F.count("*").alias("rows"))
