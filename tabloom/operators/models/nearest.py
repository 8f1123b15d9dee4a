"""k-nearest-neighbour classification over the exact neighbour join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ..lookup import BROADCAST_ROWS, lookup
from ..neighbors import SMALL_VALUES, TILE_ROWS, nearest
from ..ordering import running_totals
from .base import WIDE_CLASSES, Fitted, require_columns, with_code, with_probabilities


@dataclass
class NearestClassifier(Fitted):
    train: DataFrame = None
    key: str = ""
    classes: list = field(default_factory=list)
    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"
    small_values: int = SMALL_VALUES
    tile_rows: int = TILE_ROWS
    #: Number of classes; beyond ``BROADCAST_ROWS`` they are not listed here, only in ``train`` (_code, _name).
    n_classes: int = 0

    @property
    def _named(self) -> bool:
        """Training rows carry their class name, which no list holds for many classes."""
        return "_name" in self.train.columns

    def votes(self, df: DataFrame) -> DataFrame:
        """(key, _hits): the k nearest training rows of each row as (code, weight, name), at most k of them."""
        carry = ["_code", "_name"] if self._named else ["_code"]
        hits = nearest(
            df, self.train, self.key, self.features, self.k, self.metric, carry=carry,
            small_values=self.small_values, tile_rows=self.tile_rows,
        )
        found = hits.groupBy(F.col("left_key").alias(self.key)).agg(
            F.sort_array(F.collect_list(F.struct("rank", "distance", *carry))).alias("_near")
        )
        weight = lambda h: F.lit(1.0)
        if self.weights == "distance":
            # a neighbour at distance zero outweighs all others
            zero = F.exists("_near", lambda h: h["distance"] == 0)
            weight = lambda h: F.when(zero, (h["distance"] == 0).cast("double")).otherwise(
                1 / F.nullif(h["distance"], F.lit(0.0))
            )
        name = [F.lit(None).alias("name")] if not self._named else None
        return found.select(ref(self.key), F.transform("_near", lambda h: F.struct(
            h["_code"].alias("code"), weight(h).alias("w"), *(name or [h["_name"].alias("name")])
        )).alias("_hits"))

    def predict(self, df: DataFrame) -> DataFrame:
        """Appends prediction and probabilities; ties go to the lower class, rows with gaps get none."""
        codes = F.array_distinct(F.transform("_hits", lambda h: h["code"]))
        total = F.aggregate("_hits", F.lit(0.0), lambda a, h: a + h["w"])
        per = self.votes(df).withColumn("_total", total).withColumn("_sums", F.transform(
            codes,
            lambda c: F.struct(
                F.aggregate("_hits", F.lit(0.0), lambda a, h: a + F.when(h["code"] == c, h["w"]).otherwise(0.0)).alias("w"),
                (-c).alias("low"),
            ),
        )).withColumn("_best", -F.array_max("_sums")["low"]).select(
            ref(self.key), "_best", F.filter("_hits", lambda h: h["code"] == F.col("_best"))[0]["name"].alias("_best_name"),
            F.map_from_entries(F.transform("_sums", lambda s: F.struct((-s["low"]).cast("int"), s["w"] / F.col("_total")))).alias("_shares"),
        )
        joined = df.join(per, self.key, "left")
        shares = F.when(F.col("_shares").isNotNull(), F.transform(
            F.sequence(F.lit(0), F.lit((self.n_classes or len(self.classes)) - 1)), lambda i: F.coalesce(F.try_element_at("_shares", i), F.lit(0.0))
        ))
        if self._named:
            # the wide array is written out only where it is read
            return joined.select(
                *[ref(c) for c in df.columns], F.col("_best_name").alias("prediction"), shares.alias("probabilities")
            )
        best = F.when(F.col("_shares").isNotNull(), F.col("_best"))
        return with_probabilities(joined, shares, self.classes, best).select(
            *[ref(c) for c in df.columns], "prediction", *self._shown()
        )

    def _shown(self) -> list:
        wide = len(self.classes) > WIDE_CLASSES
        return [F.col("probabilities")] if wide else [ref(f"probability_{c}") for c in self.classes]


def fit_nearest(
    df: DataFrame, features: Sequence[str], label: str, key: str, n_neighbors: int = 5, weights: str = "uniform",
    metric: str = "minkowski", p: float = 2, small_values: int = SMALL_VALUES, tile_rows: int = TILE_ROWS, **ignored,
) -> NearestClassifier:
    require_columns(df, features, "neighbour voting")
    if metric == "minkowski":
        metric = {1: "manhattan", 2: "euclidean"}.get(p, f"minkowski:{p}")
    x = [ref(c) for c in features]
    known = df.where(ref(label).isNotNull()).groupBy(ref(label).alias("_name")).agg(F.count("*").alias("_n"))
    classes = [r["_name"] for r in known.select("_name").limit(BROADCAST_ROWS + 1).collect()]
    classes, count = (sorted(classes), len(classes)) if len(classes) <= BROADCAST_ROWS else ([], known.count())
    if count <= WIDE_CLASSES:
        train = with_code(df, label, classes).select(ref(key), *x, "_code")
    else:
        # sorted places are running counts; neither the list nor a literal of all classes is built
        places = running_totals(known.withColumn("_one", F.lit(1)), ["_name"], {"_place": "_one"}).drop("_one")
        found = lookup(df.withColumn("_name", ref(label)), places, "_name", "_n", size=count)
        train = found.select(ref(key), *x, (F.col("_place") - 1).cast("double").alias("_code"), "_name")
    return NearestClassifier(
        list(features), {k: f"ignored: {v}" for k, v in ignored.items()}, train, key, classes, n_neighbors, weights,
        metric, small_values, tile_rows, count,
    )
