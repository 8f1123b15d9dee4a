"""Classification metrics from confusion and score counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.names import ref
from ...sources.shared import settle
from ..ordering import running_totals
from .common import metric_rows


def confusion_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.groupBy(ref(y_true).alias("actual"), ref(y_pred).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1), zero where undefined."""
    sides = F.array(
        F.struct(
            F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
            F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
            F.lit(0).cast("long").alias("hits"),
        ),
    )
    per = (
        confusion_counts(df, y_true, y_pred).select(F.inline(sides)).groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("called").alias("predicted"), F.sum("hits").alias("hits"))
    )

    def rate(over: str):
        return F.coalesce(F.col("hits") / F.nullif(F.col(over), F.lit(0)), F.lit(0.0))

    f1 = F.coalesce(2 * F.col("hits") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0))
    return per.select("*", rate("predicted").alias("precision"), rate("support").alias("recall"), f1.alias("f1_score"))


def classification_metrics(df: DataFrame, y_true: str, y_pred: str, average: str | None = None) -> DataFrame:
    """accuracy, precision, recall, f1_score, num_classes as (metric, value).

    Two true classes report the higher one; more classes are weighted by support.
    ``average`` ('binary' or 'weighted') overrides that.
    """
    rates = ("precision", "recall", "f1_score")
    real = F.col("support") > 0
    total = F.sum("support")
    row = class_scores(df, y_true, y_pred).agg(
        (F.sum("hits") / total).alias("accuracy"),
        F.count_if(real).alias("classes"),
        *[(F.sum(F.col("support") * F.col(r)) / total).alias(f"w_{r}") for r in rates],
        *[F.max_by(F.when(real, F.col(r)), F.when(real, F.col("class"))).alias(f"b_{r}") for r in rates],
    )
    binary = F.lit(average == "binary") if average else F.col("classes") == 2
    names = {"accuracy": F.col("accuracy")}
    names.update({r: F.when(binary, F.col(f"b_{r}")).otherwise(F.col(f"w_{r}")) for r in rates})
    names["num_classes"] = F.col("classes")
    return metric_rows(row, names)


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(ref(column).alias("class")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Dense (actual, predicted, n): every pair of labels seen on either side.

    The grid is the label list exploded per label; it is as large as its own answer.
    """
    counts = confusion_counts(df, y_true, y_pred)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    listed = labels.agg(F.array_sort(F.collect_set("label")).alias("labels"))
    grid = listed.select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("predicted")
    )
    return grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def score_counts(df: DataFrame, y_true: str, scores: dict[object, str]) -> DataFrame:
    """(class, score, pos, neg): rows per distinct score, one series per class.

    Settled, because curves read it several times and the rows behind it are many.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"), ref(s).cast("double").alias("score"),
                (ref(y_true) == F.lit(c)).cast("long").alias("hit"),
            )
            for c, s in scores.items()
        ]
    )
    counts = (
        df.select(F.inline(rows)).groupBy("class", "score")
        .agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    )
    return settle(counts, "scores")


def auc_by_class(df: DataFrame, y_true: str, scores: dict[object, str]) -> DataFrame:
    """(class, auc, share) by rank sums; tied scores count half."""
    counts = running_totals(score_counts(df, y_true, scores), ["score"], {"upto": "neg"}, by=["class"])
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return counts.groupBy("class").agg(
        (wins / F.nullif(p * n, F.lit(0))).alias("auc"), (p / (p + n)).alias("share")
    )


def roc_auc(df: DataFrame, y_true: str, scores: dict[object, str]) -> DataFrame:
    """One score column: that class's AUC. Several: one-vs-rest, weighted by class share."""
    per = auc_by_class(df, y_true, scores)
    value = F.sum(F.col("auc") * F.col("share")) / F.sum("share")
    return metric_rows(per.agg(value.alias("roc_auc")), {"roc_auc": F.col("roc_auc")})


def roc_points(df: DataFrame, y_true: str, scores: dict[object, str]) -> DataFrame:
    """(class, threshold, fpr, tpr) per distinct score, plus the origin with no threshold."""
    counts = score_counts(df, y_true, scores)
    totals = counts.groupBy("class").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    running = running_totals(counts, ["score"], {"tp": "pos", "fp": "neg"}, by=["class"], descending=True)
    # one totals row per score column, a number fixed by the schema
    points = running.join(F.broadcast(totals), "class").select(
        "class",
        F.col("score").alias("threshold"),
        (F.col("fp") / F.nullif(F.col("all_neg"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("all_pos"), F.lit(0))).alias("tpr"),
    )
    origin = totals.select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def precision_recall_points(df: DataFrame, y_true: str, scores: dict[object, str]) -> DataFrame:
    """(class, threshold, precision, recall) per distinct score, plus the (1, 0) end point."""
    counts = score_counts(df, y_true, scores)
    totals = counts.groupBy("class").agg(F.sum("pos").alias("all_pos"))
    running = running_totals(counts, ["score"], {"tp": "pos", "fp": "neg"}, by=["class"], descending=True)
    points = running.join(F.broadcast(totals), "class").select(
        "class",
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.nullif(F.col("all_pos"), F.lit(0))).alias("recall"),
    )
    end = totals.select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def probability_sample(df: DataFrame, key: str, columns: list[str], rows: int = 100) -> DataFrame:
    return df.orderBy(ref(key)).limit(rows).select(ref(key), *[ref(c) for c in columns])


def error_summary(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    wrong = F.count_if(ref(y_true) != ref(y_pred))
    row = df.agg(wrong.alias("e"), F.count("*").alias("n"))
    return metric_rows(row, {"total_errors": F.col("e"), "error_rate": F.col("e") / F.col("n")})


def error_pairs(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return confusion_counts(df, y_true, y_pred).where(F.col("actual") != F.col("predicted"))
