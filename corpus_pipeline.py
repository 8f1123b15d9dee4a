"""From raw documents to token ids, stage by stage.

Each stage takes the documents that the one before kept, written and read again. Every stage hands whole texts to
Python workers, so each bounds the bytes that go there at once (``common.bound_batches``, a setting of the session).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, neardup, quality, sentencepieces, toxicity
from tabloom.llm.common import bound_batches
from tabloom.sources.shared import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_bounded_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_bounded_batches
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


@in_bounded_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality.drop_low_quality(docs, _table(spark, sf_dir, "labels"))


@in_bounded_batches
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    A row is known by its id and its text, so that of two texts under one id only the copy goes.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("at"), F.md5("text").alias("is")))
    named = docs.select(row.alias("row"), "text")
    found = neardup.near_duplicates(named, width=5, percent=80, key="row")
    gone = found.where(~F.col("kept")).select("row").distinct()
    return docs.join(gone, row.eqNullSafe(F.col("row")), "left_anti").select(*docs.columns)


@in_bounded_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


@in_bounded_batches
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text they decode to."""
    return sentencepieces.encode_texts(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Fitted models, signatures and subword merges have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
