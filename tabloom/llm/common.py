"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Labelled rows a classifier is fitted on at most.
LABELLED_ROWS = 20_000
#: Spark's setting for the bytes that go to a Python worker at once, and what ``bound_batches`` sets. Spark's own 64 MB
#: are held several times over: by the executor for each task, while its buffers grow, and by the worker.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file on this machine; workers resolve it for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


_kept: dict = {}


def worker_table(name: tuple | str, make: Callable[[], object]):
    """What a worker keeps under ``name`` from task to task; a table of another name takes its place.

    A worker serves one operator after the other, so tables of earlier ones would only pile up in its memory.
    """
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def bound_batches(spark: SparkSession) -> None:
    """Send at most ``BATCH_BYTES`` to a Python worker at once from now on, unless the session has a setting of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def whole_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text; a null text is empty. Other columns, whatever their names, are left out."""
    return df.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(text))


def fold(key: str, folds: int) -> Column:
    """Remainder of the key text's crc32; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % folds


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list[str]], list]], schema: str, text: str = "text", keep_text: bool = False
) -> DataFrame:
    """Replace the text column by what ``make()(texts)`` returns for each batch: lists, one per new column.

    The other columns pass through untouched, with ``keep_text`` the text as well; its nulls are then given to ``make``
    as empty texts. ``make`` runs once per task, so that a worker loads its tables once.
    """
    kept = [c for c in df.columns if keep_text or c != text]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if keep_text or f.name != text), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            texts = batch.column(batch.schema.get_field_index(text))
            new = work((pc.fill_null(texts, "") if keep_text else texts).to_pylist())
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, new)], names=[*kept, *names])

    names = [part.split()[0] for part in schema.split(",")]
    return df.mapInArrow(run, out)


def add_columns(
    df: DataFrame, make: Callable[[], Callable[[list[str]], list]], schema: str, text: str = "text"
) -> DataFrame:
    """The table with columns that ``make()(texts)`` gives; names of ``schema`` must be new."""
    if text in df.columns and df.schema[text].dataType == StringType():
        return map_texts(df, make, schema, text, keep_text=True)  # a text travels once
    return map_texts(df.withColumn("__whole", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), make, schema, "__whole")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int = LABELLED_ROWS, folds: int = 5, held_out: int = 0,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, text, y) of at most ``limit`` labelled rows outside the held-out fold.

    The rows with the lowest hash of their key are taken, so the choice depends on
    neither partitions nor order. Keys with several labels count once, by their mean;
    null labels and null keys are ignored.
    """
    ids = (
        labels.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").cast("double").alias("y"))
        .where(F.col(key).isNotNull() & F.col("y").isNotNull() & (fold(key, folds) != held_out))
        .groupBy(key).agg((F.avg("y") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64(F.lit(7), key), key).limit(limit)
    )
    return whole_texts(docs, key, text).join(F.broadcast(ids), key)
