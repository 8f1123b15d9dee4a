"""Working tables in the folder every executor can reach.

Iterative operators cut their lineage by writing a round's result to the folder
named by ``spark.checkpoint.dir``. A lost executor then costs a re-read, not a
recomputation of all rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tabloom-")
    spark.conf.set(SETTING, folder)
    return folder


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the table to shared storage and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame | None) -> None:
    """Delete a settled table that no later round reads."""
    if df is None:
        return
    spark = df.sparkSession
    root = shared_folder(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.split(":", 1)[-1] in folder:
            path.getFileSystem(conf).delete(path, True)
