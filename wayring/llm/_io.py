"""Shared-folder helpers: every intermediate table lives where all executors can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local sessions without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wayring-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession, most: int = 8 << 20, rows: int = 2000) -> None:
    """Session settings: Arrow batches of bounded bytes and rows, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/wayring/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: int) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    ``options`` are the writer's.  The table outlives lost executors: a later stage rereads the files instead of recomputing them.
    """
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        base = shared_dir(spark)
        for name in df.inputFiles()[:1]:
            if "/wayring/" in name and name.startswith(base.split(":", 1)[0]):
                folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
