"""Spark session settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Time is UTC throughout; arithmetic errors are raised, not hidden; stateful queries keep state in RocksDB.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "wayring", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` use underscores for dots and win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one only in local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wayring-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialized(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back, which cuts its lineage and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """Rows by key over a stated number of parts: few bytes that make much work are not put together into few tasks."""
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table of :func:`materialized` that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
