"""Scores of all history under new settings: results are kept by the fingerprint of the scoring settings.

Detection settings take effect forward only, so they are no part of the fingerprint.  Parts of the input that have no
results under a fingerprint are found by an anti join and computed; parts that have are never touched, so settings
that did not change cost nothing, and the results of former settings stay.

A scored row is several times as wide as its metrics, so rows are not sorted by part to be written: a task keeps the files of
``WRITERS`` parts open at once and sorts only rows of further parts.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.config import Scoring
from wayring.functions.scoring import with_scores


#: Parts that a task writes at once, and the bytes of a row group, which bound what their files hold in memory.
WRITERS = 8
ROW_GROUP = 16 << 20
_WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"


def scoring_fingerprint(cfg: Scoring) -> str:
    return hashlib.sha256(json.dumps(asdict(cfg), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class ScoreHistory:
    """Scored parts under one folder, by settings and part; ``part`` is a column of the metrics such as their day."""

    def __init__(self, spark: SparkSession, folder: str, part: str = "day") -> None:
        self.spark, self.folder, self.part = spark, folder.rstrip("/"), part

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def known_parts(self) -> DataFrame:
        """``config_sha256`` and part of everything that was computed, and how many rows it has."""
        schema = f"config_sha256 string, {self.part} string, rows long"
        return self.spark.read.schema(schema).json(f"{self.folder}/parts") if self._exists("parts") else self.spark.createDataFrame([], schema)

    def stale_parts(self, metrics: DataFrame, cfg: Scoring) -> DataFrame:
        """Parts of the metrics, with their rows, that have no results under the settings, or had other rows then."""
        now = metrics.groupBy(F.col(self.part).cast("string").alias(self.part)).agg(F.count("*").alias("rows"))
        return now.join(self.known_parts().where(F.col("config_sha256") == scoring_fingerprint(cfg)).drop("config_sha256"), [self.part, "rows"], "left_anti")

    def recompute(self, metrics: DataFrame, cfg: Scoring) -> int:
        """Score the stale parts and note them; how many there were.

        A part is overwritten whole, so a lost job is simply run again; it is noted only when its rows are written.
        """
        stale = self.stale_parts(metrics, cfg).cache()
        try:
            count = stale.count()
            if count:
                fingerprint = F.lit(scoring_fingerprint(cfg)).alias("config_sha256")
                keyed = metrics.withColumn(self.part, F.col(self.part).cast("string")).join(stale.select(self.part), self.part)
                scored = with_scores(keyed, cfg).select("*", fingerprint)
                before = self.spark.conf.get(_WRITERS_CONF)
                try:  # the writer has no option of its own for it
                    self.spark.conf.set(_WRITERS_CONF, str(max(WRITERS, int(before))))
                    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP).partitionBy("config_sha256", self.part).parquet(f"{self.folder}/scores")
                finally:
                    self.spark.conf.set(_WRITERS_CONF, before)
                stale.select(fingerprint, self.part, "rows").write.mode("append").json(f"{self.folder}/parts")
            return count
        finally:
            stale.unpersist()

    def scores(self, cfg: Scoring) -> DataFrame:
        """The results under the settings; the filter prunes folders."""
        return self.spark.read.parquet(f"{self.folder}/scores").where(F.col("config_sha256") == scoring_fingerprint(cfg))
