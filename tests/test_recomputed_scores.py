"""Scored rows are written without a sort, whole also where parts are more than files are open at once."""

import re

from pyspark.sql import functions as F

from wayring.config import Scoring
from wayring.functions.scoring import with_scores
from wayring.operators.recompute import WRITERS, ScoreHistory
from wayring.sources.fixtures import primitive_metrics


def written_plans(spark, folder):
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [found.apply(k).physicalPlanDescription() for k in range(found.size())]
    return [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and f"{folder}/scores" in p]


def test_scored_rows_are_not_sorted_by_part(spark, tmp_path):
    metrics = primitive_metrics(spark, "/root/testdata/sf0.001").withColumn("day", F.pmod("group_id", F.lit(7)))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert ScoreHistory(spark, f"file://{tmp_path}").recompute(metrics, Scoring()) == 7
    plans = written_plans(spark, tmp_path)
    under_the_writer = {name for p in plans for name in re.findall(r"WriteFiles \(\d+\)\s+\+- (?:\* )?(\w+)", p)}
    assert under_the_writer == {"Project"}  # a Sort before
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_more_parts_than_open_files_are_written_whole(spark, tmp_path):
    parts = WRITERS * 3 + 1
    metrics = primitive_metrics(spark, "/root/testdata/sf0.001").withColumn("day", F.pmod("group_id", F.lit(parts)))
    history = ScoreHistory(spark, f"file://{tmp_path}")
    assert history.recompute(metrics, Scoring()) == parts and history.recompute(metrics, Scoring()) == 0
    want = with_scores(metrics, Scoring())
    got = history.scores(Scoring()).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
