"""Queries on typed points and on results under several settings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.config import Scoring
from wayring.operators import typed
from wayring.operators.recompute import ScoreHistory
from wayring.plans.registry import query, rounded, rounded_sql
from wayring.plans.scoring import SCORES_SQL
from wayring.session import shared_folder
from wayring.sources.fixtures import primitive_metrics, table

_TYPED_SQL = """t AS (SELECT user_id % 3 AS server_id, user_id AS vehicle_number, date_trunc('hour', ts) AS source_time, event_id, event_id % 9 AS form, value,
  CASE event_type WHEN 'signup' THEN 'vehicle_identifier' WHEN 'error' THEN 'active' WHEN 'click' THEN 'latitude_deg' WHEN 'view' THEN 'longitude_deg' WHEN 'purchase' THEN 'altitude_m' ELSE 'other' END AS metric FROM events),
v AS (SELECT *, CASE WHEN form IN (0, 1) THEN value::DOUBLE WHEN form = 2 THEN 1.0 WHEN form = 4 THEN 'NaN'::DOUBLE WHEN form IN (5, 6) THEN 7.0 WHEN form = 7 THEN -3.0 END AS number,
  CASE WHEN form IN (0, 2, 5, 6, 7) THEN 'number' ELSE 'text' END AS kind, CASE form WHEN 1 THEN value::VARCHAR WHEN 3 THEN 'abc' WHEN 4 THEN 'NaN' WHEN 8 THEN 'on' END AS text FROM t),
r AS (SELECT *, CASE WHEN metric = 'other' THEN 'unknown_metric' WHEN metric = 'active' THEN CASE WHEN form NOT IN (2, 8) THEN 'not_mapped' END WHEN number IS NULL THEN 'not_numeric' WHEN isnan(number) THEN 'not_finite'
  WHEN metric = 'vehicle_identifier' AND NOT (number >= 0 AND number = floor(number)) THEN 'not_whole' END AS reason, CASE WHEN kind = 'number' THEN number END AS own FROM v),
d AS (SELECT server_id, vehicle_number, metric, source_time, kind, own, text, any_value(reason) AS reason, any_value(CASE WHEN metric = 'active' THEN 1.0 ELSE number END) AS number, count(*) AS copies, min(event_id) AS first FROM r GROUP BY ALL),
c AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY server_id, vehicle_number, metric, source_time, reason IS NULL ORDER BY first) > 1 THEN 'conflict' ELSE reason END AS told FROM d)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    form, value = F.col("event_id") % 9, F.col("value").cast("string")
    forms = ["true", '"abc"', '"NaN"', "7", "7.0", "-3", '"on"']
    raw = F.when(form == 0, value).when(form == 1, F.concat(F.lit('"'), value, F.lit('"')))
    for k, text in enumerate(forms):
        raw = raw.when(form == k + 2, F.lit(text))
    metric = F.lit("other")
    for kind, name in (("signup", "vehicle_identifier"), ("error", "active"), ("click", "latitude_deg"), ("view", "longitude_deg"), ("purchase", "altitude_m")):
        metric = F.when(F.col("event_type") == kind, name).otherwise(metric)
    e = table(spark, sf_dir, "events")
    points = e.select((F.col("user_id") % 3).alias("server_id"), F.col("user_id").alias("vehicle_number"), metric.alias("metric"), F.date_trunc("hour", "ts").alias("source_time"), F.parse_json(raw).alias("value"), F.col("event_id").alias("ingest_order"))
    return typed.sorted_out(points)


@query(f"WITH {_TYPED_SQL} SELECT metric, count(*) AS points, {rounded_sql('sum(number)', 3)} AS total FROM c WHERE told IS NULL GROUP BY ALL")
def typed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that can be read, of numbers, truth and text."""
    return typed.accepted(_judged(spark, sf_dir)).groupBy("metric").agg(F.count("*").alias("points"), rounded(F.sum("value"), 3).alias("total"))


@query(
    f"""WITH {_TYPED_SQL} SELECT server_id, vehicle_number, metric, reason, sum(copies)::BIGINT AS points FROM (SELECT server_id, vehicle_number, metric, told AS reason, copies FROM c WHERE told IS NOT NULL
UNION ALL SELECT server_id, vehicle_number, metric, 'repeated', copies - 1 FROM c WHERE told IS NULL AND copies > 1) GROUP BY ALL"""
)
def refused_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that are refused, with their reasons; with those accepted they are all."""
    return typed.refused(_judged(spark, sf_dir)).groupBy("server_id", "vehicle_number", "metric", "reason").agg(F.sum("copies").alias("points"))


@query(
    f"""{SCORES_SQL}, e AS (SELECT valid, total, CASE WHEN valid THEN round((sync_raw * 0.5::DOUBLE + route_raw * 0.5::DOUBLE) / 1.0::DOUBLE, 6) END AS even FROM s)
SELECT 'default' AS settings, count(*) AS vehicles, {rounded_sql('avg(total)', 3)} AS mean_total, 7::BIGINT AS computed, 0::BIGINT AS computed_again FROM e UNION ALL SELECT 'even', count(*), {rounded_sql('avg(even)', 3)}, 7, 0 FROM e"""
)
def recomputed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All history under two settings; the second time there is nothing to compute."""
    metrics = primitive_metrics(spark, sf_dir).withColumn("day", F.pmod("group_id", F.lit(7)))
    history = ScoreHistory(spark, f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}")
    out = None
    for name, cfg in (("default", Scoring()), ("even", Scoring(total_weights=(50.0, 50.0)))):
        times = [history.recompute(metrics, cfg) for _ in range(2)]
        one = history.scores(cfg).agg(F.lit(name).alias("settings"), F.count("*").alias("vehicles"), rounded(F.avg("total"), 3).alias("mean_total"), F.lit(times[0]).cast("long").alias("computed"), F.lit(times[1]).cast("long").alias("computed_again"))
        out = one if out is None else out.unionByName(one)
    return out
