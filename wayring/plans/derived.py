"""Further spec-derived queries: suggestions with hysteresis, jumps, inner turns, snapshots of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.operators import detection
from wayring.operators import events as E
from wayring.plans.geometry import ORBIT_SQL
from wayring.plans.registry import query, rounded, rounded_sql
from wayring.plans.workspace import _SECONDS_SQL, _seconds
from wayring.sources.simulator import orbits
from wayring.functions import geo


@query(
    f"""WITH {_SECONDS_SQL}, a AS (SELECT *, second - coalesce(max(CASE WHEN NOT score >= 60 THEN second END) OVER w, 0) AS open_for, second - coalesce(max(CASE WHEN NOT score < 30 THEN second END) OVER w, 0) AS close_for FROM sec WINDOW w AS (PARTITION BY k ORDER BY second ROWS UNBOUNDED PRECEDING)),
m AS (SELECT k, second, CASE WHEN open_for >= 2 THEN 'open' WHEN close_for >= 2 THEN 'close' END AS mark FROM a),
e AS (SELECT *, lag(mark) OVER (PARTITION BY k ORDER BY second) AS was FROM m WHERE mark IS NOT NULL),
f AS (SELECT *, lead(second) OVER (PARTITION BY k ORDER BY second) AS closed_at FROM e WHERE (was IS NULL AND mark = 'open') OR was <> mark) SELECT k, second AS opened_at, closed_at FROM f WHERE mark = 'open'"""
)
def template_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hysteresis(_seconds(spark, sf_dir), ["k"], "second", F.col("score") >= 60, F.col("score") < 30, 2, 2)


@query(
    f"""WITH {_SECONDS_SQL}, j AS (SELECT k, second, score, abs(score - lag(score) OVER (PARTITION BY k ORDER BY second)) AS speed FROM sec) SELECT k, second, {rounded_sql('speed', 3)} AS derived_speed FROM j WHERE speed > 60.0"""
)
def score_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seconds(spark, sf_dir).withColumn("zero", F.lit(0.0))
    return E.jumps(s, ["k"], "second", "score", "zero", F.lit(30.0)).where("jump").select("k", "second", rounded("derived_speed", 3).alias("derived_speed"))


@query(f"WITH {ORBIT_SQL} SELECT server_id, vid AS vehicle_identifier, 0::BIGINT AS samples_in_inner_turns FROM og GROUP BY ALL")
def inner_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of the orbits and how many of their samples lie in an inner turn; smooth orbits have none."""
    o = orbits(spark, sf_dir).withColumn("second", F.unix_timestamp("sample_time"))
    p = geo.local_m(F.col("latitude_deg"), F.col("longitude_deg"), F.lit(31.8), F.lit(34.8))
    o = o.withColumns({"heading": F.degrees(F.atan2("velocity_east_mps", "velocity_north_mps")), "phase": F.pmod(F.atan2(p["y"], p["x"]) / (2 * 3.141592653589793), F.lit(1.0))})
    t = E.inner_turns(o, ["server_id", "vehicle_identifier"], "second", "heading", "phase")
    return t.groupBy("server_id", "vehicle_identifier").agg(F.count_if("inner_turn").alias("samples_in_inner_turns"))


@query(
    f"""WITH {_SECONDS_SQL}, j AS (SELECT k, second, coalesce(abs(score - lag(score) OVER (PARTITION BY k ORDER BY second)) > 60.0, false) AS jump FROM sec), r AS (SELECT *, sum(jump::INTEGER) OVER (PARTITION BY k ORDER BY second)::BIGINT AS run FROM j)
SELECT k, second, run, run = 0 OR second - min(second) OVER (PARTITION BY k, run) >= 2 AS accepted FROM r"""
)
def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of scores between jumps; one after a jump counts from its third second on."""
    s = _seconds(spark, sf_dir).withColumn("zero", F.lit(0.0))
    return E.accepted_runs(E.jumps(s, ["k"], "second", "score", "zero", F.lit(30.0)), ["k"], "second", "jump", 2).select("k", "second", "run", "accepted")


@query(
    """WITH r AS (SELECT s_suppkey AS k, second, CASE WHEN s_suppkey % 2 = 0 THEN 45.0 * least(greatest(second - 30, 0), 20) ELSE 0.0 END AS heading, floor(second * 1953.125::DOUBLE)::BIGINT AS progress FROM supplier, range(300) t(second)),
f AS (SELECT *, max(heading) OVER w - min(heading) OVER w >= 720 AS found FROM r WINDOW w AS (PARTITION BY k ORDER BY progress RANGE BETWEEN 100000 PRECEDING AND CURRENT ROW)),
l AS (SELECT k, second, progress, max(CASE WHEN found THEN progress END) OVER (PARTITION BY k ORDER BY second) AS last FROM f)
SELECT k, count(CASE WHEN progress - last < 200000 THEN 1 END) AS samples, min(CASE WHEN progress - last < 200000 THEN second END) AS first_second, max(CASE WHEN progress - last < 200000 THEN second END) AS last_second FROM l GROUP BY k"""
)
def inner_turn_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of 512 s; every second stream turns two and a half times on the spot in 20 s of its first one."""
    second, k = F.col("second"), F.col("s_suppkey")
    turn = F.when(k % 2 == 0, F.least(F.greatest(second - 30, F.lit(0)), F.lit(20)) * 45.0).otherwise(0.0)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k, k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(299).cast("long"))).alias("second"))
    s = s.select("k", "second", F.pmod(turn, F.lit(360.0)).alias("heading"), (second / F.lit(512.0)).alias("phase"))
    t = E.inner_turns(s, ["k"], "second", "heading", "phase")
    inside = F.when(F.col("inner_turn"), second)
    return t.groupBy("k").agg(F.count_if("inner_turn").alias("samples"), F.min(inside).alias("first_second"), F.max(inside).alias("last_second"))


_LOCAL_SQL = f"lp AS (SELECT *, radians(lon - 34.8::DOUBLE) * {geo.EARTH_RADIUS_M} * cos(radians(31.8::DOUBLE)) AS x, radians(lat - 31.8::DOUBLE) * {geo.EARTH_RADIUS_M} AS y FROM og)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orbits(spark, sf_dir)
    p = geo.local_m(F.col("latitude_deg"), F.col("longitude_deg"), F.lit(31.8), F.lit(34.8))
    return o.withColumns({"second": F.unix_timestamp("sample_time") - 1_767_225_600, "x": p["x"], "y": p["y"]})


@query(
    f"""WITH {ORBIT_SQL}, {_LOCAL_SQL}, dv AS (SELECT *, second - lag(second) OVER w AS dt, (x - lag(x) OVER w) / (second - lag(second) OVER w) AS e, (y - lag(y) OVER w) / (second - lag(second) OVER w) AS n FROM lp WINDOW w AS (PARTITION BY server_id, vid ORDER BY second)),
ag AS (SELECT *, coalesce(sqrt(e * e + n * n) > 2.0 * sqrt(ve * ve + vn * vn), false) AS jump, coalesce(abs(sqrt(e * e + n * n) - sqrt(ve * ve + vn * vn)) <= 0.7 * greatest(sqrt(e * e + n * n), sqrt(ve * ve + vn * vn)), true)
  AND coalesce(CASE WHEN sqrt(e * e + n * n) > 1e-9 AND sqrt(ve * ve + vn * vn) > 1e-9 THEN degrees(acos(greatest(-1.0, least(1.0, (e * ve + n * vn) / (sqrt(e * e + n * n) * sqrt(ve * ve + vn * vn)))))) <= 60 END, true) AS agrees, coalesce(dt >= 20, false) AS back FROM dv),
ru AS (SELECT *, sum(jump::INTEGER) OVER w AS run, max(CASE WHEN jump OR NOT agrees THEN second END) OVER w AS began, sum(back::INTEGER) OVER w AS gaps, max(CASE WHEN back OR NOT agrees THEN second END) OVER w AS last FROM ag WINDOW w AS (PARTITION BY server_id, vid ORDER BY second ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT *, gaps = 0 OR bool_or(second - last >= 10) OVER (PARTITION BY server_id, vid, gaps ORDER BY second ROWS UNBOUNDED PRECEDING) AS live FROM ru)
SELECT server_id, vid AS vehicle_identifier, count(*) AS samples, count(*) FILTER (NOT agrees) AS differing, count(*) FILTER (run = 0 OR second - began >= 20) AS accepted, count(*) FILTER (live) AS live FROM lv GROUP BY ALL"""
)
def consistent_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the orbits whose velocity and way agree, runs after jumps and scores after silence that count again."""
    key = ["server_id", "vehicle_identifier"]
    s = E.agreement(_placed(spark, sf_dir), key, "second", "x", "y", "velocity_east_mps", "velocity_north_mps")
    s = E.jumps(s, key, "second", "x", "y", F.hypot("velocity_east_mps", "velocity_north_mps"))
    s = E.resumed_scores(E.accepted_runs(s, key, "second", "jump", agrees="agrees"), key, "second", 20, agrees="agrees")
    return s.groupBy(*key).agg(F.count("*").alias("samples"), F.count_if(~F.col("agrees")).alias("differing"), F.count_if("accepted").alias("accepted"), F.count_if("live").alias("live"))


@query(f"WITH {ORBIT_SQL} SELECT server_id, vid AS vehicle_identifier, second, {rounded_sql('avg(lat) OVER w', 6)} AS latitude_deg, {rounded_sql('avg(ve) OVER w', 4)} AS velocity_east_mps FROM og WINDOW w AS (PARTITION BY server_id, vid ORDER BY second RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)")
def smoothed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over three seconds, as detection may take them."""
    s = detection.smoothed(_placed(spark, sf_dir))
    return s.select("server_id", "vehicle_identifier", "second", rounded("latitude_deg", 6).alias("latitude_deg"), rounded("velocity_east_mps", 4).alias("velocity_east_mps"))
