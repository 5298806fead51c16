"""Queries on the temporal join and the lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.config import Join
from wayring.operators import lifecycle, temporal
from wayring.plans.registry import query, rounded, rounded_sql
from wayring.sources.fixtures import lifecycle_samples, raw_points

CFG = Join(grid_seconds=3600, tolerance_seconds=172_800)
NO_DATA, EXPIRE = 43_200, 129_600

RAW_SQL = """raw AS (SELECT user_id % 3 AS server_id, user_id AS vehicle_number, date_trunc('hour', ts) AS source_time, event_id,
  CASE event_type WHEN 'signup' THEN 'vehicle_identifier' WHEN 'error' THEN 'active' WHEN 'click' THEN 'latitude_deg' WHEN 'view' THEN 'longitude_deg' WHEN 'purchase' THEN 'velocity_north_mps' END AS metric,
  CASE event_type WHEN 'signup' THEN (user_id + 100 + CASE WHEN day(ts) > 20 AND user_id % 5 = 0 THEN 1000 ELSE 0 END)::DOUBLE WHEN 'error' THEN CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END
    WHEN 'click' THEN value / 1000.0::DOUBLE + 31.0 WHEN 'view' THEN value / 1000.0::DOUBLE + 34.0 WHEN 'purchase' THEN value / 10.0::DOUBLE END AS value FROM events),
p AS (SELECT server_id, vehicle_number, metric, source_time, arg_min(value, event_id) AS value FROM raw WHERE metric IS NOT NULL GROUP BY ALL),
b AS (SELECT server_id, vehicle_number, min(source_time) AS s, max(source_time) AS e FROM p GROUP BY ALL),
grid AS (SELECT server_id, vehicle_number, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS time FROM b),
idp AS (SELECT * FROM p WHERE metric = 'vehicle_identifier'), acp AS (SELECT * FROM p WHERE metric = 'active')"""


def _asof(of: str, at: str) -> str:
    """Identifier and activity that hold at the rows of a table."""
    fresh = lambda x: f"epoch_us(o.{at}) - epoch_us({x}.source_time) <= {CFG.tolerance_seconds}000000"
    return f"""SELECT o.*, CASE WHEN {fresh('i')} THEN i.value END AS id_now, CASE WHEN {fresh('i')} THEN (epoch_us(o.{at}) - epoch_us(i.source_time)) / 1e6 END AS id_age,
  CASE WHEN {fresh('a')} THEN a.value END AS active_now, CASE WHEN {fresh('a')} THEN (epoch_us(o.{at}) - epoch_us(a.source_time)) / 1e6 END AS active_age
  FROM {of} o ASOF LEFT JOIN idp i ON o.server_id = i.server_id AND o.vehicle_number = i.vehicle_number AND o.{at} >= i.source_time
  ASOF LEFT JOIN acp a ON o.server_id = a.server_id AND o.vehicle_number = a.vehicle_number AND o.{at} >= a.source_time"""


def _numeric(name: str, of: str, metric: str, guard: bool = True) -> str:
    both = " AND ".join(f"{s}.id_now IS NOT DISTINCT FROM o.id_now AND coalesce({s}.active_now <> 0, TRUE)" for s in ("x", "y")) if guard else "TRUE"
    tol = CFG.tolerance_seconds
    return f"""{name}_0 AS (SELECT o.*, (epoch_us(o.time) - epoch_us(x.source_time)) / 1e6 AS bk, (epoch_us(y.source_time) - epoch_us(o.time)) / 1e6 AS fw, x.value AS xv, y.value AS yv, ({both}) AS same
  FROM {of} o ASOF LEFT JOIN (SELECT * FROM np WHERE metric = '{metric}') x ON o.server_id = x.server_id AND o.vehicle_number = x.vehicle_number AND o.time >= x.source_time
  ASOF LEFT JOIN (SELECT * FROM np WHERE metric = '{metric}') y ON o.server_id = y.server_id AND o.vehicle_number = y.vehicle_number AND o.time <= y.source_time),
{name} AS (SELECT * EXCLUDE (bk, fw, xv, yv, same), CASE WHEN bk = 0 THEN xv WHEN bk <= {tol} AND fw <= {tol} AND same THEN xv + (yv - xv) * (bk / nullif(bk + fw, 0)) END AS {metric},
  CASE WHEN bk = 0 THEN 'original' WHEN bk <= {tol} AND fw <= {tol} AND same THEN 'interpolated' ELSE 'missing' END AS {metric}_quality,
  CASE WHEN bk = 0 THEN 0.0 WHEN bk <= {tol} AND fw <= {tol} AND same THEN greatest(bk, fw) END AS {metric}_distance FROM {name}_0)"""


ASOF_SQL = f"WITH {RAW_SQL}, g AS ({_asof('grid', 'time')}), np AS ({_asof('p', 'source_time')})"
_REL = lambda d: f"CASE WHEN {d} IS NOT NULL THEN 1.0::DOUBLE - 0.25::DOUBLE * least(1.0::DOUBLE, {d} / {float(CFG.tolerance_seconds)}::DOUBLE) END"
_FILL = lambda a: f"CASE WHEN {a} = 0 THEN 'original' WHEN {a} > 0 THEN 'forward_filled' ELSE 'missing' END"
JOIN_SQL = (
    f"{ASOF_SQL}, gi AS (SELECT * FROM g WHERE id_now IS NOT NULL), {_numeric('n1', 'gi', 'latitude_deg')}, {_numeric('n2', 'n1', 'longitude_deg')}, {_numeric('n3', 'n2', 'velocity_north_mps')},"
    f"""j AS (SELECT time AS sample_time, server_id, vehicle_number, id_now::BIGINT AS vehicle_identifier, active_now = 1 AS active,
  CASE WHEN latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL THEN latitude_deg END AS latitude_deg, CASE WHEN latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL THEN longitude_deg END AS longitude_deg, velocity_north_mps,
  CASE WHEN latitude_deg IS NULL OR longitude_deg IS NULL THEN 'missing' ELSE latitude_deg_quality END AS latitude_quality, {_FILL('id_age')} AS identifier_quality, {_FILL('active_age')} AS active_quality,
  velocity_north_mps_quality AS velocity_quality, CASE WHEN latitude_deg IS NULL OR longitude_deg IS NULL THEN 'missing' ELSE longitude_deg_quality END AS longitude_quality,
  least({_REL('id_age')}, {_REL('active_age')}, {_REL('latitude_deg_distance')}, {_REL('longitude_deg_distance')}, {_REL('velocity_north_mps_distance')}) AS reliability FROM n3),
js AS (SELECT * FROM j WHERE latitude_deg IS NOT NULL OR active IS NOT DISTINCT FROM FALSE)"""
)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_points(spark, sf_dir)


@query(f"WITH {RAW_SQL} SELECT server_id, vehicle_number, metric, count(*) AS points, {rounded_sql('sum(value)', 3)} AS total FROM p GROUP BY ALL")
def raw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = temporal.deduplicated(_points(spark, sf_dir), strict=True)
    return d.groupBy("server_id", "vehicle_number", "metric").agg(F.count("*").alias("points"), rounded(F.sum("value"), 3).alias("total"))


@query(f"WITH {RAW_SQL} SELECT server_id, vehicle_number, metric, source_time, count(*) AS points, min(value) + 0.0 AS low, max(value) + 0.0 AS high FROM raw WHERE metric IS NOT NULL GROUP BY ALL HAVING min(value) <> max(value)")
def raw_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.conflicts(raw_points(spark, sf_dir, collapse=False))


@query(f"WITH {RAW_SQL} SELECT server_id, vehicle_number, count(*) AS cells, min(time) AS first_time, max(time) AS last_time FROM grid GROUP BY ALL")
def stream_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = temporal.stream_grid(_points(spark, sf_dir), CFG)
    return g.groupBy("server_id", "vehicle_number").agg(F.count("*").alias("cells"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query(f"{ASOF_SQL} SELECT server_id, vehicle_number, time, id_now::BIGINT AS vehicle_identifier, {_FILL('id_age')} AS identifier_quality, active_now = 1 AS active, {_FILL('active_age')} AS active_quality FROM g")
def asof_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.asof_rows(_points(spark, sf_dir), CFG)
    filled = lambda age: F.when(F.col(age) == 0, "original").when(F.col(age) > 0, "forward_filled").otherwise("missing")
    return rows.select("server_id", "vehicle_number", "time", F.col("id_now").cast("long").alias("vehicle_identifier"), filled("id_age").alias("identifier_quality"), (F.col("active_now") == 1).alias("active"), filled("active_age").alias("active_quality"))


@query(f"{ASOF_SQL}, {_numeric('n1', 'g', 'latitude_deg', guard=False)} SELECT server_id, vehicle_number, time, {rounded_sql('latitude_deg', 6)} AS latitude, latitude_deg_quality AS quality, latitude_deg_distance AS distance_s FROM n1 WHERE latitude_deg IS NOT NULL")
def bracket_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.with_numeric(temporal.asof_rows(_points(spark, sf_dir), CFG), "latitude_deg", CFG, guard=False).where("latitude_deg is not null")
    return rows.select("server_id", "vehicle_number", "time", rounded("latitude_deg", 6).alias("latitude"), F.col("latitude_deg_quality").alias("quality"), F.col("latitude_deg_distance").alias("distance_s"))


@query(f"{ASOF_SQL}, gi AS (SELECT * FROM g WHERE id_now IS NOT NULL), {_numeric('u', 'gi', 'latitude_deg', guard=False)}, {_numeric('v', 'gi', 'latitude_deg')} SELECT u.server_id, u.vehicle_number, count(*) AS cells, count(u.latitude_deg) AS unguarded, count(v.latitude_deg) AS guarded FROM u JOIN v USING (server_id, vehicle_number, time) GROUP BY ALL")
def identity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.asof_rows(_points(spark, sf_dir), CFG).where("id_now is not null")
    rows = temporal.with_numeric(rows, "latitude_deg", CFG, guard=False).withColumn("free", F.col("latitude_deg"))
    rows = temporal.with_numeric(rows, "latitude_deg", CFG)
    return rows.groupBy("server_id", "vehicle_number").agg(F.count("*").alias("cells"), F.count("free").alias("unguarded"), F.count("latitude_deg").alias("guarded"))


@query(f"{ASOF_SQL} SELECT server_id, vehicle_number, time, {rounded_sql(_REL('id_age'), 6)} AS reliability FROM g WHERE id_now IS NOT NULL")
def field_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.asof_rows(_points(spark, sf_dir), CFG).where("id_now is not null")
    return rows.select("server_id", "vehicle_number", "time", rounded(temporal.field_reliability(F.col("id_age"), CFG), 6).alias("reliability"))


@query(f"{JOIN_SQL} SELECT sample_time, server_id, vehicle_number, vehicle_identifier, active, {rounded_sql('latitude_deg', 6)} AS latitude_deg, {rounded_sql('longitude_deg', 6)} AS longitude_deg, {rounded_sql('velocity_north_mps', 6)} AS velocity_north_mps, {rounded_sql('reliability', 6)} AS reliability, latitude_quality FROM js")
def joined_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = temporal.join_metrics(_points(spark, sf_dir), CFG)
    return s.select("sample_time", "server_id", "vehicle_number", "vehicle_identifier", "active", *(rounded(c, 6).alias(c) for c in ("latitude_deg", "longitude_deg", "velocity_north_mps", "reliability")), F.col("field_quality")["latitude_deg"].alias("latitude_quality"))


@query(f"{JOIN_SQL}, q AS (SELECT 'vehicle_identifier' AS field, identifier_quality AS quality FROM js UNION ALL SELECT 'active', active_quality FROM js UNION ALL SELECT 'latitude_deg', latitude_quality FROM js UNION ALL SELECT 'velocity_north_mps', velocity_quality FROM js UNION ALL SELECT 'longitude_deg', longitude_quality FROM js UNION ALL SELECT unnest(['altitude_m', 'velocity_east_mps']), 'missing' FROM js) SELECT field, quality, count(*) AS samples FROM q GROUP BY ALL")
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = temporal.join_metrics(_points(spark, sf_dir), CFG)
    each = s.select(F.explode("field_quality").alias("field", "quality"))
    return each.groupBy("field", "quality").agg(F.count("*").alias("samples"))


LIFE_SQL = f"""WITH s AS (SELECT 0::BIGINT AS server_id, user_id AS vehicle_identifier, ts AS sample_time, event_type <> 'error' AS active FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM events) WHERE k = 1),
w AS (SELECT *, lag(sample_time) OVER o AS before, lag(active) OVER o AS was, coalesce(lead(sample_time) OVER o, (SELECT max(sample_time) FROM s)) AS until FROM s WINDOW o AS (PARTITION BY vehicle_identifier ORDER BY sample_time)),
c AS (SELECT sample_time AS change_time, 'vehicle_activated' AS kind, server_id, vehicle_identifier FROM w WHERE active AND was IS NOT TRUE
  UNION ALL SELECT sample_time, 'vehicle_deactivated', server_id, vehicle_identifier FROM w WHERE NOT active AND was
  UNION ALL SELECT sample_time, 'data_resumed', server_id, vehicle_identifier FROM w WHERE before + INTERVAL {NO_DATA} SECOND <= sample_time
  UNION ALL SELECT sample_time + INTERVAL {NO_DATA} SECOND, 'data_lost', server_id, vehicle_identifier FROM w WHERE until >= sample_time + INTERVAL {NO_DATA} SECOND
  UNION ALL SELECT sample_time + INTERVAL {EXPIRE} SECOND, 'vehicle_expired', server_id, vehicle_identifier FROM w WHERE until >= sample_time + INTERVAL {EXPIRE} SECOND)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.accepted(lifecycle_samples(spark, sf_dir), "event_id")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_changes(_samples(spark, sf_dir), NO_DATA, EXPIRE)


@query("SELECT 0::BIGINT AS server_id, user_id AS vehicle_identifier, date_trunc('day', ts) AS sample_time, arg_min(event_id, event_id) AS event_id, count(*) - 1 AS dropped FROM events GROUP BY ALL")
def dedup_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lifecycle_samples(spark, sf_dir).withColumn("sample_time", F.date_trunc("day", "sample_time"))
    kept = lifecycle.accepted(s, "event_id")
    counts = s.groupBy(*lifecycle.KEY, "sample_time").agg((F.count("*") - 1).alias("dropped"))
    return kept.join(counts, [*lifecycle.KEY, "sample_time"]).select(*lifecycle.KEY, "sample_time", "event_id", "dropped")


@query(f"{LIFE_SQL} SELECT * FROM c WHERE kind IN ('vehicle_activated', 'vehicle_deactivated')")
def activation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("kind in ('vehicle_activated', 'vehicle_deactivated')")


@query(f"{LIFE_SQL} SELECT * FROM c WHERE kind IN ('data_lost', 'data_resumed')")
def data_lost_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("kind in ('data_lost', 'data_resumed')")


@query(f"{LIFE_SQL} SELECT * FROM c WHERE kind = 'vehicle_expired'")
def vehicle_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("kind = 'vehicle_expired'")


@query(f"{LIFE_SQL} SELECT * FROM c ORDER BY change_time, server_id, vehicle_identifier, kind")
def state_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).orderBy("change_time", "server_id", F.coalesce("vehicle_identifier", F.lit(-1)), "kind")


@query(f"{LIFE_SQL} SELECT server_id, vehicle_identifier, sample_time, active FROM s")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("server_id", "vehicle_identifier", "sample_time", "active")


@query(f"{LIFE_SQL} SELECT server_id, vehicle_identifier, arg_max(active, sample_time) AS active, max(sample_time) AS sample_time, count(*) AS samples FROM s GROUP BY ALL")
def latest_state_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_state(_samples(spark, sf_dir))
