"""Queries that run a stream to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring import selftest
from wayring.config import Detection, Engine
from wayring.operators import motion
from wayring.plans.geometry import FIT_SQL, R
from wayring.plans.registry import query, rounded, rounded_sql
from wayring.plans.temporal import EXPIRE, LIFE_SQL, NO_DATA
from wayring.session import shared_folder
from wayring.sources.fixtures import lifecycle_samples
from wayring.sources.simulator import bent_orbits, orbits
from wayring.streaming import lifecycle
from wayring.streaming.session import Session

#: 2026-01-01 00:00:00 UTC, when orbits begin.
_START_SECOND = 1_767_225_600


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def run_to_end(spark: SparkSession, stream: DataFrame, tag: str) -> DataFrame:
    """All available input through the stream into a Parquet table."""
    folder = _folder(spark, tag)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


# --- the session over the orbits: what every look of a stream at its samples so far finds ----------------------------

#: Streams are looked at every five seconds; a look stands in the place of the stream, so that the statements of whole
#: streams apply to each.  Looks that already fail a cheaper gate are not projected.
LOOK_SQL = (
    FIT_SQL.replace("FROM og WHERE active WINDOW", """FROM (SELECT og.* REPLACE (og.vid * 1000 + l.second AS vid) FROM og JOIN og l ON l.server_id = og.server_id AND l.vid = og.vid AND og.second <= l.second
  WHERE l.second % 5 = 0 AND l.second >= 60 AND l.active AND og.active) WINDOW""")
    .replace("span >= 300", "span >= 60")
    .replace("FROM ef e JOIN ps s", "FROM (SELECT ef.* FROM ef SEMI JOIN (SELECT server_id, vid FROM tr WHERE closed AND cycles + 1e-9 >= 1) t ON t.server_id = ef.server_id AND t.vid = ef.vid) e JOIN ps s")
    + f""", looks AS (SELECT *, vid // 1000 AS stream, vid % 1000 AS look FROM rt),
found AS (SELECT *, 'route_candidate' AS kind FROM looks QUALIFY row_number() OVER (PARTITION BY server_id, stream ORDER BY look) = 1
  UNION ALL SELECT *, 'route_confirmed' FROM looks WHERE look >= 300 QUALIFY row_number() OVER (PARTITION BY server_id, stream ORDER BY look) = 1),
changes AS (SELECT server_id, stream AS vehicle_identifier, {_START_SECOND} + look::DOUBLE AS change_s, kind, server_id || ':' || stream || ':effective' AS route_id, family, CASE WHEN area > 0 THEN 'counterclockwise' ELSE 'clockwise' END AS direction,
  {rounded_sql('period', 3)} AS period_s, {rounded_sql('0.55 * fit + 0.30 * inlier + 0.15', 3)} AS quality FROM found)"""
)
PHASE_SQL = f"""{LOOK_SQL},
cn AS (SELECT server_id, stream, vid, look, lat0 + degrees(cy / {R}) AS la0, lon0 + degrees(cx / ({R} * cos(radians(lat0)))) AS lo0 FROM found WHERE kind = 'route_confirmed'),
fr AS (SELECT og.server_id, og.vid, og.second, og.active, c.vid AS shape, radians(og.lon - lo0) * {R} * cos(radians(la0)) AS qx, radians(og.lat - la0) * {R} AS qy FROM og JOIN cn c ON c.server_id = og.server_id AND c.stream = og.vid WHERE og.active AND og.second >= c.look),
fp AS (SELECT f.server_id, f.vid, f.second, s.i, s.before, s.len, s.total, least(1.0, greatest(0.0, ((f.qx - s.x) * s.dx + (f.qy - s.y) * s.dy) / (s.len * s.len))) AS fr, f.qx, f.qy, s.x, s.y, s.dx, s.dy FROM fr f JOIN ps s ON f.server_id = s.server_id AND f.shape = s.vid),
ph AS (SELECT server_id, vid, second, (before + len * fr) / total AS phase FROM fp QUALIFY row_number() OVER (PARTITION BY server_id, vid, second ORDER BY sqrt((qx - (x + dx * fr)) ** 2 + (qy - (y + dy * fr)) ** 2), i) = 1)
SELECT og.server_id, og.vid AS vehicle_identifier, og.second, og.active, CASE WHEN phase IS NOT NULL THEN og.server_id || ':' || og.vid || ':effective' END AS route_id, {rounded_sql('phase')} % 1.0 AS phase FROM og LEFT JOIN ph ON ph.server_id = og.server_id AND ph.vid = og.vid AND ph.second = og.second"""
SESSION_SQL = f"""{LOOK_SQL},
w AS (SELECT *, lag(second) OVER o AS before, lag(active) OVER o AS was, coalesce(lead(second) OVER o, 360) AS until FROM og WINDOW o AS (PARTITION BY server_id, vid ORDER BY second))
SELECT server_id, vehicle_identifier, change_s, kind FROM changes
UNION ALL SELECT server_id, vid, {_START_SECOND} + second::DOUBLE, 'vehicle_activated' FROM w WHERE active AND was IS NOT TRUE
UNION ALL SELECT server_id, vid, {_START_SECOND} + second::DOUBLE, 'vehicle_deactivated' FROM w WHERE NOT active AND was
UNION ALL SELECT server_id, vid, {_START_SECOND} + second::DOUBLE, 'data_resumed' FROM w WHERE before + 20 <= second
UNION ALL SELECT server_id, vid, {_START_SECOND} + second::DOUBLE + 20, 'data_lost' FROM w WHERE until >= second + 20
UNION ALL SELECT server_id, vid, {_START_SECOND} + second::DOUBLE + 300, 'vehicle_expired' FROM w WHERE until >= second + 300"""


def _rounded(changes: DataFrame) -> DataFrame:
    return changes.select(*lifecycle.KEY, "change_s", "kind", "route_id", "family", "direction", rounded("period_s", 3).alias("period_s"), rounded("quality", 3).alias("quality"))


def orbit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits as a stream of two minutes a micro-batch, each of as many files as there are parts with suppliers.

    Every supplier has samples in each two minutes, so that all micro-batches have files from the same parts; files come
    in order of time.
    """
    o = orbits(spark, sf_dir)
    source = _folder(spark, "orbits")
    second, files = F.unix_timestamp("sample_time") - _START_SECOND, [0]
    for first in range(0, 361, 120):
        o.where(second.between(first, first + 119)).write.mode("append").parquet(source)
        files.append(len(spark.read.schema(o.schema).parquet(source).inputFiles()))
    if any(n != files[1] * k for k, n in enumerate(files)):
        raise RuntimeError(f"two minutes have other numbers of files than others: {files}")
    return spark.readStream.schema(o.schema).option("maxFilesPerTrigger", files[1]).parquet(source)


def _phases(found: DataFrame) -> DataFrame:
    frames = lifecycle.frames_of(found)
    return frames.select(*lifecycle.KEY, (F.unix_timestamp("sample_time") - _START_SECOND).alias("second"), "active", "route_id", (rounded("phase") % 1.0).alias("phase"))


def _session_changes(found: DataFrame) -> DataFrame:
    return found.where("output = 'change'").select(*lifecycle.KEY, (F.col("at_us") / 1e6).alias("change_s"), "kind")


@query(f"WITH {LOOK_SQL} SELECT * FROM changes")
def route_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lifecycle.route_changes(orbits(spark, sf_dir)))


@query(f"WITH {LOOK_SQL} SELECT * FROM changes")
def stream_route_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of the batch form from a stream, whose state is kept by Spark."""
    return _rounded(run_to_end(spark, lifecycle.stream_route_changes(orbit_stream(spark, sf_dir)), "route-changes"))


@query(f"WITH {PHASE_SQL}")
def session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame per sample, with route and phase from the confirming sample on."""
    return _phases(lifecycle.process(orbits(spark, sf_dir)))


@query(f"WITH {PHASE_SQL}")
def stream_session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames from a stream: one operator gives changes and frames."""
    return _phases(run_to_end(spark, lifecycle.stream_process(orbit_stream(spark, sf_dir)), "session"))


@query(f"WITH {SESSION_SQL}")
def session_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of activity, data and routes together."""
    return _session_changes(lifecycle.process(orbits(spark, sf_dir)))


@query(f"WITH {SESSION_SQL}")
def stream_session_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_changes(run_to_end(spark, lifecycle.stream_process(orbit_stream(spark, sf_dir)), "session"))


@query(
    f"""WITH {LOOK_SQL}, k AS (SELECT server_id, vid, count(*) AS n, bool_and(active) AS on_, max(second) FILTER (second % 5 = 0) AS last_look FROM og GROUP BY ALL)
SELECT k.server_id, k.vid AS vehicle_identifier, CASE WHEN on_ AND f.look IS NULL THEN n ELSE 0 END AS history_count, on_ AND c.look IS NOT NULL AS candidate, f.look IS NOT NULL AS confirmed,
  CASE WHEN on_ THEN coalesce(f.look, last_look) END AS last_look_s FROM k
LEFT JOIN (SELECT * FROM found WHERE kind = 'route_confirmed') f ON f.server_id = k.server_id AND f.stream = k.vid LEFT JOIN (SELECT * FROM found WHERE kind = 'route_candidate') c ON c.server_id = k.server_id AND c.stream = k.vid"""
)
def debug_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the streams of the orbits hold after all samples."""
    d = lifecycle.debug_state(lifecycle.route_states(orbits(spark, sf_dir)))
    return d.select(*lifecycle.KEY, F.col("history_count").cast("long").alias("history_count"), "candidate", "confirmed", (F.unix_timestamp("last_evaluation") - _START_SECOND).alias("last_look_s"))


@query("SELECT DISTINCT user_id AS vehicle_identifier, date_trunc('hour', ts) AS sample_time FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*")
    s = stream.select(F.col("user_id").alias("vehicle_identifier"), F.date_trunc("hour", "ts").alias("sample_time"))
    return run_to_end(spark, lifecycle.stream_first_samples(s, ["vehicle_identifier", "sample_time"]), "first-samples")


@query(f"{LIFE_SQL} SELECT * FROM c")
def stream_state_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog of the batch form, from a stream with timers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*")
    changes = lifecycle.stream_state_changes(lifecycle_samples(spark, sf_dir, stream), NO_DATA, EXPIRE, ties=("event_id",))
    return run_to_end(spark, changes, "state-changes").withColumn("change_time", F.col("change_time").cast(e.schema["ts"].dataType))


# --- sessions with a progress table -----------------------------------------------------------------------------------


def _lagging_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orbits in batches of two minutes; every fourth vehicle's samples come one batch late."""
    o = orbits(spark, sf_dir)
    batch = F.floor((F.unix_timestamp("sample_time") - _START_SECOND) / 120) + F.when(F.col("vehicle_number") % 4 == 1, 1).otherwise(0)
    return [o.where(batch == k) for k in range(5)]


@query(
    f"""WITH {SESSION_SQL.replace("SELECT server_id, vehicle_identifier, change_s, kind FROM changes", "SELECT * FROM (SELECT server_id, vehicle_identifier, change_s, kind FROM changes", 1)})
UNION ALL SELECT server_id, k + 100, {_START_SECOND} + extra_s::DOUBLE, kind FROM (SELECT DISTINCT s_nationkey::BIGINT AS server_id, s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 1), (VALUES (139, 'data_lost'), (120, 'data_resumed'), (259, 'data_lost'), (240, 'data_resumed')) v(extra_s, kind)"""
)
def lagging_session_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches in which some vehicles are always one batch behind: their rows count, and their silences are told."""
    session = Session(spark, _folder(spark, "session"))
    for k, batch in enumerate(_lagging_batches(spark, sf_dir)):
        session.process_batch(batch, batch_id=k)
    return _session_changes(session.all_results())


@query(f"WITH {PHASE_SQL}")
def session_frames_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a session that starts anew before every micro-batch."""
    folder = _folder(spark, "session")
    o = orbits(spark, sf_dir)
    for first in range(0, 361, 120):
        Session(spark, folder).process_batch(o.where((F.unix_timestamp("sample_time") - _START_SECOND).between(first, first + 119)))
    return _phases(Session(spark, folder).all_results())


@query(
    """SELECT * FROM (VALUES ('batch_increment_equivalence', 'passed', (SELECT count(*)::DOUBLE FROM supplier, range(361) q(t) WHERE NOT (s_suppkey % 10 = 9 AND t BETWEEN 150 AND 179))), ('checkpoint_restart_equivalence', 'passed', NULL)) v(name, status, samples)"""
)
def self_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The self-test on the orbits: increments of three minutes, and a restart after four."""
    samples = orbits(spark, sf_dir)
    folder = _folder(spark, "self-test")
    rows = [selftest.equivalence_check(samples, folder, 180, 360), selftest.restart_check(samples, folder, 240)]
    return spark.createDataFrame(rows, selftest.CHECK).select("name", "status", F.col("metrics")["samples"].alias("samples"))


@query("SELECT s_nationkey::BIGINT AS server_id, s_suppkey + 100 AS vehicle_identifier, CASE WHEN s_suppkey % 4 IN (1, 2) THEN 1 ELSE 0 END::BIGINT AS changes, CASE WHEN s_suppkey % 4 IN (1, 2) THEN TRUE END AS near_the_bend, 0::BIGINT AS left_open FROM supplier")
def confirmed_route_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles that grow, slow down, grow for a while or stay: how many changes are told, whether as of the bend, and rivals left open."""
    config = Engine(detection=Detection(follow_changes=True))
    found = lifecycle.process(bent_orbits(spark, sf_dir), config=config).withColumn("changed", F.col("kind").eqNullSafe(F.lit("route_changed")))
    near = F.bool_and(F.when(F.col("changed"), F.abs(F.col("at_us") / 1e6 - _START_SECOND - 480) <= 45))
    left = F.count_if(F.col("kind") == "route_change_candidate") - F.count_if(F.col("kind").isin("route_changed", "route_change_cancelled"))
    return found.groupBy(*lifecycle.KEY).agg(F.count_if("changed").alias("changes"), near.alias("near_the_bend"), left.alias("left_open"))


MOTION_SQL = PHASE_SQL[: PHASE_SQL.index("\nSELECT og.server_id")] + f""",
rp AS (SELECT server_id, median(period) AS pref FROM found WHERE kind = 'route_confirmed' GROUP BY server_id),
mo AS (SELECT fp.server_id, fp.vid, fp.second, (before + len * fr) / total AS phase, sqrt((qx - (x + dx * fr)) ** 2 + (qy - (y + dy * fr)) ** 2) AS dist, dx / len AS te, dy / len AS tn, og.ve, og.vn, f.sa, f.period, pref, CASE WHEN area > 0 THEN 1 ELSE -1 END AS sg
  FROM fp JOIN og ON og.server_id = fp.server_id AND og.vid = fp.vid AND og.second = fp.second JOIN (SELECT * FROM found WHERE kind = 'route_confirmed') f ON f.server_id = fp.server_id AND f.stream = fp.vid JOIN rp ON rp.server_id = fp.server_id
  QUALIFY row_number() OVER (PARTITION BY fp.server_id, fp.vid, fp.second ORDER BY sqrt((qx - (x + dx * fr)) ** 2 + (qy - (y + dy * fr)) ** 2), i) = 1),
mv AS (SELECT *, (phase - lag(phase) OVER w + 0.5 - floor(phase - lag(phase) OVER w + 0.5) - 0.5) * sg / (second - lag(second) OVER w) AS rate FROM mo WINDOW w AS (PARTITION BY server_id, vid ORDER BY second))
SELECT server_id, vid AS vehicle_identifier, count(*) AS frames, {rounded_sql('avg(dist / sa)', 3)} AS distance, {rounded_sql('avg(degrees(acos(greatest(-1.0, least(1.0, (ve * te + vn * tn) * sg / sqrt(ve * ve + vn * vn))))))', 2)} AS tangent,
  {rounded_sql('avg(abs(rate * pref - 1.0))', 3)} AS movement, {rounded_sql('max(abs(period - pref) / pref)', 4)} AS period FROM mv GROUP BY ALL"""


@query(f"WITH {MOTION_SQL}")
def motion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the vehicles of the orbits move on their routes, on average over the frames of each."""
    m = motion.motion_metrics(lifecycle.process(orbits(spark, sf_dir)))
    mean = lambda c, digits: rounded(F.avg(c), digits)
    return m.groupBy(*lifecycle.KEY).agg(F.count("*").alias("frames"), mean("distance_error_b_ratio", 3).alias("distance"), mean("tangent_error_deg", 2).alias("tangent"), mean("movement_error_ratio", 3).alias("movement"), rounded(F.max("period_error_ratio")).alias("period"))
