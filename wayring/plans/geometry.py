"""Queries on geometry, route detection and phases."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.functions import geo
from wayring.operators import detection, topology
from wayring.plans.registry import query, rounded, rounded_sql
from wayring.sources.simulator import looped_orbits, orbits

R = geo.EARTH_RADIUS_M
_PI = repr(math.pi)

# --- a polygon per supplier -------------------------------------------------------------------------------------

POLY_SQL = f"""k AS (SELECT s_suppkey AS k, (60 + 15 * (s_suppkey % 7))::DOUBLE AS r FROM supplier),
pt AS (SELECT k, i, r * cos({2 * math.pi / 16!r}::DOUBLE * i) AS x, 0.6::DOUBLE * r * sin({2 * math.pi / 16!r}::DOUBLE * i) AS y FROM k, range(16) t(i)),
e AS (SELECT a.k, a.i, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len FROM pt a JOIN pt b ON a.k = b.k AND b.i = (a.i + 1) % 16),
sg AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before, sum(len) OVER (PARTITION BY k) AS total FROM e)"""


def _at_phase(name: str, of: str, phase: str) -> str:
    """CTE (the columns of ``of``, px, py, i, fraction): the point at a phase of the supplier's polygon."""
    t = f"(({phase}) - floor({phase}))"
    return f"""{name} AS (SELECT * EXCLUDE (dx, dy, len, before, total, x, y, kk), least(1.0, greatest(0.0, ({t} * total - before) / len)) AS fraction,
  x + dx * least(1.0, greatest(0.0, ({t} * total - before) / len)) AS px, y + dy * least(1.0, greatest(0.0, ({t} * total - before) / len)) AS py FROM
  (SELECT q.*, s.k AS kk, s.i, s.x, s.y, s.dx, s.dy, s.len, s.before, s.total FROM {of} q JOIN sg s ON q.k = s.k)
  QUALIFY row_number() OVER (PARTITION BY k, n ORDER BY CASE WHEN {t} * total < before + len THEN i ELSE CASE WHEN i = 15 THEN 15 ELSE 99 END END) = 1)"""


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7 * 15 + 60).cast("double").alias("r"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: geo.point(F.col("r") * F.cos(i * (2 * math.pi / 16)), F.col("r") * 0.6 * F.sin(i * (2 * math.pi / 16))))
    return s.withColumn("segs", geo.segments(ring))


@query(f"WITH {POLY_SQL} SELECT k, {rounded_sql('max(total)')} AS length_m FROM sg GROUP BY k")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).select("k", rounded(geo.length(F.col("segs"))).alias("length_m"))


@query(f"WITH {POLY_SQL}, q AS (SELECT k, n, (k % 11) / 11.0::DOUBLE + n / 7.0::DOUBLE + 0.001 AS phase FROM k, range(7) t(n)), {_at_phase('a', 'q', 'phase')} SELECT k, n, {rounded_sql('px')} AS x, {rounded_sql('py')} AS y, i AS segment FROM a")
def point_at_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    at = geo.point_at_phase(F.col("segs"), F.col("k") % 11 / F.lit(11.0) + F.col("n") / F.lit(7.0) + 0.001)
    return p.withColumn("at", at).select("k", "n", rounded("at.x").alias("x"), rounded("at.y").alias("y"), F.col("at.segment").cast("long").alias("segment"))


@query(f"WITH {POLY_SQL}, q AS (SELECT k, n, n / 8.0::DOUBLE + 1e-12 AS phase FROM k, range(8) t(n)), {_at_phase('a', 'q', 'phase')} SELECT k, n, {rounded_sql('px')} AS x, {rounded_sql('py')} AS y FROM a")
def resample_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir).select("k", F.posexplode(geo.resampled(F.col("segs"), 8)).alias("n", "p"))
    return p.select("k", F.col("n").cast("long").alias("n"), rounded("p.x").alias("x"), rounded("p.y").alias("y"))


_PROJECT = """c AS (SELECT q.k, q.n, s.i, s.total, s.before, s.len, s.dx, s.dy, least(1.0, greatest(0.0, ((q.qx - s.x) * s.dx + (q.qy - s.y) * s.dy) / (s.len * s.len))) AS f, q.qx, q.qy, s.x, s.y FROM q JOIN sg s ON q.k = s.k),
d AS (SELECT *, sqrt((qx - (x + dx * f)) * (qx - (x + dx * f)) + (qy - (y + dy * f)) * (qy - (y + dy * f))) AS dist FROM c QUALIFY row_number() OVER (PARTITION BY k, n ORDER BY round(sqrt((qx - (x + dx * f)) * (qx - (x + dx * f)) + (qy - (y + dy * f)) * (qy - (y + dy * f))), 9), i) = 1)"""
_QUERY_POINTS = "q AS (SELECT k, n, r * 1.1::DOUBLE * cos(n * 0.83::DOUBLE + k) AS qx, r * 0.7::DOUBLE * sin(n * 0.83::DOUBLE + k) AS qy FROM k, range(9) t(n))"


def _query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    angle = F.col("n") * 0.83 + F.col("k")
    return p.withColumn("hit", geo.project(F.col("segs"), F.col("r") * 1.1 * F.cos(angle), F.col("r") * 0.7 * F.sin(angle), digits=9))


@query(f"WITH {POLY_SQL}, {_QUERY_POINTS}, {_PROJECT} SELECT k, n, {rounded_sql('dist')} AS distance_m, i AS segment, {rounded_sql('(before + len * f) / total')} AS phase FROM d")
def project_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query_points(spark, sf_dir).select("k", "n", rounded("hit.distance").alias("distance_m"), F.col("hit.segment").cast("long").alias("segment"), rounded("hit.phase").alias("phase"))


@query(f"WITH {POLY_SQL}, {_QUERY_POINTS}, {_PROJECT} SELECT k, n, {rounded_sql('degrees(acos(greatest(-1.0, least(1.0, (cos(n + 0.3::DOUBLE) * dx / len + sin(n + 0.3::DOUBLE) * dy / len) / (sqrt(cos(n + 0.3::DOUBLE) * cos(n + 0.3::DOUBLE) + sin(n + 0.3::DOUBLE) * sin(n + 0.3::DOUBLE)) * sqrt(dx / len * dx / len + dy / len * dy / len))))))', 3)} AS error_deg FROM d")
def tangent_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _query_points(spark, sf_dir)
    return p.select("k", "n", rounded(geo.tangent_error_deg(F.col("hit"), F.cos(F.col("n") + 0.3), F.sin(F.col("n") + 0.3)), 3).alias("error_deg"))


@query(f"SELECT s_suppkey AS k, {rounded_sql('least(abs(a - b - floor(a - b)), 1.0 - abs(a - b - floor(a - b)))')} AS distance FROM (SELECT s_suppkey, (s_suppkey % 17) / 17.0::DOUBLE AS a, (s_suppkey % 13) / 13.0::DOUBLE AS b FROM supplier)")
def phase_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("k"), rounded(geo.phase_distance(F.col("s_suppkey") % 17 / F.lit(17.0), F.col("s_suppkey") % 13 / F.lit(13.0))).alias("distance"))


_MENGER = "2.0 * ((b.px - a.px) * (c.py - a.py) - (b.py - a.py) * (c.px - a.px)) / (sqrt((b.px - a.px) ** 2 + (b.py - a.py) ** 2) * sqrt((c.px - b.px) ** 2 + (c.py - b.py) ** 2) * sqrt((c.px - a.px) ** 2 + (c.py - a.py) ** 2))"
_THREE = f"WITH {POLY_SQL}, q AS (SELECT k, n, (k % 11) / 11.0::DOUBLE + (n - 1) * 0.02::DOUBLE + 0.003 AS phase FROM k, range(3) t(n)), {_at_phase('w', 'q', 'phase')}, m AS (SELECT a.k, {_MENGER} AS kappa FROM w a JOIN w b ON a.k = b.k AND b.n = 1 JOIN w c ON a.k = c.k AND c.n = 2 WHERE a.n = 0)"


@query(f"{_THREE} SELECT k, {rounded_sql('kappa', 6)} AS curvature FROM m")
def menger_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir)
    return p.select("k", rounded(geo.curvature_at_phase(F.col("segs"), F.col("k") % 11 / F.lit(11.0) + 0.003), 6).alias("curvature"))


@query(f"{_THREE} SELECT k, {rounded_sql(f'abs(kappa - 1.0 / r) / greatest(abs(1.0 / r), {2 * math.pi!r}::DOUBLE / total)')} AS error FROM m JOIN k USING (k) JOIN (SELECT k, max(total) AS total FROM sg GROUP BY k) USING (k)")
def curvature_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir)
    seen = geo.curvature_at_phase(F.col("segs"), F.col("k") % 11 / F.lit(11.0) + 0.003)
    return p.select("k", rounded(geo.curvature_error(seen, F.lit(1.0) / F.col("r"), geo.length(F.col("segs")))).alias("error"))


# --- orbits and detection ---------------------------------------------------------------------------------------

_AROUND = repr(4.0 * 110.0 + 2.0 * math.pi * 40.0)
_TURN = repr(math.pi * 40.0)
ORBIT_SQL = f"""o0 AS (SELECT s_nationkey::BIGINT AS server_id, s_suppkey AS k, t AS second, t::DOUBLE AS t, (60 + 15 * (s_suppkey % 7))::DOUBLE AS r, (90 + 15 * (s_suppkey % 5))::DOUBLE AS period, (37 * s_suppkey % 360)::DOUBLE AS ph,
  CASE WHEN s_suppkey % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg FROM supplier, range(361) q(t) WHERE NOT (s_suppkey % 10 = 9 AND t BETWEEN 150 AND 179)),
o1 AS (SELECT *, radians(ph) + sg * {2 * math.pi!r}::DOUBLE / period * t AS ang, sg * {2 * math.pi!r}::DOUBLE / period AS om, (ph / 360.0 + sg * t / period) * {_AROUND} - floor(ph / 360.0 + sg * t / period) * {_AROUND} AS s FROM o0),
o2 AS (SELECT *, (s - 220.0) / 40.0 - {math.pi / 2!r} AS ra, (s - 440.0 - {_TURN}) / 40.0 + {math.pi / 2!r} AS la, sg * {_AROUND} / period AS sp, CASE WHEN s < 220.0 THEN 1 WHEN s < 220.0 + {_TURN} THEN 2 WHEN s < 440.0 + {_TURN} THEN 3 ELSE 4 END AS part FROM o1),
o3 AS (SELECT *, k % 3 = 0 AS st, CASE WHEN k % 4 = 0 AND second = 120 THEN 120.0 ELSE 0.0 END AS bump FROM o2),
o AS (SELECT server_id, k + 100 AS vid, second, NOT (k % 13 = 5 AND second >= 200) AS active,
  bump + CASE WHEN st THEN CASE part WHEN 1 THEN s - 110.0 WHEN 2 THEN 110.0 + 40.0 * cos(ra) WHEN 3 THEN 110.0 - (s - 220.0 - {_TURN}) ELSE -110.0 + 40.0 * cos(la) END ELSE r * cos(ang) END AS east,
  CASE WHEN st THEN CASE part WHEN 1 THEN -40.0 WHEN 2 THEN 40.0 * sin(ra) WHEN 3 THEN 40.0 ELSE 40.0 * sin(la) END ELSE r * sin(ang) END AS north,
  CASE WHEN st THEN sp * CASE part WHEN 1 THEN 1.0 WHEN 2 THEN -sin(ra) WHEN 3 THEN -1.0 ELSE -sin(la) END ELSE -r * sin(ang) * om END AS ve,
  CASE WHEN st THEN sp * CASE part WHEN 1 THEN 0.0 WHEN 2 THEN cos(ra) WHEN 3 THEN 0.0 ELSE cos(la) END ELSE r * cos(ang) * om END AS vn FROM o3),
og AS (SELECT *, 31.8::DOUBLE + degrees(north / {R}) AS lat, 34.8::DOUBLE + degrees(east / ({R} * cos(radians(31.8::DOUBLE)))) AS lon FROM o),
u0 AS (SELECT *, count(*) OVER w AS samples, max(second) OVER w - min(second) OVER w AS span FROM og WHERE active WINDOW w AS (PARTITION BY server_id, vid)),
u AS (SELECT * FROM u0 WHERE samples >= 12 AND span >= 300),
med AS (SELECT server_id, vid, median(lat) AS lat0, median(lon) AS lon0 FROM u GROUP BY ALL),
l AS (SELECT u.*, lat0, lon0, radians(lon - lon0) * {R} * cos(radians(lat0)) AS x, radians(lat - lat0) * {R} AS y FROM u JOIN med USING (server_id, vid)),
b0 AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS into_, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS out_, sqrt((lead(x) OVER w - lag(x) OVER w) ** 2 + (lead(y) OVER w - lag(y) OVER w) ** 2) AS bridge FROM l WINDOW w AS (PARTITION BY server_id, vid ORDER BY second)),
bm AS (SELECT server_id, vid, median(into_) FILTER (into_ > 1e-9) AS ms FROM b0 GROUP BY ALL),
b AS (SELECT b0.*, ms, NOT coalesce(into_ > greatest(4.0 * ms, 1.0) AND out_ > greatest(4.0 * ms, 1.0) AND bridge <= greatest(2.5 * ms, 1.5), FALSE) AS keep FROM b0 JOIN bm USING (server_id, vid)),
ef AS (SELECT * EXCLUDE (into_, out_, bridge, ms) FROM b WHERE keep)"""


def _shape_sql(name: str, of: str, robust: bool) -> str:
    mid, low, high = ("median", "0.05", "0.95") if robust else ("avg", "0.0", "1.0")
    return f"""{name}_c AS (SELECT server_id, vid, {mid}(x) AS cx, {mid}(y) AS cy, count(*) AS points FROM {of} GROUP BY ALL),
{name}_m AS (SELECT server_id, vid, avg((x - cx) * (x - cx)) AS xx, avg((y - cy) * (y - cy)) AS yy, avg((x - cx) * (y - cy)) AS xy FROM {of} JOIN {name}_c USING (server_id, vid) GROUP BY ALL),
{name}_t AS (SELECT *, 0.5 * atan2(2.0 * xy, xx - yy) AS tr FROM {name}_m JOIN {name}_c USING (server_id, vid)),
{name}_q AS (SELECT server_id, vid, any_value(cx) AS cx, any_value(cy) AS cy, any_value(tr) AS tr, any_value(points) AS points, any_value(samples) AS samples, any_value(lat0) AS lat0, any_value(lon0) AS lon0,
  (quantile_cont((x - cx) * cos(tr) + (y - cy) * sin(tr), {high}) - quantile_cont((x - cx) * cos(tr) + (y - cy) * sin(tr), {low})) / 2.0 AS a,
  (quantile_cont((y - cy) * cos(tr) - (x - cx) * sin(tr), {high}) - quantile_cont((y - cy) * cos(tr) - (x - cx) * sin(tr), {low})) / 2.0 AS bb FROM {of} JOIN {name}_t USING (server_id, vid) GROUP BY ALL),
{name} AS (SELECT server_id, vid, cx, cy, points, samples, lat0, lon0, greatest(a, bb) AS la, least(a, bb) AS sa, CASE WHEN bb > a THEN tr + {math.pi / 2!r} ELSE tr END AS turn, CASE WHEN greatest(a, bb) / least(a, bb) <= 1.5 THEN 'si' ELSE 'so' END AS family FROM {name}_q)"""


SHAPE_SQL = f"{ORBIT_SQL}, {_shape_sql('sh', 'ef', True)}"
POLYLINE_SQL = f"""{SHAPE_SQL},
al AS (SELECT server_id, vid, i AS i, la * cos(2 * {_PI} * i / 64.0) AS al, sa * sin(2 * {_PI} * i / 64.0) AS ac FROM sh, range(64) q(i) WHERE family = 'si' UNION ALL
 SELECT server_id, vid, i, CASE WHEN i < 24 THEN greatest(la - sa, 0) + sa * cos(-{_PI} / 2 + {_PI} * i / 23.0) WHEN i < 32 THEN greatest(la - sa, 0) * (1.0 - 2.0 * (i - 23) / 9.0) WHEN i < 56 THEN -greatest(la - sa, 0) + sa * cos({_PI} / 2 + {_PI} * (i - 32) / 23.0) ELSE -greatest(la - sa, 0) * (1.0 - 2.0 * (i - 55) / 9.0) END,
  CASE WHEN i < 24 THEN sa * sin(-{_PI} / 2 + {_PI} * i / 23.0) WHEN i < 32 THEN sa WHEN i < 56 THEN sa * sin({_PI} / 2 + {_PI} * (i - 32) / 23.0) ELSE -sa END FROM sh, range(64) q(i) WHERE family = 'so'),
ol AS (SELECT server_id, vid, i, cx + al * cos(turn) - ac * sin(turn) AS x, cy + al * sin(turn) + ac * cos(turn) AS y FROM al JOIN sh USING (server_id, vid)),
os0 AS (SELECT a.server_id, a.vid, a.i, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM ol a JOIN ol b ON a.server_id = b.server_id AND a.vid = b.vid AND b.i = (a.i + 1) % 64),
os AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY server_id, vid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before, sum(len) OVER (PARTITION BY server_id, vid) AS total FROM os0),
pl AS (SELECT server_id, vid, n AS i, x + dx * least(1.0, greatest(0.0, (n / 64.0 * total - before) / len)) AS x, y + dy * least(1.0, greatest(0.0, (n / 64.0 * total - before) / len)) AS y FROM os, range(64) q(n) QUALIFY row_number() OVER (PARTITION BY server_id, vid, n ORDER BY CASE WHEN n / 64.0 * total < before + len OR i = 63 THEN i ELSE 99 END) = 1),
ps0 AS (SELECT a.server_id, a.vid, a.i, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM pl a JOIN pl b ON a.server_id = b.server_id AND a.vid = b.vid AND b.i = (a.i + 1) % 64),
ps AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY server_id, vid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before, sum(len) OVER (PARTITION BY server_id, vid) AS total FROM ps0),
ln AS (SELECT server_id, vid, max(total) AS length_m FROM ps GROUP BY ALL),
st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0) AS step, lag(x) OVER w AS px, lag(y) OVER w AS py, first(x) OVER w AS fx, first(y) OVER w AS fy, row_number() OVER w AS idx,
  coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS he, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS hn FROM ef WINDOW w AS (PARTITION BY server_id, vid ORDER BY second)),
wy AS (SELECT *, sum(step) OVER w AS way, first(he) OVER w AS fhe, first(hn) OVER w AS fhn FROM st WINDOW w AS (PARTITION BY server_id, vid ORDER BY second ROWS UNBOUNDED PRECEDING)),
tr AS (SELECT w.server_id, w.vid, sum(step) AS travelled, max(length_m) AS length_m, sum(step) / max(length_m) AS cycles, bool_or(idx > 1 AND way >= 0.8 * length_m AND sqrt((w.x - fx) ** 2 + (w.y - fy) ** 2) <= greatest(0.2 * sa, 1.0)
  AND degrees(acos(greatest(-1.0, least(1.0, (fhe * he + fhn * hn) / (sqrt(fhe * fhe + fhn * fhn) * sqrt(he * he + hn * hn)))))) <= 30.0) AS closed, sum(coalesce((px - cx) * (w.y - cy) - (py - cy) * (w.x - cx), 0.0)) AS area,
  median(sqrt(ve * ve + vn * vn)) AS speed FROM wy w JOIN sh ON w.server_id = sh.server_id AND w.vid = sh.vid JOIN ln ON w.server_id = ln.server_id AND w.vid = ln.vid GROUP BY ALL)"""
FIT_SQL = f"""{POLYLINE_SQL},
fd AS (SELECT e.server_id, e.vid, e.second, min(sqrt((e.x - (s.x + s.dx * least(1.0, greatest(0.0, ((e.x - s.x) * s.dx + (e.y - s.y) * s.dy) / (s.len * s.len))))) ** 2 + (e.y - (s.y + s.dy * least(1.0, greatest(0.0, ((e.x - s.x) * s.dx + (e.y - s.y) * s.dy) / (s.len * s.len))))) ** 2)) AS d FROM ef e JOIN ps s ON e.server_id = s.server_id AND e.vid = s.vid GROUP BY ALL),
ff AS (SELECT server_id, vid, avg(CASE WHEN d <= greatest(0.2 * sa, 1.0) THEN 1.0 ELSE 0.0 END) AS fit FROM fd JOIN sh USING (server_id, vid) GROUP BY ALL),
rt AS (SELECT sh.*, tr.* EXCLUDE (server_id, vid), fit, length_m / speed AS period, points / samples::DOUBLE AS inlier FROM sh JOIN tr USING (server_id, vid) JOIN ff USING (server_id, vid) WHERE cycles + 1e-9 >= 1 AND closed AND fit + 1e-9 >= 0.7)"""
_ID = "server_id, vid AS vehicle_identifier"


def _orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orbits(spark, sf_dir)


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.bump_masked(detection.localized(detection.usable(_orbits(spark, sf_dir))))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.fitted(_masked(spark, sf_dir).where("keep"), True)


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _masked(spark, sf_dir).where("keep")
    return detection.traced(kept, detection.fitted(kept, True))


@query(f"WITH {ORBIT_SQL} SELECT {_ID}, second, {rounded_sql('x', 3)} AS x_m, {rounded_sql('y', 3)} AS y_m FROM l")
def local_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = detection.localized(detection.usable(_orbits(spark, sf_dir)))
    return p.select(*detection.KEY, (F.unix_timestamp("sample_time") - F.unix_timestamp(F.lit("2026-01-01 00:00:00"))).alias("second"), rounded("x", 3).alias("x_m"), rounded("y", 3).alias("y_m"))


@query(f"WITH {ORBIT_SQL} SELECT {_ID}, count(*) AS samples, count(*) FILTER (NOT keep) AS outliers FROM b GROUP BY ALL")
def bump_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).groupBy(*detection.KEY).agg(F.count("*").alias("samples"), F.count_if(~F.col("keep")).alias("outliers"))


@query(f"WITH {SHAPE_SQL} SELECT {_ID}, {rounded_sql('cx', 3)} AS cx, {rounded_sql('cy', 3)} AS cy, {rounded_sql('la', 3)} AS long_m, {rounded_sql('sa', 3)} AS short_m FROM sh")
def shape_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select(*detection.KEY, *(rounded(c, 3).alias(c) for c in ("cx", "cy", "long_m", "short_m")))


@query(f"WITH {SHAPE_SQL} SELECT family, count(*) AS routes, min(points) AS least_points, max(points) AS most_points FROM sh GROUP BY family")
def route_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).groupBy("family").agg(F.count("*").alias("routes"), F.min("points").alias("least_points"), F.max("points").alias("most_points"))


@query(f"WITH {FIT_SQL} SELECT {_ID}, {rounded_sql('fit')} AS fit_fraction FROM ff")
def fit_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).select(*detection.KEY, rounded("fit_fraction").alias("fit_fraction"))


@query(f"WITH {POLYLINE_SQL} SELECT {_ID}, {rounded_sql('travelled', 2)} AS travelled_m, {rounded_sql('cycles', 3)} AS cycles FROM tr")
def travelled_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).select(*detection.KEY, rounded("travelled_m", 2).alias("travelled_m"), rounded("cycles", 3).alias("cycles"))


@query(f"WITH {POLYLINE_SQL} SELECT {_ID}, closed AS closure_ok FROM tr")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).select(*detection.KEY, "closure_ok")


@query(f"WITH {POLYLINE_SQL} SELECT {_ID}, CASE WHEN abs(area) <= 1e-9 THEN 'unknown' WHEN area > 0 THEN 'counterclockwise' ELSE 'clockwise' END AS direction FROM tr")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).select(*detection.KEY, detection.direction(F.col("signed_area")).alias("direction"))


@query(f"WITH {POLYLINE_SQL} SELECT {_ID}, {rounded_sql('length_m / speed', 3)} AS period_s FROM tr")
def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _masked(spark, sf_dir).where("keep")
    trace = detection.traced(kept, detection.fitted(kept, True))
    return detection.periods(kept, trace.select(*detection.KEY, "length_m", "cycles")).select(*detection.KEY, rounded("period_s", 3).alias("period_s"))


@query(
    f"WITH {FIT_SQL} SELECT {_ID}, family, samples, samples - points AS outliers, {rounded_sql('length_m', 2)} AS length_m, {rounded_sql('period', 3)} AS period_s, {rounded_sql('0.55 * fit + 0.30 * inlier + 0.15', 3)} AS quality, CASE WHEN area > 0 THEN 'counterclockwise' ELSE 'clockwise' END AS direction FROM rt"
)
def detected_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = detection.detect_routes(_orbits(spark, sf_dir))
    return r.select(*detection.KEY, "family", "samples", "outliers", rounded("length_m", 2).alias("length_m"), rounded("period_s", 3).alias("period_s"), rounded("quality", 3).alias("quality"), "direction")


@query(
    f"""WITH {FIT_SQL}, cen AS (SELECT server_id, vid, lat0 + degrees(cy / {R}) AS la0, lon0 + degrees(cx / ({R} * cos(radians(lat0)))) AS lo0 FROM rt),
f AS (SELECT og.server_id, og.vid, second, radians(lon - lo0) * {R} * cos(radians(la0)) AS x, radians(lat - la0) * {R} AS y FROM og JOIN cen USING (server_id, vid) WHERE active),
fc AS (SELECT f.server_id, f.vid, f.second, s.i, s.before, s.len, s.total, least(1.0, greatest(0.0, ((f.x - s.x) * s.dx + (f.y - s.y) * s.dy) / (s.len * s.len))) AS fr, f.x AS qx, f.y AS qy, s.x, s.y, s.dx, s.dy FROM f JOIN ps s ON f.server_id = s.server_id AND f.vid = s.vid),
fb AS (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY server_id, vid, second ORDER BY sqrt((qx - (x + dx * fr)) ** 2 + (qy - (y + dy * fr)) ** 2), i) = 1)
SELECT {_ID}, count(*) AS frames, {rounded_sql('avg(sqrt((qx - (x + dx * fr)) ** 2 + (qy - (y + dy * fr)) ** 2))', 3)} AS mean_distance_m FROM fb GROUP BY ALL"""
)
def route_phase_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orbits(spark, sf_dir)
    placed = o.select(*detection.KEY, "sample_time", "active", "latitude_deg", "longitude_deg")
    f = detection.with_phase(placed, detection.detect_routes(o)).where("route_id is not null")
    return f.groupBy(*detection.KEY).agg(F.count("*").alias("frames"), rounded(F.avg("distance_m"), 3).alias("mean_distance_m"))


@query(
    "SELECT s_nationkey::BIGINT AS server_id, s_suppkey + 100 AS vehicle_identifier, CASE s_suppkey % 4 WHEN 2 THEN 'self_crossing' WHEN 3 THEN 'double' ELSE 'simple' END AS topology, CASE s_suppkey % 4 WHEN 2 THEN 'figure_eight' WHEN 3 THEN 'double_hippodrome' ELSE 'simple' END AS subtype, CASE WHEN s_suppkey % 4 >= 2 THEN 1 ELSE 0 END::BIGINT AS crossings FROM supplier"
)
def route_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles and stadiums are simple, figures of eight and double loops are found as what they are."""
    found = topology.classified(topology.first_cycles(looped_orbits(spark, sf_dir)))
    return found.select(*detection.KEY, "topology", "subtype", F.size("crossings").cast("long").alias("crossings"))
