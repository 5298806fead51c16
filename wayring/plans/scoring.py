"""Queries on vehicle and group scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.config import Band, Scoring, shares
from wayring.functions.scoring import REASONS, band_score, group_scores, with_scores
from wayring.plans.registry import query, rounded, rounded_sql
from wayring.sources.fixtures import primitive_metrics

_C = Scoring()
_SYNC, _ROUTE, _TOTAL = shares(_C.sync_weights), shares(_C.route_weights), shares(_C.total_weights)


def _band(x: str, b: Band) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {b.full} THEN 100.0::DOUBLE WHEN {x} >= {b.zero} THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * ({b.zero}::DOUBLE - {x}) / {b.zero - b.full!r}::DOUBLE END"


METRICS_SQL = """
m AS (SELECT l_orderkey AS group_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS ep,
  CASE WHEN l_linenumber = 7 THEN 'free' WHEN l_returnflag = 'R' THEN 'so' ELSE 'si' END AS family,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 6 THEN FALSE WHEN l_linestatus = 'F' AND l_linenumber = 5 THEN NULL ELSE TRUE END AS active,
  CASE WHEN l_linenumber <> 7 AND l_returnflag = 'R' THEN l_quantity * 0.006::DOUBLE ELSE l_quantity * 0.8::DOUBLE END AS position_error,
  abs(l_discount) * 2.5::DOUBLE AS period_error_ratio, abs(l_tax) * 5.0::DOUBLE AS movement_error_ratio, abs(l_discount) * 3.5::DOUBLE AS distance_error_b_ratio,
  CASE WHEN l_linenumber <> 4 THEN l_quantity * 1.4::DOUBLE END AS tangent_error_deg, l_extendedprice / 100000.0::DOUBLE AS curvature_error_ratio,
  1.0::DOUBLE - abs(l_tax) * 5.5::DOUBLE AS reliability, l_quantity / 50.0::DOUBLE AS speed_fraction, CASE WHEN l_quantity >= 48 THEN 60.0 ELSE 0.0 END AS wrong_direction_seconds
  FROM lineitem)"""

_LOSS = [w * _TOTAL[0] for w in _SYNC] + [w * _TOTAL[1] for w in _ROUTE]
_PARTS = ["c_position", "c_period", "c_movement", "c_distance", "c_tangent", "c_curvature"]


def _mean(parts: list[str], weights: tuple[float, ...]) -> str:
    top = " + ".join(f"coalesce({p} * {w!r}::DOUBLE, 0.0::DOUBLE)" for p, w in zip(parts, weights, strict=True))
    bottom = " + ".join(f"CASE WHEN {p} IS NULL THEN 0.0::DOUBLE ELSE {w!r}::DOUBLE END" for p, w in zip(parts, weights, strict=True))
    return f"(0.0::DOUBLE + {top}) / (0.0::DOUBLE + {bottom})"


SCORES_SQL = f"""WITH {METRICS_SQL},
v AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ln, pk, sk, ep) AS position, speed_fraction < {_C.least_speed_fraction} AS low_speed,
  CASE WHEN active IS NOT TRUE THEN 'inactive' WHEN reliability < {_C.least_reliability} THEN 'low_reliability' WHEN family = 'free' THEN 'free_route' END AS invalid_reason FROM m),
c0 AS (SELECT *, invalid_reason IS NULL AS valid,
  CASE WHEN family = 'si' THEN {_band("position_error", _C.si_position)} ELSE {_band("position_error", _C.so_position)} END AS p_position,
  {_band("period_error_ratio", _C.period)} AS p_period, {_band("movement_error_ratio", _C.movement)} AS p_movement, {_band("distance_error_b_ratio", _C.distance)} AS p_distance,
  CASE WHEN NOT low_speed THEN {_band("tangent_error_deg", _C.tangent)} END AS p_tangent, CASE WHEN NOT low_speed THEN {_band("curvature_error_ratio", _C.curvature)} END AS p_curvature FROM v),
c AS (SELECT *, {", ".join(f"CASE WHEN valid THEN p_{x[2:]} END AS {x}" for x in _PARTS)} FROM c0),
l AS (SELECT *, {", ".join(f"(100.0::DOUBLE - {c}) * {w!r}::DOUBLE AS loss_{r}" for c, w, r in zip(_PARTS, _LOSS, REASONS, strict=True))},
  valid AND family = 'si' AND NOT low_speed AND wrong_direction_seconds >= 60 AS backwards FROM c),
r AS (SELECT *, CASE WHEN valid THEN CASE WHEN backwards THEN 0.0::DOUBLE ELSE {_mean(_PARTS[:3], _SYNC)} END END AS sync_raw,
  CASE WHEN valid THEN {_mean(_PARTS[3:], _ROUTE)} END AS route_raw, greatest({", ".join(f"coalesce(loss_{x}, -1.0)" for x in REASONS)}) AS worst FROM l),
s AS (SELECT *, round(sync_raw, 6) AS sync, round(route_raw, 6) AS route, CASE WHEN valid THEN round({_mean(["sync_raw", "route_raw"], _TOTAL)}, 6) END AS total,
  CASE WHEN NOT valid THEN invalid_reason WHEN backwards THEN 'wrong_direction' WHEN worst > 0 THEN CASE {" ".join(f"WHEN loss_{x} = worst THEN '{x}'" for x in REASONS)} END END AS primary_reason FROM r)"""

GROUPS_SQL = (
    SCORES_SQL
    + """,
g AS (SELECT group_id, count(*) AS members, count(*) FILTER (valid) AS valid_vehicles, sum(sync) FILTER (valid) AS s, sum(route) FILTER (valid) AS r, sum(total) FILTER (valid) AS t FROM s GROUP BY group_id),
w AS (SELECT group_id, primary_reason FROM (SELECT group_id, primary_reason, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min(position)) AS k FROM s WHERE valid AND primary_reason IS NOT NULL GROUP BY group_id, primary_reason) WHERE k = 1),
gs AS (SELECT g.*, valid_vehicles >= 2 AS valid, CASE WHEN valid_vehicles >= 2 THEN round(s / valid_vehicles, 6) END AS sync, CASE WHEN valid_vehicles >= 2 THEN round(r / valid_vehicles, 6) END AS route,
  CASE WHEN valid_vehicles >= 2 THEN round(t / valid_vehicles, 6) END AS total, CASE WHEN valid_vehicles >= 2 THEN w.primary_reason ELSE 'insufficient_coverage' END AS primary_reason FROM g LEFT JOIN w USING (group_id))
"""
)


def _scored(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    return with_scores(primitive_metrics(spark, sf_dir, position))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_scores(_scored(spark, sf_dir, position=True), "group_id", "position")


@query(f"SELECT l_quantity AS quantity, {rounded_sql(_band('l_quantity * 0.8::DOUBLE', _C.si_position))} AS si_score, {rounded_sql(_band('l_quantity * 0.006::DOUBLE', _C.so_position))} AS so_score, {rounded_sql(_band('l_quantity * 1.4::DOUBLE', _C.tangent))} AS tangent_score FROM (SELECT DISTINCT l_quantity FROM lineitem)")
def score_error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("quantity")).distinct()
    x = F.col("quantity")
    return q.select("quantity", rounded(band_score(x * 0.8, _C.si_position)).alias("si_score"), rounded(band_score(x * 0.006, _C.so_position)).alias("so_score"), rounded(band_score(x * 1.4, _C.tangent)).alias("tangent_score"))


@query(f"{SCORES_SQL} SELECT group_id, position, valid, {rounded_sql('sync')} AS sync, {rounded_sql('route')} AS route, {rounded_sql('total')} AS total FROM s")
def vehicle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True).select("group_id", F.col("position").cast("long").alias("position"), "valid", *(rounded(c).alias(c) for c in ("sync", "route", "total")))


@query(f"{SCORES_SQL} SELECT coalesce(invalid_reason, 'valid') AS reason, family, count(*) AS vehicles FROM s GROUP BY 1, 2")
def vehicle_validity_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy(F.coalesce("invalid_reason", F.lit("valid")).alias("reason"), "family").agg(F.count("*").alias("vehicles"))


@query(f"{SCORES_SQL} SELECT group_id, position, primary_reason FROM s WHERE valid")
def primary_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True).where("valid").select("group_id", F.col("position").cast("long").alias("position"), "primary_reason")


@query(f"{SCORES_SQL} SELECT low_speed, count(*) AS vehicles, count(c_tangent) AS with_tangent, count(c_curvature) AS with_curvature, {rounded_sql('avg(route)', 3)} AS mean_route FROM s WHERE valid GROUP BY 1")
def low_speed_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).where("valid")
    return s.groupBy("low_speed").agg(F.count("*").alias("vehicles"), F.count("c_tangent").alias("with_tangent"), F.count("c_curvature").alias("with_curvature"), rounded(F.avg("route"), 3).alias("mean_route"))


@query(f"{SCORES_SQL} SELECT group_id, position, {rounded_sql('sync')} AS sync, {rounded_sql('total')} AS total, primary_reason FROM s WHERE backwards")
def wrong_direction_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True).where("backwards").select("group_id", F.col("position").cast("long").alias("position"), rounded("sync").alias("sync"), rounded("total").alias("total"), "primary_reason")


@query(f"{GROUPS_SQL} SELECT group_id, members, valid_vehicles, valid, {rounded_sql('sync', 3, 1.3e-5)} AS sync, {rounded_sql('route', 3, 1.3e-5)} AS route, {rounded_sql('total', 3, 1.3e-5)} AS total FROM gs", name="group_scores")
def group_scores_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("group_id", "members", "valid_vehicles", "valid", *(rounded(c, 3, 1.3e-5).alias(c) for c in ("sync", "route", "total")))


@query(f"{GROUPS_SQL} SELECT group_id, primary_reason FROM gs")
def group_primary_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("group_id", "primary_reason")


@query(f"{GROUPS_SQL} SELECT group_id, {rounded_sql('total', 3, 1.3e-5)} AS total, valid_vehicles, primary_reason FROM gs WHERE valid ORDER BY {rounded_sql('total', 3, 1.3e-5)}, group_id LIMIT 20")
def lowest_groups_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).where("valid").select("group_id", rounded("total", 3, 1.3e-5).alias("total"), "valid_vehicles", "primary_reason").orderBy("total", "group_id").limit(20)


@query(f"{SCORES_SQL} " + " UNION ALL ".join(f"SELECT '{r}' AS reason, count(loss_{r}) AS vehicles, {rounded_sql(f'avg(loss_{r})', 3)} AS mean_loss, {rounded_sql(f'max(loss_{r})', 3)} AS max_loss FROM s WHERE valid" for r in REASONS))
def reason_loss_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(r).alias("reason"), F.col(f"loss_{r}").alias("loss")) for r in REASONS))
    each = _scored(spark, sf_dir).where("valid").select(F.explode(pairs).alias("x")).select("x.*")
    return each.groupBy("reason").agg(F.count("loss").alias("vehicles"), rounded(F.avg("loss"), 3).alias("mean_loss"), rounded(F.max("loss"), 3).alias("max_loss"))


@query(f"{GROUPS_SQL} SELECT {rounded_sql('valid_vehicles / members')} AS coverage, count(*) AS groups, {rounded_sql('avg(total)', 3)} AS mean_total FROM gs GROUP BY 1")
def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage is told beside the mean and does not change it."""
    return _groups(spark, sf_dir).groupBy(rounded(F.col("valid_vehicles") / F.col("members")).alias("coverage")).agg(F.count("*").alias("groups"), rounded(F.avg("total"), 3).alias("mean_total"))
