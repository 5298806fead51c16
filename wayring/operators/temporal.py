"""Temporal join of independently sampled metric series onto a regular UTC grid.

Everything is keyed by (server_id, vehicle_number): one shuffle brings a stream together, and sorted running
windows do the rest.  "The next point" is a running window over the descending order, so no frame is unbounded
on both sides and the cost stays linear in the length of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayring.config import Join
from wayring.session import spread

STREAM = ["server_id", "vehicle_number"]
NUMERIC = ("latitude_deg", "longitude_deg", "altitude_m", "velocity_north_mps", "velocity_east_mps")
METRICS = ("vehicle_identifier", "active", *NUMERIC)


def conflicts(points: DataFrame) -> DataFrame:
    """Points of one metric, stream and time with different values: how many and between which bounds."""
    same = points.groupBy(*STREAM, "metric", "source_time").agg(F.count("*").alias("points"), F.min("value").alias("low"), F.max("value").alias("high"))
    return same.where(F.col("low") != F.col("high"))


def deduplicated(points: DataFrame, strict: bool = False) -> DataFrame:
    """One value per metric, stream and time; with ``strict`` differing values are an error.

    Otherwise the first one stays: by ``ingest_order`` where the points have that column, else the least.
    """
    low, high = F.min("value"), F.max("value")
    first = F.min_by("value", "ingest_order") if "ingest_order" in points.columns else low
    value = F.when(low != high, F.raise_error(F.lit("conflicting values at one time")).cast("double")).otherwise(low) if strict else first
    return points.groupBy(*STREAM, "metric", "source_time").agg(value.alias("value"))


def active_flag(number: Column, text: Column, cfg: Join = Join()) -> Column:
    """Truth of an active value: 1 and 0 as numbers, the configured spellings as text; anything else is an error."""
    spelled = F.coalesce(F.lower(F.trim(text)), F.when(number == 1, "1").when(number == 0, "0").otherwise(number.cast("string")))
    return (
        F.when(spelled.isNull(), F.lit(None).cast("boolean"))
        .when(spelled.isin(*(v.lower() for v in cfg.on_values)), True)
        .when(spelled.isin(*(v.lower() for v in cfg.off_values)), False)
        .otherwise(F.raise_error(F.concat(F.lit("active value is not mapped: "), spelled)).cast("boolean"))
    )


def identifier_value(number: Column) -> Column:
    """A whole number from 0 on; anything else is an error."""
    fits = (number >= 0) & (number < 2.0**63) & (number == F.floor(number))
    return F.when(number.isNull(), F.lit(None).cast("long")).when(fits, number.cast("long")).otherwise(F.raise_error(F.lit("vehicle identifier is no whole number")).cast("long"))


def finite(value: Column) -> Column:
    """The value; NaN and the infinities are an error."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("numeric value is not finite")).cast("double")).otherwise(value)


def by_time(points: DataFrame) -> DataFrame:
    """One row per stream and time with a column for each metric."""
    return points.groupBy(*STREAM, F.col("source_time").alias("time")).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in METRICS))


def stream_grid(points: DataFrame, cfg: Join = Join(), start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Every grid time of every stream, from its first point (or ``start``) to its last one (or ``end``)."""
    bounds = points.groupBy(*STREAM).agg(F.min("source_time").alias("first"), F.max("source_time").alias("last"))
    low = F.greatest(start, F.col("first")) if start is not None else F.col("first")
    high = F.least(end, F.col("last") + F.expr(f"INTERVAL {cfg.tolerance_seconds} SECONDS")) if end is not None else F.col("last")
    step = cfg.grid_seconds * 1_000_000
    first = F.ceil(F.unix_micros(low.cast("timestamp")) / step).cast("long")
    last = F.floor(F.unix_micros(high.cast("timestamp")) / step).cast("long")
    ticks = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    return bounds.select(*STREAM, ticks.alias("tick")).select(*STREAM, F.timestamp_micros(F.col("tick") * step).alias("time"))


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)).cast("double") / 1e6


def asof_rows(points: DataFrame, cfg: Join = Join(), start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Grid rows with, for each metric, the last point at or before them and the next one at or after them.

    Numeric points carry the identifier and activity that held at their own time.
    """
    wide = by_time(points).withColumn("on_grid", F.lit(False))
    grid = stream_grid(points, cfg, start, end).withColumn("on_grid", F.lit(True))
    # narrow rows grow wide in the windows and are sorted again then, so a task gets few of them
    rows = spread(wide.unionByName(grid, allowMissingColumns=True), *STREAM, times=4).withColumn("time", F.col("time").cast("timestamp"))
    up = Window.partitionBy(*STREAM).orderBy("time", "on_grid").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*STREAM).orderBy(F.col("time").desc(), F.col("on_grid").asc()).rowsBetween(Window.unboundedPreceding, 0)

    def point(metric: str, *more: str) -> Column:
        return F.when(F.col(metric).isNotNull(), F.struct("time", F.col(metric).alias("value"), *more))

    rows = rows.withColumns({"id_last": F.last(point("vehicle_identifier"), ignorenulls=True).over(up), "active_last": F.last(point("active"), ignorenulls=True).over(up)})
    for name in ("id", "active"):
        fresh = _seconds(F.col("time"), F.col(f"{name}_last.time")) <= cfg.tolerance_seconds
        rows = rows.withColumns({f"{name}_now": F.when(fresh, F.col(f"{name}_last.value")), f"{name}_age": F.when(fresh, _seconds(F.col("time"), F.col(f"{name}_last.time")))})
    rows = rows.withColumns({f"{m}_before": F.last(point(m, "id_now", "active_now"), ignorenulls=True).over(up) for m in NUMERIC})
    rows = rows.withColumns({f"{m}_after": F.last(point(m, "id_now", "active_now"), ignorenulls=True).over(down) for m in NUMERIC})
    return rows.where("on_grid").drop("on_grid", *METRICS)


def with_numeric(rows: DataFrame, metric: str, cfg: Join = Join(), guard: bool = True) -> DataFrame:
    """Adds ``<metric>``, ``<metric>_quality`` and ``<metric>_distance``: exact, or interpolated between fresh neighbours.

    With ``guard`` an interpolated value needs the grid's identifier, and no inactivity, at both neighbours.
    """
    before, after = F.col(f"{metric}_before"), F.col(f"{metric}_after")
    back, ahead = _seconds(F.col("time"), before["time"]), _seconds(after["time"], F.col("time"))
    exact = back == 0
    near = (back <= cfg.tolerance_seconds) & (ahead <= cfg.tolerance_seconds)
    if guard:
        for side in (before, after):
            near = near & side["id_now"].eqNullSafe(F.col("id_now")) & F.coalesce(side["active_now"] != 0, F.lit(True))
    low, high = finite(before["value"]), finite(after["value"])
    between = low + (high - low) * (back / F.nullif(back + ahead, F.lit(0.0)))
    return rows.withColumns(
        {
            metric: F.when(exact, low).when(near, between),
            f"{metric}_quality": F.when(exact, "original").when(near, "interpolated").otherwise("missing"),
            f"{metric}_distance": F.when(exact, F.lit(0.0)).when(near, F.greatest(back, ahead)),
        }
    )


def field_reliability(distance: Column, cfg: Join = Join()) -> Column:
    """1 for originals, falling linearly with the distance to the tolerance; null where the field is missing."""
    fraction = F.least(F.lit(1.0), distance / F.lit(float(cfg.tolerance_seconds)))
    return F.when(distance.isNotNull(), F.lit(cfg.original) - F.lit(cfg.original - cfg.approximated) * fraction)


def join_metrics(points: DataFrame, cfg: Join = Join(), start: Column | None = None, end: Column | None = None, strict: bool = False) -> DataFrame:
    """Vehicle samples on the grid from long metric points (``server_id, vehicle_number, metric, source_time, value``).

    An activity may come as text in a further column ``text``; it is read by the configured spellings.
    Rows without an identifier, and rows without a position unless inactive, are left out.  Null times or
    metrics never match; an empty table gives an empty table; equal points at one time count once.
    """
    if "text" in points.columns:
        spelled = (F.col("metric") == "active") & F.col("text").isNotNull()
        points = points.withColumn("value", F.when(spelled, active_flag(F.lit(None).cast("double"), F.col("text"), cfg).cast("double")).otherwise(F.col("value")))
    rows = asof_rows(deduplicated(points.where("source_time is not null and metric is not null and value is not null"), strict), cfg, start, end).where("id_now is not null")
    for metric in NUMERIC:
        rows = with_numeric(rows, metric, cfg)
    half = F.col("latitude_deg").isNull() | F.col("longitude_deg").isNull()
    distances = {"vehicle_identifier": F.col("id_age"), "active": F.col("active_age"), **{m: F.col(f"{m}_distance") for m in NUMERIC}}
    filled = lambda age: F.when(age == 0, "original").when(age > 0, "forward_filled").otherwise("missing")
    quality = {"vehicle_identifier": filled(F.col("id_age")), "active": filled(F.col("active_age")), **{m: F.col(f"{m}_quality") for m in NUMERIC}}
    for m in ("latitude_deg", "longitude_deg"):
        quality[m] = F.when(half, "missing").otherwise(quality[m])
    active = active_flag(F.col("active_now"), F.lit(None).cast("string"), cfg)
    out = rows.select(
        F.col("time").alias("sample_time"),
        *STREAM,
        identifier_value(F.col("id_now")).alias("vehicle_identifier"),
        active.alias("active"),
        *(F.when(~half, F.col(m)).alias(m) if m in ("latitude_deg", "longitude_deg") else F.col(m) for m in NUMERIC),
        F.coalesce(F.least(*(field_reliability(d, cfg) for d in distances.values())), F.lit(0.0)).alias("reliability"),
        F.create_map(*(x for m in METRICS for x in (F.lit(m), quality[m]))).alias("field_quality"),
    )
    return out.where(F.col("latitude_deg").isNotNull() | F.col("active").eqNullSafe(F.lit(False)))
