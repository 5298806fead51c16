"""Generators of vehicle samples: circles and stadiums in closed form, one row per vehicle and second."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.functions.geo import wgs84
from wayring.session import spread

START = "2026-01-01 00:00:00"


def circle_at(t: Column, radius: Column, period: Column, phase_deg: Column, sign: Column, noise_m: float = 0.0, seed: int = 1) -> dict[str, Column]:
    """Position and velocity on a circle; ``sign`` is 1 counterclockwise, -1 clockwise."""
    omega = sign * (2.0 * math.pi) / period
    angle = F.radians(phase_deg) + omega * t
    east, north = radius * F.cos(angle), radius * F.sin(angle)
    if noise_m:
        east, north = east + F.randn(seed) * noise_m, north + F.randn(seed + 1) * noise_m
    return {"east": east, "north": north, "v_east": -radius * F.sin(angle) * omega, "v_north": radius * F.cos(angle) * omega}


def stadium_at(t: Column, half_length: float, radius: float, period: Column, phase_deg: Column, sign: Column) -> dict[str, Column]:
    """Position and velocity on a stadium of half circles joined by straights."""
    half, turn = half_length - radius, math.pi * radius
    around = 4.0 * half + 2.0 * turn
    s = F.pmod((phase_deg / 360.0 + sign * t / period) * around, F.lit(around))
    right, left = (s - 2.0 * half) / radius - math.pi / 2, (s - 4.0 * half - turn) / radius + math.pi / 2
    bottom, first_turn, top = s < 2.0 * half, s < 2.0 * half + turn, s < 4.0 * half + turn
    pick = lambda a, b, c, d: F.when(bottom, a).when(first_turn, b).when(top, c).otherwise(d)
    speed = sign * around / period
    return {
        "east": pick(s - half, F.cos(right) * radius + half, (s - 2.0 * half - turn) * -1.0 + half, F.cos(left) * radius - half),
        "north": pick(F.lit(-radius), F.sin(right) * radius, F.lit(radius), F.sin(left) * radius),
        "v_east": pick(F.lit(1.0), -F.sin(right), F.lit(-1.0), -F.sin(left)) * speed,
        "v_north": pick(F.lit(0.0), F.cos(right), F.lit(0.0), F.cos(left)) * speed,
    }


def circle_samples(spark: SparkSession, vehicles: list[tuple[int, int, float]], seconds: int, server: int = 1, radius: float = 100.0, period: float = 120.0, clockwise: bool = True, step: int = 1, noise_m: float = 0.0, seed: int = 1, center: tuple[float, float] = (31.8, 34.8)) -> DataFrame:
    """Samples of (number, identifier, phase in degrees) on one circle, both ends of the time included."""
    if seconds < 0 or step <= 0 or radius <= 0 or period <= 0:
        raise ValueError("durations, steps, radii and periods must be positive")
    fleet = spark.createDataFrame(vehicles, "vehicle_number long, vehicle_identifier long, phase double")
    rows = spark.range(0, seconds + 1, step).withColumnRenamed("id", "second").crossJoin(F.broadcast(fleet))  # a stated, small fleet
    at = circle_at(F.col("second").cast("double"), F.lit(radius), F.lit(period), F.col("phase"), F.lit(-1.0 if clockwise else 1.0), noise_m, seed)
    place = wgs84(at["east"], at["north"], F.lit(center[0]), F.lit(center[1]))
    return rows.select(
        (F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col("second"))).alias("sample_time"), F.lit(server).cast("long").alias("server_id"), "vehicle_number", "vehicle_identifier", F.lit(True).alias("active"),
        place["lat"].alias("latitude_deg"), place["lon"].alias("longitude_deg"), at["v_north"].alias("velocity_north_mps"), at["v_east"].alias("velocity_east_mps"), F.lit(1.0).alias("reliability"),
    )


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers over many tasks: each makes hundreds of rows, and a table of few bytes is read by one task."""
    return spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", "s_suppkey"), "s_suppkey")


def orbits(spark: SparkSession, sf_dir: str, seconds: int = 360) -> DataFrame:
    """Noise-free orbits from suppliers: circles and, for every third, stadiums; some with a bump, a gap or a stop."""
    k = F.col("s_suppkey")
    rows = _suppliers(spark, sf_dir).select("s_nationkey", "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(seconds))).alias("second"))
    rows = rows.where(~((k % 10 == 9) & F.col("second").between(150, 179)))
    t, sign = F.col("second").cast("double"), F.when(k % 2 == 1, -1.0).otherwise(1.0)
    period, phase = (k % 5 * 15 + 90).cast("double"), (k * 37 % 360).cast("double")
    round_, long_ = circle_at(t, (k % 7 * 15 + 60).cast("double"), period, phase, sign), stadium_at(t, 150.0, 40.0, period, phase, sign)
    at = {name: F.when(k % 3 == 0, long_[name]).otherwise(round_[name]) for name in round_}
    bump = F.when((k % 4 == 0) & (F.col("second") == 120), 120.0).otherwise(0.0)
    place = wgs84(at["east"] + bump, at["north"], F.lit(31.8), F.lit(34.8))
    return rows.select(
        F.col("s_nationkey").cast("long").alias("server_id"), k.alias("vehicle_number"), (k + 100).alias("vehicle_identifier"), F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col("second")).alias("sample_time"),
        (~((k % 13 == 5) & (F.col("second") >= 200))).alias("active"), place["lat"].alias("latitude_deg"), place["lon"].alias("longitude_deg"),
        at["v_north"].alias("velocity_north_mps"), at["v_east"].alias("velocity_east_mps"), F.lit(1.0).alias("reliability"),
    )


def bent_orbits(spark: SparkSession, sf_dir: str, bend: int = 480, seconds: int = 750) -> DataFrame:
    """Circles from suppliers that change at ``bend``: of four, one keeps on, one grows by two fifths, one slows to a period longer by as much, one grows for 45 seconds only."""
    k = F.col("s_suppkey")
    rows = _suppliers(spark, sf_dir).select("s_nationkey", "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(seconds))).alias("second"))
    t, late = F.col("second").cast("double"), F.col("second") >= bend
    grown = late & ((k % 4 == 1) | ((k % 4 == 3) & (F.col("second") < bend + 45)))
    radius = (k % 7 * 15 + 60) * F.when(grown, 1.4).otherwise(1.0)
    slow = late & (k % 4 == 2)
    # a slower vehicle goes on from where it is
    own = F.when(slow, bend + (t - bend) / 1.4).otherwise(t)
    at = circle_at(own, radius, (k % 5 * 15 + 90).cast("double"), (k * 37 % 360).cast("double"), F.when(k % 2 == 1, -1.0).otherwise(1.0))
    pace = F.when(slow, 1.0 / 1.4).otherwise(1.0)
    place = wgs84(at["east"], at["north"], F.lit(31.8), F.lit(34.8))
    return rows.select(
        F.col("s_nationkey").cast("long").alias("server_id"), k.alias("vehicle_number"), (k + 100).alias("vehicle_identifier"), F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col("second")).alias("sample_time"),
        F.lit(True).alias("active"), place["lat"].alias("latitude_deg"), place["lon"].alias("longitude_deg"), (at["v_north"] * pace).alias("velocity_north_mps"), (at["v_east"] * pace).alias("velocity_east_mps"), F.lit(1.0).alias("reliability"),
    )


def looped_orbits(spark: SparkSession, sf_dir: str, seconds: int = 300) -> DataFrame:
    """Closed tracks from suppliers: of four, a circle, a stadium, a figure of eight and a loop within a loop."""
    k = F.col("s_suppkey")
    rows = _suppliers(spark, sf_dir).select("s_nationkey", "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(seconds))).alias("second"))
    t, sign, period, phase = F.col("second").cast("double"), F.when(k % 8 >= 4, -1.0).otherwise(1.0), (k % 5 * 15 + 90).cast("double"), (k * 37 % 360).cast("double")
    size = (k % 7 * 15 + 60).cast("double")
    circle, stadium = circle_at(t, size, period, phase, sign), stadium_at(t, 150.0, 40.0, period, phase, sign)
    angle = F.radians(phase) + sign * (2.0 * math.pi) / period * t
    eight = {"east": size * 1.5 * F.sin(angle), "north": size * F.sin(angle * 2.0)}
    reach = size * (F.cos(angle) * 1.6 + 0.7)
    loop = {"east": reach * F.cos(angle), "north": reach * F.sin(angle)}
    at = {c: F.when(k % 4 == 0, circle[c]).when(k % 4 == 1, stadium[c]).when(k % 4 == 2, eight[c]).otherwise(loop[c]) for c in ("east", "north")}
    place = wgs84(at["east"], at["north"], F.lit(31.8), F.lit(34.8))
    return rows.select(
        F.col("s_nationkey").cast("long").alias("server_id"), (k + 100).alias("vehicle_identifier"), F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col("second")).alias("sample_time"),
        F.lit(True).alias("active"), place["lat"].alias("latitude_deg"), place["lon"].alias("longitude_deg"), F.lit(1.0).alias("reliability"),
    )
