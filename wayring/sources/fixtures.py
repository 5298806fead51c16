"""Adapters from the generic tables to the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def primitive_metrics(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    """One row of error metrics per line of an order; the order is the group.

    ``position`` adds the line's place in its order by the full row, for ties told by first occurrence.
    """
    line = table(spark, sf_dir, "lineitem")
    so = F.col("l_returnflag") == "R"
    free = F.col("l_linenumber") == 7
    out = line.select(
        F.col("l_orderkey").alias("group_id"),
        *(("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice") if position else ()),
        F.when(free, "free").when(so, "so").otherwise("si").alias("family"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 6), False).when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 5), F.lit(None).cast("boolean")).otherwise(True).alias("active"),
        F.when(~free & so, F.col("l_quantity") * 0.006).otherwise(F.col("l_quantity") * 0.8).alias("position_error"),
        (F.abs("l_discount") * 2.5).alias("period_error_ratio"),
        (F.abs("l_tax") * 5.0).alias("movement_error_ratio"),
        (F.abs("l_discount") * 3.5).alias("distance_error_b_ratio"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity") * 1.4).alias("tangent_error_deg"),
        (F.col("l_extendedprice") / 100000.0).alias("curvature_error_ratio"),
        (1.0 - F.abs("l_tax") * 5.5).alias("reliability"),
        (F.col("l_quantity") / 50.0).alias("speed_fraction"),
        F.when(F.col("l_quantity") >= 48, 60.0).otherwise(0.0).alias("wrong_direction_seconds"),
    )
    if not position:
        return out
    order = Window.partitionBy("group_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return out.withColumn("position", F.row_number().over(order)).drop("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def raw_points(spark: SparkSession, sf_dir: str, collapse: bool = True) -> DataFrame:
    """Metric points from events: ``server_id, vehicle_number, metric, source_time, value, event_id``.

    ``collapse`` keeps the value of the least event id where one metric of a stream has several at one time.
    """
    e = table(spark, sf_dir, "events")
    user, value = F.col("user_id"), F.col("value")
    late = (F.dayofmonth("ts") > 20) & (user % 5 == 0)
    points = e.select(
        (user % 3).alias("server_id"),
        user.alias("vehicle_number"),
        F.when(F.col("event_type") == "signup", "vehicle_identifier").when(F.col("event_type") == "error", "active").when(F.col("event_type") == "click", "latitude_deg").when(F.col("event_type") == "view", "longitude_deg").when(F.col("event_type") == "purchase", "velocity_north_mps").alias("metric"),
        F.date_trunc("hour", "ts").alias("source_time"),
        F.when(F.col("event_type") == "signup", (user + 100 + F.when(late, 1000).otherwise(0)).cast("double"))
        .when(F.col("event_type") == "error", F.when(value > 5, 1.0).otherwise(0.0))
        .when(F.col("event_type") == "click", value / 1000.0 + 31.0)
        .when(F.col("event_type") == "view", value / 1000.0 + 34.0)
        .when(F.col("event_type") == "purchase", value / 10.0)
        .alias("value"),
        "event_id",
    ).where("metric is not null")
    if not collapse:
        return points
    return points.groupBy("server_id", "vehicle_number", "metric", "source_time").agg(F.min_by("value", "event_id").alias("value"))


def lifecycle_samples(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One sample per event: ``server_id, vehicle_identifier, sample_time, active, event_id``; of the table or a stream of it."""
    e = table(spark, sf_dir, "events") if events is None else events
    return e.select(F.lit(0).cast("long").alias("server_id"), F.col("user_id").alias("vehicle_identifier"), F.col("ts").alias("sample_time"), (F.col("event_type") != "error").alias("active"), "event_id")


def investigation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group events from orders: ``event_id, server_id, family, start, duration_min, score``."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        (F.col("o_custkey") % 3 + 1).alias("server_id"),
        F.when(F.col("o_orderkey") % 2 == 1, "so").otherwise("si").alias("family"),
        F.col("o_orderdate").alias("start"),
        (F.col("o_orderkey") % 50 + 10).alias("duration_min"),
        F.least(F.lit(100.0), F.round(F.col("o_totalprice") / 5000.0, 0)).alias("score"),
    )


def template_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template members from lines: ``group_id, member, vehicle_type, phase``; ``member`` counts from 1 in its group."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.row_number().over(order).alias("member"), F.col("l_returnflag").alias("vehicle_type"), F.pmod(F.col("l_extendedprice") / 105000.0, F.lit(1.0)).alias("phase")
    )
