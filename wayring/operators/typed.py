"""Typed raw values: metric points whose value is a VARIANT, sorted out into readable ones and refused ones with reasons.

Values are equal as the surveyed engine takes them: true and 1, 107 and 107.0 are, "1" and 1 are not.  A point that
cannot be read, or that differs from an earlier one of its metric, stream and time, is refused and kept with its
reason; copies of one value are counted before anything is shuffled by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayring.config import Join
from wayring.operators.temporal import METRICS, STREAM

#: Numbers as text: what a conversion to floating point accepts; underscores may stand between digits.
NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
NOT_FINITE = r"^\s*[+-]?(?i)(nan|inf|infinity)\s*$"


def kind_of(value: Column) -> Column:
    """``boolean``, ``number``, ``text``, ``none`` or ``other`` (objects and arrays)."""
    name = F.schema_of_variant(value)
    number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    return F.when(value.isNull() | (name == "VOID"), "none").when(name == "BOOLEAN", "boolean").when(number, "number").when(name == "STRING", "text").otherwise("other")


def number_of(value: Column, kind: Column) -> Column:
    """The value as floating point: truth as 1 and 0, text if it spells a number; NaN for what is not finite, null for the rest."""
    text = F.try_variant_get(value, "$", "string")
    spelled = F.regexp_replace(F.trim(text), "_", "").try_cast("double")
    return (
        F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
        .when(kind == "number", F.try_variant_get(value, "$", "double"))
        .when((kind == "text") & text.rlike(NUMBER), spelled)
        .when((kind == "text") & text.rlike(NOT_FINITE), F.lit(float("nan")))
    )


def identity_of(value: Column, kind: Column) -> Column:
    """What equality compares: truth and numbers by number (those from 2**53 on, all whole, by their digits), text by itself."""
    number = F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("int").cast("double")).when(kind == "number", F.try_variant_get(value, "$", "double"))
    digits = F.try_variant_get(value, "$", "decimal(38,0)")
    whole = (kind == "number") & (F.abs(number) >= 2.0**53) & digits.isNotNull()
    text = F.when(whole, digits.cast("string")).when(kind.isin("text", "other"), F.try_variant_get(value, "$", "string"))
    return F.struct(F.when(kind == "boolean", "number").otherwise(kind).alias("kind"), F.when(~whole, number).alias("number"), text.alias("text"))


def read(points: DataFrame, cfg: Join = Join()) -> DataFrame:
    """Adds ``value_number`` (what the temporal join takes) and ``reason``, null where the point can be read."""
    kind, value = F.col("__kind"), F.col("value")
    p = points.withColumn("__kind", kind_of(value)).withColumn("__number", number_of(value, kind))
    number = F.col("__number")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    spelled = F.lower(F.trim(F.try_variant_get(value, "$", "string")))
    # a number with a point is spelled with it, so that 1.0 is no spelling of 1
    spelled = F.when((kind == "number") & (F.schema_of_variant(value) != "BIGINT"), F.concat(spelled, F.lit("."))).otherwise(spelled)
    on = F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean")).when(spelled.isin(*(v.lower() for v in cfg.on_values)), True).when(spelled.isin(*(v.lower() for v in cfg.off_values)), False)
    whole = (number >= 0) & (number < 2.0**63) & (number == F.floor(number))
    reason = (
        F.when(F.col("source_time").isNull(), "no_time")
        .when(F.col("metric").isNull() | ~F.col("metric").isin(*METRICS), "unknown_metric")
        .when(kind == "none", "no_value")
        .when(F.col("metric") == "active", F.when(on.isNull(), "not_mapped"))
        .when(number.isNull(), "not_numeric")
        .when(~finite, "not_finite")
        .when((F.col("metric") == "vehicle_identifier") & ~whole, "not_whole")
    )
    taken = F.when(F.col("metric") == "active", on.cast("double")).otherwise(number)
    return p.withColumn("reason", reason).withColumn("value_number", F.when(F.col("reason").isNull(), taken)).drop("__number")


def sorted_out(points: DataFrame, cfg: Join = Join()) -> DataFrame:
    """One row for each distinct value of a stream, metric and time: ``value``, ``copies``, ``reason`` and ``value_number``.

    ``points`` has ``server_id, vehicle_number, metric, source_time, value`` (VARIANT) and perhaps ``ingest_order``.  Of
    the values at one time that can be read the first stays, by ingest order, else by value; later ones that differ are
    in ``conflict``.  ``copies`` of all rows add up to the points.
    """
    order = F.min("ingest_order") if "ingest_order" in points.columns else F.lit(0)
    rows = read(points, cfg).withColumn("identity", identity_of(F.col("value"), F.col("__kind")))
    same = rows.groupBy(*STREAM, "metric", "source_time", "identity").agg(F.count("*").alias("copies"), order.alias("first"), F.first("reason").alias("reason"), F.first("value_number").alias("value_number"))
    w = Window.partitionBy(*STREAM, "metric", "source_time", F.col("reason").isNull()).orderBy("first", "identity")
    later = F.col("reason").isNull() & (F.row_number().over(w) > 1)
    return same.withColumn("reason", F.when(later, "conflict").otherwise(F.col("reason"))).drop("first")


def accepted(judged: DataFrame) -> DataFrame:
    """Points for the temporal join, one per stream, metric and time."""
    return judged.where("reason is null").select(*STREAM, "metric", "source_time", F.col("value_number").alias("value"))


def refused(judged: DataFrame) -> DataFrame:
    """The side table: refused values with their reasons, and further copies of accepted ones as ``repeated``."""
    again = judged.where("reason is null and copies > 1").select(*STREAM, "metric", "source_time", "identity", F.col("copies") - 1, F.lit("repeated"))
    bad = judged.where("reason is not null").select(*STREAM, "metric", "source_time", "identity", "copies", "reason")
    return bad.union(again)
