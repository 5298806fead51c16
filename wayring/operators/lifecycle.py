"""Vehicle lifecycle from samples: activation, data loss and return, expiry; the batch form.

One shuffle by (server_id, vehicle_identifier); lag and lead over the time order of a stream give every change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayring.config import Grouping, Timing

KEY = ["server_id", "vehicle_identifier"]


def accepted(samples: DataFrame, *ties: str) -> DataFrame:
    """The first sample of each stream and time by ``ties``; later ones at the same time are dropped as late."""
    order = Window.partitionBy(*KEY, "sample_time").orderBy(*ties)
    return samples.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def state_changes(samples: DataFrame, no_data_seconds: int = Timing().no_data_seconds, expire_seconds: int = Grouping().hold_seconds, observed_until: Column | None = None) -> DataFrame:
    """``change_time, kind, server_id, vehicle_identifier`` of accepted samples.

    Losses and expiries are stamped with their deadline.  At the end of a stream they count if the deadline is not
    after ``observed_until``, by default the newest sample of all streams.
    """
    w = Window.partitionBy(*KEY).orderBy("sample_time")
    s = samples.select(*KEY, "sample_time", "active", F.lag("sample_time").over(w).alias("before"), F.lag("active").over(w).alias("was"), F.lead("sample_time").over(w).alias("next"))
    if observed_until is None:
        newest = samples.agg(F.max("sample_time").alias("observed"))
        s = s.crossJoin(F.broadcast(newest))  # one row
    else:
        s = s.withColumn("observed", observed_until)
    until = F.coalesce("next", "observed")
    lost_at = F.col("sample_time") + F.expr(f"INTERVAL {no_data_seconds} SECONDS")
    gone_at = F.col("sample_time") + F.expr(f"INTERVAL {expire_seconds} SECONDS")
    back = F.col("before") + F.expr(f"INTERVAL {no_data_seconds} SECONDS") <= F.col("sample_time")
    now = F.coalesce(F.col("active"), F.lit(False))
    was = F.coalesce(F.col("was"), F.lit(False))

    def change(condition: Column, at: Column, kind: str) -> Column:
        return F.when(condition, F.struct(at.alias("change_time"), F.lit(kind).alias("kind")))

    found = F.array_compact(
        F.array(
            change(back, F.col("sample_time"), "data_resumed"),
            change(now & ~was, F.col("sample_time"), "vehicle_activated"),
            change(F.col("active").eqNullSafe(F.lit(False)) & was, F.col("sample_time"), "vehicle_deactivated"),
            change(until >= lost_at, lost_at, "data_lost"),
            change(until >= gone_at, gone_at, "vehicle_expired"),
        )
    )
    return s.select(*KEY, F.explode(found).alias("c")).select("c.change_time", "c.kind", *KEY)


def latest_state(samples: DataFrame) -> DataFrame:
    """The newest sample of each stream; the maximum is partial, so hot streams are reduced before the shuffle."""
    return samples.groupBy(*KEY).agg(F.max_by("active", "sample_time").alias("active"), F.max("sample_time").alias("sample_time"), F.count("*").alias("samples"))


def route_segments(samples: DataFrame, expire_seconds: int = Grouping().hold_seconds) -> DataFrame:
    """Samples that are not inactive and have a position, with a segment number per stream.

    Inactivity and expiry end a segment; route history starts anew after them.
    """
    w = Window.partitionBy(*KEY).orderBy("sample_time")
    gap = F.col("sample_time") >= F.lag("sample_time").over(w) + F.expr(f"INTERVAL {expire_seconds} SECONDS")
    broken = F.when(gap | F.col("active").eqNullSafe(F.lit(False)), 1).otherwise(0)
    numbered = samples.withColumn("__break", broken).withColumn("segment", F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")
    return numbered.where("coalesce(active, true) and latitude_deg is not null and longitude_deg is not null")
