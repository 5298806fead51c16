"""From frames to scores: how a vehicle moves on its route, as the error metrics that scoring takes.

Frames that have a phase meet the route that was in effect then; errors of place, heading and curvature come from the
projection, those of progress from the frames before.  One window per stream and route; no frame is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayring.functions import geo
from wayring.session import spread

KEY = ["server_id", "vehicle_identifier"]
#: Samples on either side from which a vehicle's own curvature is taken.
CURVATURE_REACH = 3


def confirmed_routes(found: DataFrame) -> DataFrame:
    """The routes among results: key, ``confirmed_us``, family, ``sign`` (-1 clockwise), period, length, short half axis and segments."""
    c = found.where("kind = 'route_confirmed'")
    points = F.zip_with("route_x", "route_y", geo.point)
    sign = F.when(F.col("direction") == "clockwise", -1).otherwise(1)
    return c.select(*KEY, F.col("at_us").alias("confirmed_us"), "family", sign.alias("sign"), F.col("route_period_s").alias("own_period_s"), F.col("route_length_m").alias("length_m"), F.col("route_short_m").alias("short_m"), "route_lat", "route_lon", geo.segments(points).alias("segs"))


def placed_frames(found: DataFrame) -> DataFrame:
    """Frames with a phase and ``confirmed_us`` of the route in effect: the last one confirmed up to them."""
    line = Window.partitionBy(*KEY).orderBy("at_us", "output").rowsBetween(Window.unboundedPreceding, 0)  # a change stands before its frame
    since = F.last(F.when(F.col("kind") == "route_confirmed", F.col("at_us")), ignorenulls=True).over(line)
    frames = found.select(*KEY, "at_us", "output", "kind", "active", "latitude_deg", "longitude_deg", "velocity_east_mps", "velocity_north_mps", "reliability", "route_id", "phase").withColumn("confirmed_us", since)
    return frames.where("output = 'frame' and phase is not null").drop("output", "kind")


def reference_periods(routes: DataFrame) -> DataFrame:
    """Each route's group and its reference period: by default groups are servers, and their reference the median period."""
    group = Window.partitionBy("server_id")
    return routes.select(*KEY, "confirmed_us", F.col("server_id").alias("group_id"), F.percentile("own_period_s", 0.5).over(group).alias("reference_period_s"), F.lit(None).cast("double").alias("expected_phase"))


def motion_metrics(found: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The columns of primitive metrics for each frame with a phase of ``found`` (results of a session).

    ``reference`` has key, ``confirmed_us``, ``group_id``, ``reference_period_s`` and ``expected_phase`` (null without a
    template fit, as is the position error then).  Position errors are degrees for SI and cycles for SO; the period error
    is that of the route's period; movement is the gap of the phase's rate to one cycle a period; a vehicle moves the
    wrong way while its phase goes against the route's direction.  The first frame of a route has no rate, frames at its
    ends no curvature of their own.
    """
    routes = confirmed_routes(found)
    given = reference_periods(routes) if reference is None else reference
    f = spread(placed_frames(found), *KEY, "confirmed_us").join(routes.join(given, [*KEY, "confirmed_us"]), [*KEY, "confirmed_us"])
    local = geo.local_m(F.col("latitude_deg"), F.col("longitude_deg"), F.col("route_lat"), F.col("route_lon"))
    f = f.withColumn("p", local).withColumn("hit", geo.project(F.col("segs"), F.col("p.x"), F.col("p.y")))
    line = Window.partitionBy(*KEY, "confirmed_us").orderBy("at_us")
    step = F.pmod(F.col("phase") - F.lag("phase").over(line) + 0.5, F.lit(1.0)) - 0.5
    seconds = (F.col("at_us") - F.lag("at_us").over(line)) / 1e6
    own = geo.menger_curvature(F.lag("p", CURVATURE_REACH).over(line), F.col("p"), F.lead("p", CURVATURE_REACH).over(line))
    f = f.withColumns({"rate": step * F.col("sign") / seconds, "own_curvature": own})
    wrong = F.coalesce(F.col("rate") < 0, F.lit(False))
    right_at = F.last(F.when(~wrong, F.col("at_us")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    speed = F.hypot("velocity_east_mps", "velocity_north_mps")
    off = geo.phase_distance(F.col("phase"), F.col("expected_phase"))
    ratio: dict[str, Column] = {
        "position_error": F.when(F.col("family") == "si", off * 360.0).otherwise(off),
        "period_error_ratio": F.abs(F.col("own_period_s") - F.col("reference_period_s")) / F.col("reference_period_s"),
        "movement_error_ratio": F.abs(F.col("rate") * F.col("reference_period_s") - 1.0),
        "distance_error_b_ratio": F.col("hit.distance") / F.col("short_m"),
        "tangent_error_deg": geo.tangent_error_deg(F.col("hit"), F.col("velocity_east_mps"), F.col("velocity_north_mps"), F.col("sign")),
        "curvature_error_ratio": geo.curvature_error(F.col("own_curvature"), geo.curvature_at_phase(F.col("segs"), F.col("phase")) * F.col("sign"), F.col("length_m")),
        "speed_fraction": speed / (F.col("length_m") / F.col("reference_period_s")),
        "wrong_direction_seconds": F.when(wrong, (F.col("at_us") - right_at) / 1e6).otherwise(0.0),
    }
    return f.select("group_id", *KEY, "confirmed_us", "at_us", "family", "active", "reliability", "phase", *(c.alias(name) for name, c in ratio.items()))
