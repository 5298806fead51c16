"""Topology of closed tracks: one cycle of what a vehicle did, its self-crossings, the loops between them, and regions.

The fitted shapes of detection are simple by construction; these operators look at the track itself, so that figures
of eight and double loops can be told from circles and stadiums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayring.config import Detection
from wayring.functions import geo
from wayring.operators.detection import KEY, localized

#: A segment that turns less than this share of an even turning of the whole curve lies in a leg.
LEG_SHARE = 0.5


def first_cycles(samples: DataFrame, cfg: Detection = Detection(), points: int = 64) -> DataFrame:
    """``polyline`` (``points`` places at most, in metres) and ``cycle_s`` of each stream's first full cycle.

    A cycle ends at the first sample that is near the first one and heads like it, after the track has been well away;
    near is a share of the track's narrower half width, as in detection.  Streams that never close give no row.  The
    places are the first of equal parts of the way, so a long cycle needs no long array.
    """
    s = localized(samples.where("coalesce(active, true) and latitude_deg is not null and longitude_deg is not null and reliability > 0"))
    whole, line = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("sample_time")
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    step = F.hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line))
    s = s.withColumns({"he": F.lead("x").over(line) - F.col("x"), "hn": F.lead("y").over(line) - F.col("y"), "step": F.coalesce(step, F.lit(0.0))})
    s = s.withColumns({"way": F.sum("step").over(run), **{f"first_{c}": F.first(c).over(run) for c in ("x", "y", "he", "hn", "sample_time")}})
    width = F.least(F.max("x").over(whole) - F.min("x").over(whole), F.max("y").over(whole) - F.min("y").over(whole)) / 2.0
    s = s.withColumns({"near": F.greatest(width * cfg.closure_axis_ratio, F.lit(1.0)), "off": F.hypot(F.col("x") - F.col("first_x"), F.col("y") - F.col("first_y"))})
    s = s.withColumn("been_away", F.max("off").over(run) > F.col("near") * 4.0)
    angle = geo.angle_error_deg(F.col("first_he"), F.col("first_hn"), F.col("he"), F.col("hn"))
    closes = F.col("been_away") & (F.col("off") <= F.col("near")) & (angle <= cfg.closure_heading_deg)
    # the closest approach of the first run of samples that close
    s = s.withColumn("end_time", F.min(F.when(closes, F.col("sample_time"))).over(whole)).where("sample_time <= end_time")
    s = s.withColumn("total", F.max("way").over(whole)).where("total > 0")
    s = s.withColumn("part", F.least(F.floor(F.col("way") / F.col("total") * points), F.lit(points - 1)).cast("int"))
    at = s.groupBy(*KEY, "part").agg(F.min_by(F.struct("x", "y"), "way").alias("p"), F.max("end_time").alias("end_time"), F.min("first_sample_time").alias("start_time"))
    polyline = F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda e: e["p"])
    out = at.groupBy(*KEY).agg(polyline.alias("polyline"), ((F.unix_micros(F.max("end_time")) - F.unix_micros(F.min("start_time"))) / 1e6).alias("cycle_s"))
    return out.where(F.size("polyline") >= 4)


def crossings(segs: Column) -> Column:
    """``array<struct<i, j, phase_i, phase_j, x, y>>``: pairs of segments that cross inside, neighbours left out; ordered."""
    n, total = F.size(segs), geo.length(segs)

    def side(s: Column, x: Column, y: Column) -> Column:
        return s["dx"] * (y - s["y"]) - s["dy"] * (x - s["x"])

    def crossing(a: Column, b: Column, i: Column, j: Column) -> Column:
        from_b, to_b = side(a, b["x"], b["y"]), side(a, b["x"] + b["dx"], b["y"] + b["dy"])
        from_a, to_a = side(b, a["x"], a["y"]), side(b, a["x"] + a["dx"], a["y"] + a["dy"])
        at_a, at_b = from_a / (from_a - to_a), from_b / (from_b - to_b)
        hit = F.struct(i.alias("i"), j.alias("j"), ((a["before"] + a["len"] * at_a) / total).alias("phase_i"), ((b["before"] + b["len"] * at_b) / total).alias("phase_j"), (a["x"] + a["dx"] * at_a).alias("x"), (a["y"] + a["dy"] * at_a).alias("y"))
        # half-open ends, so that a crossing in a corner counts once
        inside = (from_b * to_b <= 0) & (to_b != 0) & (from_a * to_a <= 0) & (to_a != 0) & (from_a != to_a) & (from_b != to_b)
        return F.when(inside & ~((i == 0) & (j == n - 1)), hit)

    def row(a: Column, i: Column) -> Column:
        later = F.sequence(i + 2, n - 1)
        return F.when(i + 2 <= n - 1, F.array_compact(F.transform(later, lambda j: crossing(a, segs[j], i, j))))

    kind = "array<struct<i:int,j:int,phase_i:double,phase_j:double,x:double,y:double>>"
    return F.flatten(F.transform(segs, lambda a, i: F.coalesce(row(a, i).cast(kind), F.array().cast(kind))))


def signed_area(points: Column) -> Column:
    """Twice the area of a closed polygon, positive counterclockwise."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * points[(i + 1) % n]["y"] - points[(i + 1) % n]["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def classified(tracks: DataFrame) -> DataFrame:
    """Adds ``crossings``, ``topology`` and ``subtype`` to tracks with a ``polyline``.

    Without a crossing a track is simple.  At one crossing it falls into two loops: turning opposite ways they make a
    figure of eight, turning the same way a double loop (a double hippodrome).  Two or three crossings make a double
    figure of eight, more are unknown.
    """
    t = tracks.withColumn("segs", geo.segments(F.col("polyline"))).withColumn("__x", crossings(F.col("segs")))
    one = F.get("__x", F.lit(0))
    middle = F.array(geo.point(one["x"], one["y"]))
    inner = F.concat(middle, F.slice("polyline", one["i"] + 2, one["j"] - one["i"]))
    outer = F.concat(middle, F.expr("slice(polyline, __x[0].j + 2, size(polyline))"), F.slice("polyline", F.lit(1), one["i"] + 1))
    opposite = signed_area(inner) * signed_area(outer) < 0
    n = F.size("__x")
    t = t.withColumns({
        "topology": F.when(n == 0, "simple").when((n == 1) & ~opposite, "double").otherwise("self_crossing"),
        "subtype": F.when(n == 0, "simple").when((n == 1) & opposite, "figure_eight").when(n == 1, "double_hippodrome").when(n <= 3, "double_figure_eight").otherwise("unknown"),
    })
    return t.withColumnRenamed("__x", "crossings")


def regions(tracks: DataFrame) -> DataFrame:
    """``kind, start_phase, end_phase`` of each stretch of a classified track: legs, turns and connections at crossings.

    A segment turns as much as its direction differs from the last one's; runs of one kind are one region, and a run
    over the start of the polyline is cut there.
    """
    n = F.size("segs")
    mean = F.lit(360.0) / n * LEG_SHARE
    crossed = lambda i: F.exists("crossings", lambda c: (c["i"] == i) | (c["j"] == i))

    def kind(s: Column, i: Column) -> Column:
        before = F.element_at("segs", F.when(i == 0, n).otherwise(i))
        turn = geo.angle_error_deg(s["dx"], s["dy"], before["dx"], before["dy"])
        return F.struct(F.when(crossed(i), "connection").when(turn < mean, "leg").otherwise("turn").alias("kind"), (s["before"] / geo.length(F.col("segs"))).alias("start"), ((s["before"] + s["len"]) / geo.length(F.col("segs"))).alias("end"), i.alias("i"))

    each = tracks.select(*KEY, F.explode(F.transform("segs", kind)).alias("r")).select(*KEY, "r.*")
    w = Window.partitionBy(*KEY).orderBy("i")
    fresh = F.coalesce(F.col("kind") != F.lag("kind").over(w), F.lit(True)).cast("int")
    run = each.withColumn("fresh", fresh).withColumn("region", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*KEY, "region", "kind").agg(F.min("start").alias("start_phase"), F.max("end").alias("end_phase"))
