"""Geometry of closed polylines and the local tangent plane, as Catalyst expressions.

A polyline is an array of points ``struct<x, y>`` in metres; :func:`segments` turns it once into segments with
their arc length so far, which the other functions take.  Nothing here needs Python workers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius in metres, and the length below which a vector counts as zero.
EARTH_RADIUS_M = 6_378_137.0
EPSILON = 1e-9


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named: Spark computes lambdas anew at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def local_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """East and north metres from an origin (equirectangular)."""
    return point(F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_RADIUS_M)


def wgs84(x: Column, y: Column, lat0: Column, lon0: Column) -> Column:
    """Degrees of a local point: ``struct<lat, lon>``."""
    lat = lat0 + F.degrees(y / EARTH_RADIUS_M)
    lon = lon0 + F.degrees(x / (F.cos(F.radians(lat0)) * EARTH_RADIUS_M))
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def segments(points: Column) -> Column:
    """``array<struct<x, y, dx, dy, len, before>>`` with the closing edge; under 3 points or a zero edge is an error."""
    n = F.size(points)
    edges = F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), (points[(i + 1) % n]["x"] - p["x"]).alias("dx"), (points[(i + 1) % n]["y"] - p["y"]).alias("dy")))
    sized = F.transform(edges, lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"), e["dx"].alias("dx"), e["dy"].alias("dy"), F.hypot(e["dx"], e["dy"]).alias("len")))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<x:double,y:double,dx:double,dy:double,len:double,before:double>>").alias("out"))
    step = lambda acc, e: F.struct((acc["sum"] + e["len"]).alias("sum"), F.concat(acc["out"], F.array(F.struct(e["x"].alias("x"), e["y"].alias("y"), e["dx"].alias("dx"), e["dy"].alias("dy"), e["len"].alias("len"), acc["sum"].alias("before")))).alias("out"))
    made = F.aggregate(sized, start, step, lambda acc: acc["out"])
    bad = F.when(n < 3, "a closed polyline needs three points").when(F.exists(sized, lambda e: e["len"] <= EPSILON), "neighbouring points must differ")
    return F.when(bad.isNotNull(), F.raise_error(bad).cast("array<struct<x:double,y:double,dx:double,dy:double,len:double,before:double>>")).otherwise(made)


def length(segs: Column) -> Column:
    return F.element_at(segs, -1)["before"] + F.element_at(segs, -1)["len"]


def point_at_phase(segs: Column, phase: Column) -> Column:
    """Point at a share of the arc length (taken modulo 1): ``struct<x, y, segment, fraction>``."""

    def at(target: Column) -> Column:
        # ends grow along the line, so as many segments lie before the target as have their end up to it
        passed = F.size(F.filter(segs, lambda s: ~(target < s["before"] + s["len"])))
        return bound(F.struct(target.alias("target"), F.least(passed, F.size(segs) - 1).alias("i")), within)

    def within(k: Column) -> Column:
        s = segs[k["i"]]
        fraction = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k["target"] - s["before"]) / s["len"]))
        return F.struct((s["x"] + s["dx"] * fraction).alias("x"), (s["y"] + s["dy"] * fraction).alias("y"), k["i"].alias("segment"), fraction.alias("fraction"))

    return bound(F.pmod(phase, F.lit(1.0)) * length(segs), at)


def resampled(segs: Column, count: int) -> Column:
    """``count`` (3 to 64) points at equal arc length from the first point on."""
    if not 3 <= count <= 64:
        raise ValueError("count must be in 3..64")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: bound(point_at_phase(segs, i / F.lit(float(count))), lambda p: point(p["x"], p["y"])))


def project(segs: Column, x: Column, y: Column, digits: int | None = None) -> Column:
    """Nearest place on the polyline: ``struct<distance, segment, fraction, px, py, te, tn, phase>``; least segment on ties.

    With ``digits`` distances that agree to so many digits are ties: at a corner two segments are equally near, but for
    rounding.
    """

    def share(s: Column) -> Column:
        raw = ((x - s["x"]) * s["dx"] + (y - s["y"]) * s["dy"]) / (s["len"] * s["len"])
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))

    def off(s: Column) -> Column:
        f = share(s)
        d = F.hypot(x - (s["x"] + s["dx"] * f), y - (s["y"] + s["dy"] * f))
        return d if digits is None else F.round(d, digits)

    def place(k: Column) -> Column:
        s = segs[k["segment"]]
        f = share(s)
        px, py = s["x"] + s["dx"] * f, s["y"] + s["dy"] * f
        return F.struct(
            F.hypot(x - px, y - py).alias("distance"), k["segment"].alias("segment"), f.alias("fraction"), px.alias("px"), py.alias("py"), (s["dx"] / s["len"]).alias("te"), (s["dy"] / s["len"]).alias("tn"),
            F.pmod((s["before"] + s["len"] * f) / length(segs), F.lit(1.0)).alias("phase"),
        )

    # the nearest segment is found by its distance alone, so that one place is made and not one for each segment
    nearest = F.array_min(F.transform(segs, lambda s, i: F.struct(off(s).alias("off"), i.alias("segment"))))
    return bound(nearest, place)


def distance(segs: Column, x: Column, y: Column) -> Column:
    """Distance from the polyline alone: no places are built, so it costs a fraction of :func:`project`."""

    def square(s: Column) -> Column:
        dot = (x - s["x"]) * s["dx"] + (y - s["y"]) * s["dy"]
        size = s["len"] * s["len"]
        f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / size))
        return (x - s["x"]) * (x - s["x"]) + (y - s["y"]) * (y - s["y"]) + f * (f * size - dot * 2.0)

    return F.sqrt(F.greatest(F.lit(0.0), F.array_min(F.transform(segs, square))))


def phase_distance(a: Column, b: Column) -> Column:
    """Shortest unsigned distance of two phases, 0 to 0.5."""
    d = F.abs(F.pmod(a - b, F.lit(1.0)))
    return F.least(d, 1.0 - d)


def angle_error_deg(east: Column, north: Column, ref_east: Column, ref_north: Column, strict: bool = False) -> Column:
    """Unsigned angle of two vectors, 0 to 180 degrees; null if one of them is zero, which is an error with ``strict``."""
    a, b = F.hypot(east, north), F.hypot(ref_east, ref_north)
    cosine = (east * ref_east + north * ref_north) / (a * b)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    if strict:
        return F.when((a <= EPSILON) | (b <= EPSILON), F.raise_error(F.lit("a vector of no length has no direction")).cast("double")).otherwise(angle)
    return F.when((a > EPSILON) & (b > EPSILON), angle)


def tangent_error_deg(projection: Column, v_east: Column, v_north: Column, sign: int | Column = 1) -> Column:
    """Angle between a velocity and the polyline's direction at a projection, or against it for sign -1."""
    return angle_error_deg(v_east, v_north, projection["te"] * sign, projection["tn"] * sign)


def menger_curvature(a: Column, b: Column, c: Column) -> Column:
    """Signed curvature of the circle through three points; 0 if they are degenerate."""
    return bound(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), lambda p: _menger(p["a"], p["b"], p["c"]))


def _menger(a: Column, b: Column, c: Column) -> Column:
    sides = F.hypot(b["x"] - a["x"], b["y"] - a["y"]) * F.hypot(c["x"] - b["x"], c["y"] - b["y"]) * F.hypot(c["x"] - a["x"], c["y"] - a["y"])
    area2 = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    return F.when(sides <= EPSILON, F.lit(0.0)).otherwise(area2 * 2.0 / F.nullif(sides, F.lit(0.0)))


def curvature_at_phase(segs: Column, phase: Column, window: float = 0.02) -> Column:
    if not 0 < window < 0.5:
        raise ValueError("window must be in (0, 0.5)")
    return menger_curvature(point_at_phase(segs, phase - window), point_at_phase(segs, phase), point_at_phase(segs, phase + window))


def curvature_error(observed: Column, expected: Column, route_length: Column) -> Column:
    """Curvature difference over the larger of the expected curvature and that of a circle of the route's length."""
    return F.abs(observed - expected) / F.greatest(F.abs(expected), F.lit(2.0 * math.pi) / route_length)


def _rotated(cx: Column, cy: Column, along: Column, across: Column, turn: Column) -> Column:
    return point(cx + along * F.cos(turn) - across * F.sin(turn), cy + along * F.sin(turn) + across * F.cos(turn))


def ellipse_points(cx: Column, cy: Column, long: Column, short: Column, turn: Column, n: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _rotated(cx, cy, long * F.cos(i * (2.0 * math.pi / n)), short * F.sin(i * (2.0 * math.pi / n)), turn))


def stadium_points(cx: Column, cy: Column, long: Column, short: Column, turn: Column, arc: int = 24, straight: int = 8) -> Column:
    """Two half circles of ``arc`` points joined by straights of ``straight`` inner points; ``long`` is the half length."""
    half = F.greatest(long - short, F.lit(0.0))

    def bend(side: int, start: float) -> Column:
        angle = lambda i: F.lit(start) + i * (math.pi / (arc - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(arc - 1)), lambda i: _rotated(cx, cy, half * side + short * F.cos(angle(i)), short * F.sin(angle(i)), turn))

    def line(side: int) -> Column:
        along = lambda i: half * side * (1.0 - i * (2.0 / (straight + 1)))
        return F.transform(F.sequence(F.lit(1), F.lit(straight)), lambda i: _rotated(cx, cy, along(i), short * side, turn))

    return F.concat(bend(1, -math.pi / 2), line(1), bend(-1, math.pi / 2), line(-1))
