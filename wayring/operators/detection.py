"""Closed-route detection for whole streams at once.

:func:`detect_routes` and :func:`with_phase` take streams one after the other in tasks, by the steps of the lifecycle.  The
single steps are DataFrame operations too: those before the shape are windows over one partitioning, by stream, and
the shapes are one row per stream and join back on the same key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wayring.config import Detection
from wayring.functions import geo
from wayring.session import spread
from wayring.streaming import route_steps as steps
from wayring.streaming.lifecycle import runs

KEY = ["server_id", "vehicle_identifier"]
_EPS = geo.EPSILON


def _stream() -> WindowSpec:
    return Window.partitionBy(*KEY)


def _in_time() -> WindowSpec:
    return _stream().orderBy("sample_time")


def _median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def usable(samples: DataFrame, cfg: Detection = Detection(), seconds: int | None = None) -> DataFrame:
    """Samples that can tell a route, of streams with enough of them over the whole observation time."""
    seconds = cfg.confirm_seconds if seconds is None else seconds
    # all steps are by stream: the parts that are made here are those of every window and join
    s = spread(samples, *KEY).where("coalesce(active, true) and latitude_deg is not null and longitude_deg is not null and reliability > 0")
    span = (F.unix_micros(F.max("sample_time").over(_stream())) - F.unix_micros(F.min("sample_time").over(_stream()))) / 1e6
    s = s.withColumns({"samples": F.count("*").over(_stream()), "observation_s": span})
    return s.where((F.col("samples") >= cfg.least_samples) & (F.col("observation_s") + _EPS >= seconds))


def smoothed(samples: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """Positions and velocities as means over the last ``smoothing_seconds``, the present one included; an optional step before detection."""
    recent = _stream().orderBy(F.unix_micros(F.col("sample_time").cast("timestamp"))).rangeBetween(-cfg.smoothing_seconds * 1_000_000 + 1, 0)
    return samples.withColumns({c: F.when(F.col(c).isNotNull(), F.avg(c).over(recent)) for c in ("latitude_deg", "longitude_deg", "velocity_north_mps", "velocity_east_mps")})


def localized(samples: DataFrame) -> DataFrame:
    """Adds ``lat0, lon0`` (medians of the stream) and ``x, y`` in metres from them."""
    s = samples.withColumns({"lat0": _median(F.col("latitude_deg")).over(_stream()), "lon0": _median(F.col("longitude_deg")).over(_stream())})
    p = geo.local_m(F.col("latitude_deg"), F.col("longitude_deg"), F.col("lat0"), F.col("lon0"))
    return s.withColumns({"x": p["x"], "y": p["y"]})


def bump_masked(points: DataFrame) -> DataFrame:
    """Adds ``keep``: false for an inner point far from both neighbours while these lie close together."""
    step = lambda a, b: F.hypot(F.col(f"x{b}") - F.col(f"x{a}"), F.col(f"y{b}") - F.col(f"y{a}"))
    p = points.withColumns({"x0": F.lag("x").over(_in_time()), "y0": F.lag("y").over(_in_time()), "x1": F.col("x"), "y1": F.col("y"), "x2": F.lead("x").over(_in_time()), "y2": F.lead("y").over(_in_time())})
    p = p.withColumns({"into": step(0, 1), "out": step(1, 2), "bridge": step(0, 2)})
    p = p.withColumn("median_step", _median(F.when(F.col("into") > _EPS, F.col("into"))).over(_stream()))
    far = F.greatest(F.col("median_step") * 4.0, F.lit(1.0))
    bump = (F.col("into") > far) & (F.col("out") > far) & (F.col("bridge") <= F.greatest(F.col("median_step") * 2.5, F.lit(1.5)))
    return p.withColumn("keep", ~F.coalesce(bump, F.lit(False))).drop("x0", "y0", "x1", "y1", "x2", "y2", "into", "out", "bridge", "median_step")


def fitted(points: DataFrame, robust: bool, cfg: Detection = Detection()) -> DataFrame:
    """One shape per stream: centre, half axes, turn (radians), family, polyline segments and length."""
    middle = _median if robust else F.avg
    p = points.withColumns({"cx": middle(F.col("x")).over(_stream()), "cy": middle(F.col("y")).over(_stream())})
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    p = p.withColumns({"xx": F.avg(dx * dx).over(_stream()), "yy": F.avg(dy * dy).over(_stream()), "xy": F.avg(dx * dy).over(_stream())})
    p = p.withColumn("turn", F.atan2(F.col("xy") * 2.0, F.col("xx") - F.col("yy")) * 0.5)
    along, across = dx * F.cos("turn") + dy * F.sin("turn"), dy * F.cos("turn") - dx * F.sin("turn")
    low, high = (0.05, 0.95) if robust else (0.0, 1.0)
    half = lambda v: F.greatest((F.percentile(v, high) - F.percentile(v, low)) / 2.0, F.lit(_EPS))
    s = p.withColumns({"along": along, "across": across}).groupBy(*KEY).agg(
        *(F.max(c).alias(c) for c in ("cx", "cy", "turn", "lat0", "lon0", "samples", "observation_s")), half(F.col("along")).alias("a"), half(F.col("across")).alias("b"), F.count("*").alias("points")
    )
    swap = F.col("b") > F.col("a")
    s = s.withColumns({"long_m": F.greatest("a", "b"), "short_m": F.least("a", "b"), "turn": F.when(swap, F.col("turn") + math.pi / 2).otherwise(F.col("turn"))}).drop("a", "b")
    ratio = F.col("long_m") / F.col("short_m")
    shape = [F.col(c) for c in ("cx", "cy", "long_m", "short_m", "turn")]
    s = s.withColumns({"axis_ratio": ratio, "family": F.when(ratio <= cfg.si_axis_ratio, "si").otherwise("so")})
    s = s.where(F.col("short_m") > _EPS)
    s = s.withColumn("outline", F.when(F.col("family") == "si", geo.ellipse_points(*shape)).otherwise(geo.stadium_points(*shape)))
    s = s.withColumn("outline_segs", geo.segments(F.col("outline")))
    s = s.withColumn("polyline", geo.resampled(F.col("outline_segs"), min(cfg.point_limit, 64)))
    s = s.withColumn("segs", geo.segments(F.col("polyline"))).drop("outline", "outline_segs")
    return s.withColumn("length_m", geo.length(F.col("segs")))


def _heading_cos(points: DataFrame) -> DataFrame:
    """Adds ``he, hn``: the direction between a point's neighbours (or itself at an end), null if it does not move."""
    east = F.coalesce(F.lead("x").over(_in_time()), F.col("x")) - F.coalesce(F.lag("x").over(_in_time()), F.col("x"))
    north = F.coalesce(F.lead("y").over(_in_time()), F.col("y")) - F.coalesce(F.lag("y").over(_in_time()), F.col("y"))
    p = points.withColumns({"he": east, "hn": north})
    still = F.hypot("he", "hn") <= _EPS
    return p.withColumns({"he": F.when(~still, F.col("he")), "hn": F.when(~still, F.col("hn"))})


def traced(points: DataFrame, shapes: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """One row per stream: fit, travelled way, cycles, closure and signed area of kept points against the shape."""
    w = _in_time().rowsBetween(Window.unboundedPreceding, 0)
    p = _heading_cos(points).withColumns({"px": F.lag("x").over(_in_time()), "py": F.lag("y").over(_in_time())})
    p = p.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)))
    p = p.withColumns({"way": F.sum("step").over(w), "index": F.row_number().over(_in_time()), **{f"first_{c}": F.first(c).over(w) for c in ("x", "y", "he", "hn")}})
    p = p.select(*KEY, "x", "y", "px", "py", "step", "way", "index", "he", "hn", "first_x", "first_y", "first_he", "first_hn")
    p = p.join(shapes.select(*KEY, "cx", "cy", "short_m", "length_m", "segs"), KEY)
    near = F.greatest(F.col("short_m") * cfg.closure_axis_ratio, F.lit(1.0))
    angle = geo.angle_error_deg(F.col("first_he"), F.col("first_hn"), F.col("he"), F.col("hn"))
    closes = (F.col("index") > 1) & (F.col("way") >= F.col("length_m") * cfg.closure_phase) & (F.hypot(F.col("x") - F.col("first_x"), F.col("y") - F.col("first_y")) <= near) & F.coalesce(angle <= cfg.closure_heading_deg, F.lit(True))
    cross = (F.col("px") - F.col("cx")) * (F.col("y") - F.col("cy")) - (F.col("py") - F.col("cy")) * (F.col("x") - F.col("cx"))
    return p.withColumn("fits", (geo.distance(F.col("segs"), F.col("x"), F.col("y")) <= near).cast("double")).groupBy(*KEY).agg(
        F.avg("fits").alias("fit_fraction"), F.sum("step").alias("travelled_m"), F.bool_or(closes).alias("closure_ok"), F.sum(F.coalesce(cross, F.lit(0.0))).alias("signed_area"), F.max("length_m").alias("length_m")
    ).withColumn("cycles", F.col("travelled_m") / F.col("length_m"))


def periods(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """``period_s`` per stream: the length over the median of reported speeds, else of derived ones, else the time per cycle."""
    speed = F.hypot("velocity_east_mps", "velocity_north_mps")
    dt = (F.unix_micros("sample_time") - F.unix_micros(F.lag("sample_time").over(_in_time()))) / 1e6
    way = F.hypot(F.col("x") - F.lag("x").over(_in_time()), F.col("y") - F.lag("y").over(_in_time()))
    p = points.withColumns({"speed": F.when(speed > _EPS, speed), "derived": F.when(dt > 0, way / F.nullif(dt, F.lit(0.0)))})
    m = p.groupBy(*KEY).agg(_median(F.col("speed")).alias("speed"), _median(F.when(F.col("derived") > _EPS, F.col("derived"))).alias("derived"), ((F.unix_micros(F.max("sample_time")) - F.unix_micros(F.min("sample_time"))) / 1e6).alias("duration"))
    period = F.coalesce(F.col("length_m") / F.col("speed"), F.col("length_m") / F.col("derived"), F.col("duration") / F.greatest("cycles", F.lit(_EPS)))
    return m.join(lengths, KEY).select(*KEY, period.alias("period_s"))


def direction(signed_area: Column) -> Column:
    return F.when(F.abs(signed_area) <= _EPS, "unknown").when(signed_area > 0, "counterclockwise").otherwise("clockwise")


#: What is found of a stream, behind its key; polylines by column.
_FOUND = "family string, direction string, lat0 double, lon0 double, cx double, cy double, long_m double, short_m double, turn double, length_m double, period_s double, quality double, fit_fraction double, cycles double, travelled_m double, points long, samples long, observation_s double, center_lat double, center_lon double, x array<double>, y array<double>"
_SEEN = "observed_family string, observed_long_m double, observed_short_m double, observed_length_m double, observed_period_s double, observed_x array<double>, observed_y array<double>"
_ROW = ["latitude_deg", "longitude_deg", "velocity_east_mps", "velocity_north_mps"]


def _observed(rows: dict[str, np.ndarray], origin: tuple[float, float], cfg: Detection) -> tuple:
    """The values of ``_SEEN``: the shape of all samples, bumps included, about their mean; nulls where it is degenerate."""
    p = np.stack([np.radians(rows["lon"] - origin[1]) * geo.EARTH_RADIUS_M * math.cos(math.radians(origin[0])), np.radians(rows["lat"] - origin[0]) * geo.EARTH_RADIUS_M], axis=1)
    center = p.mean(axis=0)
    d = p - center
    turn = 0.5 * math.atan2(2.0 * (d[:, 0] * d[:, 1]).mean(), (d[:, 0] ** 2).mean() - (d[:, 1] ** 2).mean())
    along, across = d[:, 0] * math.cos(turn) + d[:, 1] * math.sin(turn), d[:, 1] * math.cos(turn) - d[:, 0] * math.sin(turn)
    a, b = (max(float(np.ptp(v)) / 2.0, _EPS) for v in (along, across))
    if b > a:
        a, b, turn = b, a, turn + math.pi / 2
    if b <= _EPS:
        return (None,) * 7
    si = a / b <= cfg.si_axis_ratio
    line = steps.polyline(center, a, b, turn, si, cfg)
    length = float(steps._segments(line)[1].sum())
    speed, way = np.hypot(rows["ve"], rows["vn"]), np.hypot(*(p[1:] - p[:-1]).T)
    period = steps.period_of(speed, way, rows["time"], length, max(float(way.sum()) / length, _EPS))
    return ("si" if si else "so", a, b, length, period, line[:, 0], line[:, 1])


def _found(rows: dict[str, np.ndarray], seconds: float, cfg: Detection) -> tuple | None:
    """The values of ``_FOUND`` and ``_SEEN`` of one stream's usable samples in order of time."""
    told = steps.detect(rows, seconds, cfg)
    if told is None or not told["period_s"] > 0:
        return None
    route, t = told["route"], rows["time"]
    named = [told[c] for c in ("length_m", "period_s", "quality", "fit_fraction", "cycles", "travelled_m", "kept")]
    return (told["family"], told["direction"], *told["origin"], *told["shape"], *named, len(t), float(t[-1] - t[0]), route.lat, route.lon, route.x, route.y, *_observed(rows, told["origin"], cfg))


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | pa.Table]:
    """The streams of rows that come in their order, each whole, however the batches are cut."""
    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        for key, first, end in runs(batch):
            if key != last and parts:
                yield parts[0] if len(parts) == 1 else pa.Table.from_batches(parts)
                parts = []
            last = key
            parts.append(batch.slice(first, end - first))
    if parts:
        yield parts[0] if len(parts) == 1 else pa.Table.from_batches(parts)


def detect_routes(samples: DataFrame, cfg: Detection = Detection(), seconds: int | None = None) -> DataFrame:
    """Streams with a confirmed closed route, with its effective and observed geometry.

    Streams with too few samples, too short a time, no closure, a poor fit or under a cycle give no row; so do
    empty tables.  Samples that are inactive, without time or position or without reliability are ignored.  One shuffle by
    stream, and no joins: a task sorts its samples and takes one stream at a time, by the step of the lifecycle.
    """
    least = cfg.confirm_seconds if seconds is None else seconds
    keys = [samples.schema[c] for c in KEY]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), _FOUND, _SEEN])
    told = to_arrow_schema(samples.sparkSession.createDataFrame([], schema).schema)
    good = F.coalesce(F.col("active"), F.lit(True)) & (F.col("reliability") > 0) & F.col("sample_time").isNotNull()
    for c in _ROW[:2]:
        good = good & F.col(c).isNotNull() & ~F.isnan(c)
    rows = samples.where(good).select(*KEY, F.unix_micros(F.col("sample_time").cast("timestamp")).alias("at_us"), *(F.col(c).cast("double").alias(c) for c in _ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for stream in streams(batches):
            at_us = stream.column("at_us").to_numpy()
            if len(at_us) < cfg.least_samples or (at_us[-1] - at_us[0]) / 1e6 + _EPS < least:
                continue
            values = {name: np.array(stream.column(c).to_numpy(zero_copy_only=False) if isinstance(stream, pa.RecordBatch) else stream.column(c).to_numpy(), float) for name, c in zip(("lat", "lon", "ve", "vn"), _ROW, strict=True)}
            one = _found({"time": (at_us - at_us[0]) / 1e6, **values}, least, cfg)
            if one is not None:
                out.append((*(stream.column(c)[0].as_py() for c in KEY), *one))
            if len(out) == 256:
                yield _batch(out, told)
                out = []
        if out:
            yield _batch(out, told)

    r = spread(rows, *KEY).sortWithinPartitions(*KEY, "at_us").mapInArrow(run, schema)
    prefix = F.concat_ws(":", F.col("server_id"), F.col("vehicle_identifier"))
    line = lambda x, y: F.zip_with(x, y, geo.point)
    r = r.withColumn("polyline", line("x", "y"))
    return r.select(
        *KEY, F.concat(prefix, F.lit(":effective")).alias("route_id"), F.concat(prefix, F.lit(":observed")).alias("observed_route_id"), "family", F.when(F.col("family") == "si", "compact").otherwise("hippodrome").alias("subtype"),
        F.col("center_lat").alias("center_latitude_deg"), F.col("center_lon").alias("center_longitude_deg"), "lat0", "lon0", "cx", "cy", "long_m", "short_m", F.pmod(F.degrees("turn"), F.lit(180.0)).alias("orientation_deg"), "length_m", "period_s", "direction",
        "quality", "fit_fraction", (F.col("points") / F.col("samples")).alias("inlier_fraction"), "cycles", (F.col("samples") - F.col("points")).alias("outliers"), F.lit(True).alias("closure_ok"), "samples", "observation_s", (F.col("long_m") / F.col("short_m")).alias("axis_ratio"), "travelled_m", "polyline", geo.segments(F.col("polyline")).alias("segs"),
        "observed_family", "observed_long_m", "observed_short_m", "observed_length_m", F.coalesce(F.when(F.col("observed_period_s") > 0, F.col("observed_period_s")), F.col("period_s")).alias("observed_period_s"), line("observed_x", "observed_y").alias("observed_polyline"),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PROJECTION = "projection struct<distance:double,segment:int,fraction:double,px:double,py:double,te:double,tn:double,phase:double>"
_PLACES = pa.struct([(c, pa.int32() if c == "segment" else pa.float64()) for c in ("distance", "segment", "fraction", "px", "py", "te", "tn", "phase")])


def _places(line: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
    """As :func:`wayring.functions.geo.project`, by column; points are held against all segments together, so few at a time that they stay in a processor's cache."""
    d, n, before = steps._segments(line)
    total, out = n.sum(), []
    for at in range(0, len(points), 128):
        p = points[at : at + 128]
        share = np.clip(((p[:, None, 0] - line[:, 0]) * d[:, 0] + (p[:, None, 1] - line[:, 1]) * d[:, 1]) / (n * n), 0, 1)
        off = np.hypot(p[:, None, 0] - (line[:, 0] + d[:, 0] * share), p[:, None, 1] - (line[:, 1] + d[:, 1] * share))
        k, row = off.argmin(axis=1), np.arange(len(p))
        f = share[row, k]
        px, py = line[k, 0] + d[k, 0] * f, line[k, 1] + d[k, 1] * f
        out.append([off[row, k], k.astype(np.int32), f, px, py, d[k, 0] / n[k], d[k, 1] / n[k], (before[k] + n[k] * f) / total % 1.0])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def with_phase(samples: DataFrame, routes: DataFrame, corrected_frame: bool = False, confirmed: DataFrame | None = None) -> DataFrame:
    """Frames of the routes' streams with ``route_id`` and ``phase`` where they are active and positioned.

    The polyline is relative to the median origin, the projection to the centre of the shape, as surveyed;
    ``corrected_frame`` projects from the median origin instead.  With ``confirmed`` (the key and ``confirmed_at``)
    frames have a phase from the confirming sample on, and none where the stream was never confirmed.

    A stream's route stands before its samples, which pass by in record batches: no route is copied to each sample and
    no table of routes is broadcast, whatever their number.
    """
    lat0, lon0 = ("lat0", "lon0") if corrected_frame else ("center_latitude_deg", "center_longitude_deg")
    given = routes.where(" and ".join(f"{c} is not null" for c in KEY))
    r = given.select(*KEY, F.lit(False).alias("__sample"), F.col("route_id").alias("__route"), F.col(lat0).alias("__lat"), F.col(lon0).alias("__lon"), *(F.transform("polyline", lambda p: p[c]).alias(f"__{c}") for c in ("x", "y")))  # noqa: B023
    placed = F.coalesce(F.col("active"), F.lit(True))
    for c in _ROW[:2]:
        placed = placed & F.col(c).isNotNull() & ~F.isnan(c)
    own = samples
    if confirmed is not None:
        # the streams' times come the same way
        c = confirmed.where(" and ".join(f"{c} is not null" for c in KEY)).select(*KEY, F.lit(False).alias("__sample"), F.unix_micros(F.col("confirmed_at").cast("timestamp")).alias("__from"))
        r = r.unionByName(c, allowMissingColumns=True)
    at_us = F.unix_micros(F.col("sample_time").cast("timestamp"))
    both = own.withColumns({"__sample": F.lit(True), "__at": at_us, "__placed": placed}).unionByName(r, allowMissingColumns=True)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema), "route_id string", _PROJECTION])
    told = to_arrow_schema(samples.sparkSession.createDataFrame([], schema).schema)
    names, late = samples.columns, confirmed is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, line, since, begins = None, None, None, None, None
        for batch in batches:
            is_sample = batch.column("__sample").to_numpy(zero_copy_only=False)
            rows, ids, at, places = [], [], [], []
            for own_key, first, end in runs(batch):
                if own_key != key:
                    key, name, line, since, begins = own_key, None, None, None, None
                while first < end and not is_sample[first]:
                    if batch.column("__route")[first].is_valid:
                        name = batch.column("__route")[first].as_py()
                        line = np.stack([batch.column(c)[first].values.to_numpy(zero_copy_only=False) for c in ("__x", "__y")], axis=1)
                        since = tuple(batch.column(c)[first].as_py() for c in ("__lat", "__lon"))
                    if late and batch.column("__from")[first].is_valid:
                        begins = batch.column("__from")[first].as_py()
                    first += 1
                if line is None or first == end:
                    continue
                good = batch.column("__placed").slice(first, end - first).to_numpy(zero_copy_only=False).astype(bool)
                if late:
                    times = pc.fill_null(batch.column("__at").slice(first, end - first), -(2**62)).to_numpy()
                    good = good & (times >= begins) if begins is not None else np.zeros(end - first, bool)
                lat, lon = (batch.column(c).slice(first, end - first).to_numpy(zero_copy_only=False).astype(float)[good] for c in _ROW[:2])
                begun = sum(len(one) for one in rows)
                rows.append(np.arange(first, end))
                ids.append(pa.array(np.where(good, name, None), pa.string()))
                if len(lat):
                    at.append(begun + np.flatnonzero(good))
                    east = np.radians(lon - since[1]) * geo.EARTH_RADIUS_M * math.cos(math.radians(since[0]))
                    places.append(_places(line, np.stack([east, np.radians(lat - since[0]) * geo.EARTH_RADIUS_M], axis=1)))
            if rows:
                taken = batch.select(names).take(pa.array(np.concatenate(rows)))
                made = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*places, strict=True)], fields=list(_PLACES)) if places else pa.nulls(0, _PLACES)
                index = np.full(len(taken), -1, np.int64)
                if at:
                    index[np.concatenate(at)] = np.arange(len(made))
                found = made.take(pa.array(index, mask=index < 0))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(taken.columns, told, strict=False)), pa.concat_arrays(ids), found.cast(told.field("projection").type)], schema=told)

    f = spread(both, *KEY).sortWithinPartitions(*KEY, "__sample").mapInArrow(run, schema)
    return f.withColumns({"phase": F.col("projection.phase"), "distance_m": F.col("projection.distance")})
