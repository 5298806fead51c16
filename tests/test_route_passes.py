"""Routes and phases of streams that pass by in tasks: as by the single steps, and without joins or broadcasts."""

import pytest
from pyspark.sql import functions as F

from wayring.functions import geo
from wayring.operators import detection
from wayring.sources.simulator import orbits

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routes_and_phases_need_no_joins(spark):
    o = orbits(spark, SF)
    routes = detection.detect_routes(o)
    assert "Join" not in _plan(routes) and "Broadcast" not in _plan(routes) and _plan(routes).count("Exchange") == 2  # of suppliers and of samples
    framed = _plan(detection.with_phase(o, routes))
    assert "Join" not in framed and "Broadcast" not in framed


def test_routes_are_those_of_the_single_steps(spark):
    o = orbits(spark, SF).where("vehicle_number % 20 in (0, 3, 8, 9, 18)").cache()
    points = detection.bump_masked(detection.localized(detection.usable(o)))
    kept = points.where("keep")
    shapes, seen = detection.fitted(kept, True), detection.fitted(points, False)
    traces = {r.vehicle_identifier: r for r in detection.traced(kept, shapes).collect()}
    periods = {r.vehicle_identifier: r.period_s for r in detection.periods(kept, detection.traced(kept, shapes)).collect()}
    shapes, seen = ({r.vehicle_identifier: r for r in s.drop("segs").collect()} for s in (shapes, seen))
    found = {r.vehicle_identifier: r for r in detection.detect_routes(o).collect()}
    passed = {k for k, t in traces.items() if t.closure_ok and t.cycles + 1e-9 >= 1 and t.fit_fraction + 1e-9 >= 0.7}
    assert set(found) == passed and {r.family for r in found.values()} == {"si", "so"} and any(r.outliers for r in found.values())
    for k, r in found.items():
        shape, trace = shapes[k], traces[k]
        for c in ("cx", "cy", "long_m", "short_m", "lat0", "lon0", "axis_ratio", "family", "samples", "observation_s"):
            assert r[c] == (shape[c] if isinstance(shape[c], (str, int)) else pytest.approx(shape[c], abs=1e-6)), c
        for c in ("fit_fraction", "travelled_m", "cycles", "length_m"):
            assert r[c] == pytest.approx(trace[c], abs=1e-6), c
        for c in ("family", "long_m", "short_m", "length_m"):
            assert r[f"observed_{c}"] == (seen[k][c] if c == "family" else pytest.approx(seen[k][c], abs=1e-6)), c
        assert r.period_s == pytest.approx(periods[k]) and len(r.segs) == 64 and [(s.x, s.y) for s in r.segs] == [(p.x, p.y) for p in r.polyline]
        assert [(p.x, p.y) for p in r.polyline] == [(pytest.approx(p.x, abs=1e-6), pytest.approx(p.y, abs=1e-6)) for p in shape.polyline]


def test_phases_are_those_of_the_column_function(spark):
    o = orbits(spark, SF, 330).where("vehicle_number in (1, 2, 3, 9)").withColumn("longitude_deg", F.when(F.second("sample_time") != 7, F.col("longitude_deg")))
    routes = detection.detect_routes(o)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # streams are cut, and routes stand apart from their samples
        got = {(r.vehicle_identifier, r.sample_time): r for r in detection.with_phase(o, routes).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    joined = o.join(routes.select(*detection.KEY, "segs", "center_latitude_deg", "center_longitude_deg"), detection.KEY)
    at = geo.local_m(F.col("latitude_deg"), F.col("longitude_deg"), F.col("center_latitude_deg"), F.col("center_longitude_deg"))
    placed = F.col("active") & F.col("longitude_deg").isNotNull()
    want = joined.withColumn("hit", F.when(placed, geo.project(F.col("segs"), at["x"], at["y"]))).select("vehicle_identifier", "sample_time", "hit").collect()
    assert len(want) == len(got) > 0 and any(r.hit is None for r in want)
    for r in want:
        own = got[r.vehicle_identifier, r.sample_time]
        if r.hit is None:
            assert own.phase is None and own.route_id is None and own.projection is None and own.distance_m is None
        else:
            # at a corner two segments are equally near, but for rounding
            assert own.distance_m == pytest.approx(r.hit.distance, abs=1e-9) and own.projection.px == pytest.approx(r.hit.px, abs=1e-6) and own.projection.py == pytest.approx(r.hit.py, abs=1e-6)
            assert min(abs(own.phase - r.hit.phase), 1 - abs(own.phase - r.hit.phase)) < 1e-9 and own.route_id.endswith(":effective")
