"""Motion on routes, topology of tracks, consistency, smoothing and suggestions."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_sessions import SAMPLE, circle
from wayring.config import Detection
from wayring.functions import geo
from wayring.functions.scoring import with_scores
from wayring.operators import detection, events, motion, topology
from wayring.sources import snapshot
from wayring.streaming import lifecycle

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def session(spark, rows):
    return lifecycle.process(spark.createDataFrame([(T0 + timedelta(seconds=t), 1, 1, 1, True, lat, lon, vn, ve, 1.0) for t, lat, lon, ve, vn in rows], SAMPLE))


def test_a_clean_circle_has_small_errors(spark):
    m = motion.motion_metrics(session(spark, circle(400))).where("at_us > 1767225600000000 + 305e6").collect()
    assert len(m) > 80 and all(r.family == "si" and r.position_error is None for r in m)
    assert max(r.tangent_error_deg for r in m) < 15 and max(r.movement_error_ratio for r in m) < 0.4 and max(r.distance_error_b_ratio for r in m) < 0.2
    assert {r.wrong_direction_seconds for r in m} == {0.0} and {r.period_error_ratio for r in m} == {0.0}
    assert sorted(r.curvature_error_ratio for r in m if r.curvature_error_ratio is not None)[len(m) // 2] < 0.5


def test_going_back_is_the_wrong_way(spark):
    there = circle(400)
    back = [(400.0 + k, lat, lon, -ve, -vn) for k, (_, lat, lon, ve, vn) in enumerate(reversed(there[300:]))]
    m = motion.motion_metrics(session(spark, there + back)).orderBy("at_us").collect()
    late = [r for r in m if r.at_us > 1767225600000000 + 410e6]
    assert late[0].wrong_direction_seconds >= 10 and late[-1].wrong_direction_seconds >= 95 and min(r.tangent_error_deg for r in late) > 160


def test_scores_follow_from_motion(spark):
    found = session(spark, circle(400))
    routes = motion.confirmed_routes(found)
    phase = lifecycle.frames_of(found).where("unix_timestamp(sample_time) = 1767225600 + 360").first().phase
    ahead = F.lit((phase + 20 / 360) % 1.0)
    expected = routes.select(*motion.KEY, "confirmed_us", F.lit(7).alias("group_id"), F.lit(90.0).alias("reference_period_s"), ahead.alias("expected_phase"))
    scored = with_scores(motion.motion_metrics(found, expected)).where("at_us = 1767225600000000 + 360e6").collect()
    assert len(scored) == 1 and scored[0].valid and scored[0].position_error == pytest.approx(20, abs=1) and scored[0].c_position == pytest.approx(50, abs=5)


def polylines(spark, tracks):
    rows = [(1, k, [{"x": float(x), "y": float(y)} for x, y in points]) for k, points in tracks.items()]
    return spark.createDataFrame(rows, "server_id long, vehicle_identifier long, polyline array<struct<x:double,y:double>>")


def test_crossings_and_loops(spark):
    tracks = {
        1: [(0, 0), (10, 0), (10, 10), (0, 10)],
        2: [(0, 0), (10, 10), (10, 0), (0, 10)],  # a bow
        3: [(0, 0), (10, 0), (10, 10), (4, 10), (4, 4), (6, 4), (6, 12), (0, 12)],  # a loop within
        4: [(0, 0), (2, 2), (4, 0), (6, 2), (6, 0), (4, 2), (2, 0), (0, 2)],  # three bows
        5: [(0, 0), (10, 5), (0, 5), (10, 0), (5, 12), (7, -3), (2, 9)],
    }
    got = {r.vehicle_identifier: (r.topology, r.subtype, len(r.crossings)) for r in topology.classified(polylines(spark, tracks)).collect()}
    assert got[1] == ("simple", "simple", 0) and got[2] == ("self_crossing", "figure_eight", 1)
    assert got[3] == ("double", "double_hippodrome", 1) and got[4] == ("self_crossing", "double_figure_eight", 3) and got[5][1] == "unknown"


def test_regions_of_a_stadium(spark):
    from wayring.sources.simulator import looped_orbits

    tracks = topology.classified(topology.first_cycles(looped_orbits(spark, "/root/testdata/sf0.001")))
    found = topology.regions(tracks).orderBy("vehicle_identifier", "start_phase").collect()
    stadium = [r.kind for r in found if (r.vehicle_identifier - 100) % 4 == 1 and r.vehicle_identifier == 101]
    assert set(stadium) == {"leg", "turn"} and 3 <= len(stadium) <= 7
    eight = [r.kind for r in found if r.vehicle_identifier == 102]
    assert "connection" in eight
    for one in {r.vehicle_identifier for r in found}:
        own = [r for r in found if r.vehicle_identifier == one]
        assert own[0].start_phase == 0 and own[-1].end_phase == pytest.approx(1) and all(a.end_phase == pytest.approx(b.start_phase) for a, b in zip(own, own[1:]))


def test_distance_is_that_of_the_projection(spark):
    tracks = polylines(spark, {1: [(0, 0), (10, 0), (10, 10), (0, 10)]}).withColumn("segs", geo.segments(F.col("polyline")))
    p = tracks.crossJoin(spark.range(200)).select("segs", (F.rand(1) * 30 - 10).alias("x"), (F.rand(2) * 30 - 10).alias("y"))
    worst = p.select(F.max(F.abs(geo.distance(F.col("segs"), F.col("x"), F.col("y")) - geo.project(F.col("segs"), F.col("x"), F.col("y"))["distance"]))).first()[0]
    assert worst < 1e-6


def test_a_zero_vector_has_no_direction(spark):
    zero = spark.range(1).select(*(F.lit(x).alias(n) for n, x in (("a", 0.0), ("b", 0.0), ("c", 1.0), ("d", 0.0))))
    columns = [F.col(c) for c in "abcd"]
    assert zero.select(geo.angle_error_deg(*columns)).first()[0] is None
    with pytest.raises(Exception, match="no direction"):
        zero.select(geo.angle_error_deg(*columns, strict=True)).collect()


def test_smoothing_takes_the_last_seconds(spark):
    s = spark.createDataFrame([(1, 1, T0 + timedelta(seconds=k), float(k), None, 1.0, 2.0) for k in (0, 1, 2, 5)], "server_id long, vehicle_identifier long, sample_time timestamp, latitude_deg double, longitude_deg double, velocity_north_mps double, velocity_east_mps double")
    assert [(r.latitude_deg, r.longitude_deg) for r in detection.smoothed(s, Detection()).orderBy("sample_time").collect()] == [(0.0, None), (0.5, None), (1.0, None), (5.0, None)]


def test_rejected_suggestions_stay_hidden(spark):
    rows = [(g, t, 40.0 if 50 <= t < 300 or 400 <= t < 700 else 0.0) for g in (1, 2) for t in range(0, 900, 10)]
    advantages = spark.createDataFrame(rows, "g long, second long, advantage double")
    rejected = spark.createDataFrame([(2, 200, 800)], "g long, rejected_at long, event_end long")
    got = sorted(map(tuple, events.suggestions(advantages, ["g"], "second", "advantage", rejected).collect()))
    assert got == [(1, 160, 320), (1, 510, 720), (2, 160, 200)]


def test_documents_take_their_defaults(spark):
    samples = snapshot.from_json_lines(spark.createDataFrame([('{"server_id": 1}',)], "value string")).first()
    assert samples.reliability == 1.0 and samples.field_quality == {}
    lines = spark.createDataFrame([('{"route_id": "r"}',), ('{"route_id": "s", "regions": [{"kind": "leg", "start_phase": 0.0, "end_phase": 0.5}]}',)], "value string")
    routes = {r.route_id: r.regions for r in snapshot.from_json_lines(lines, snapshot.ROUTE_DOCUMENT).collect()}
    assert routes["r"] == [] and routes["s"][0].label == ""
