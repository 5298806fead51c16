"""Sessions over micro-batches, bounded histories and changes of confirmed routes."""

import json
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayring import selftest
from wayring.config import Detection, Engine, Scoring
from wayring.sources.simulator import circle_samples
from wayring.streaming import lifecycle
from wayring.streaming.route_steps import RouteState, advance, detect
from wayring.streaming.session import Progress, Session

T0 = datetime(2026, 1, 1, tzinfo=UTC)
START = int(T0.timestamp())
SAMPLE = "sample_time timestamp, server_id long, vehicle_number long, vehicle_identifier long, active boolean, latitude_deg double, longitude_deg double, velocity_north_mps double, velocity_east_mps double, reliability double"


def samples(spark, rows):
    """Rows of (identifier, second, active), without positions."""
    return spark.createDataFrame([(T0 + timedelta(seconds=s), 1, v, v, a, None, None, None, None, 1.0) for v, s, a in rows], SAMPLE)


def told(found):
    return sorted((r.vehicle_identifier, r.at_us // 1_000_000 - START, r.kind) for r in found.where("output = 'change'").collect())


def test_a_lagging_stream_keeps_its_rows(spark, tmp_path):
    session = Session(spark, f"file://{tmp_path}")
    session.process_batch(samples(spark, [(1, 0, True), (2, 0, True), (1, 100, True)]))
    assert session.processed_until_us == (START + 100) * 1_000_000
    second = session.process_batch(samples(spark, [(2, 60, False), (1, 101, True)]))
    assert told(second) == [(2, 60, "data_resumed"), (2, 60, "vehicle_deactivated"), (2, 80, "data_lost")]
    # a row at or before the last of its own stream is late
    assert session.process_batch(samples(spark, [(2, 60, True), (1, 102, True)])).where("output = 'frame'").count() == 1


def test_progress_never_goes_back(spark, tmp_path):
    session = Session(spark, f"file://{tmp_path}")
    session.process_batch(samples(spark, [(1, 0, True), (2, 0, True), (1, 50, True)]))
    for late in ({}, {"observed_until_us": (START + 49) * 1_000_000}):
        with pytest.raises(ValueError, match="backwards"):
            session.process_batch(samples(spark, [(2, 30, False)]), **late)
    assert session.table.versions() == [1]
    found = session.process_batch(samples(spark, [(2, 30, False)]), forward_only=True)
    assert told(found) == [(2, 30, "data_resumed"), (2, 30, "vehicle_deactivated"), (2, 50, "data_lost")]
    assert session.processed_until_us == (START + 50) * 1_000_000
    assert session.process_batch(samples(spark, [])).count() == 0 and session.table.versions() == [1, 2]
    assert told(session.process_batch(samples(spark, []), observed_until_us=(START + 400) * 1_000_000)) == [(1, 70, "data_lost"), (1, 350, "vehicle_expired"), (2, 330, "vehicle_expired")]


def test_replays_and_rivals(spark, tmp_path):
    session = Session(spark, f"file://{tmp_path}")
    rows = samples(spark, [(1, 0, True), (2, 3, None)])
    first = sorted(map(repr, session.process_batch(rows, batch_id=7).collect()))
    assert sorted(map(repr, Session(spark, f"file://{tmp_path}").process_batch(rows, batch_id=7).collect())) == first
    assert session.table.versions() == [1]
    rival = session.table.read(1)
    with pytest.raises(RuntimeError, match="another session"):
        session.table.commit(Progress(1, 0, 8, rival.folder, rival.schema_version, rival.algorithm_version, rival.config_sha256))
    assert session.table.newest() == rival
    with pytest.raises(ValueError, match="configuration"):
        Session(spark, f"file://{tmp_path}", Engine(scoring=Scoring(low_below=1.0)))


def test_a_stream_through_a_session(spark, tmp_path):
    source = f"{tmp_path}/in"
    for k in range(3):
        samples(spark, [(1, k * 10 + s, True) for s in range(10)] + [(2, max(k - 1, 0) * 10 + s, True) for s in range(10)]).repartition(1).write.mode("append").parquet(source)
    session = Session(spark, f"file://{tmp_path}/session")
    stream = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(session.sink).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    frames = session.all_results().where("output = 'frame'").groupBy("vehicle_identifier").count().collect()
    assert {r.vehicle_identifier: r["count"] for r in frames} == {1: 30, 2: 20}


def circle(seconds=361, radius=100.0, period=90.0, bend=None, factor=1.4):
    """(time, lat, lon, ve, vn) on a circle that grows at ``bend``."""
    t = np.arange(seconds, dtype=float)
    r = np.where(t >= (bend or seconds), radius * factor, radius)
    angle, omega = 2 * np.pi * t / period, 2 * np.pi / period
    lat, lon = 31.8 + np.degrees(r * np.sin(angle) / 6_378_137.0), 34.8 + np.degrees(r * np.cos(angle) / (6_378_137.0 * np.cos(np.radians(31.8))))
    return list(zip(t.tolist(), lat.tolist(), lon.tolist(), (-r * np.sin(angle) * omega).tolist(), (r * np.cos(angle) * omega).tolist(), strict=True))


def run(rows, cfg=Detection(), reliability=1.0, state=None):
    state = state or RouteState()
    out = []
    for time, *rest in rows:
        out += [(at, kind) for at, kind, _ in advance(state, (time, True, *rest, reliability), cfg)]
    return out, state


def test_unconfirmed_histories_are_bounded():
    drift = [(float(t), 31.8 + t * 1e-5, 34.8, 0.0, 1.0) for t in range(2000)]
    _, exact = run(drift, Detection(history_points=None))
    _, bounded = run(drift, Detection(history_points=400))
    assert len(exact.history["time"]) == 2000 and len(bounded.history["time"]) <= 505
    # a route that the newest samples show is found all the same
    later = [(t + 2000, *rest) for t, *rest in circle(800)]
    found, _ = run(later, Detection(history_points=400), state=bounded)
    assert [kind for _, kind in found] == ["route_candidate", "route_confirmed"]
    whole, _ = run(circle(), Detection(history_points=None))
    assert run(circle())[0] == whole


def test_samples_without_reliability_tell_no_route():
    assert run(circle(), reliability=None)[0] == [] and run(circle(), reliability=0.0)[0] == []


def test_gates_in_either_order_find_the_same():
    rows = np.array(circle())
    found = detect(dict(zip(("time", "lat", "lon", "ve", "vn"), rows.T, strict=True)), 300)
    assert found["family"] == "si" and found["fit_fraction"] == pytest.approx(1.0) and found["period_s"] == pytest.approx(90, rel=0.03)
    straight = {"time": rows[:, 0], "lat": 31.8 + rows[:, 0] * 1e-5, "lon": np.full(len(rows), 34.8), "ve": rows[:, 3], "vn": rows[:, 4]}
    assert detect(straight, 300) is None


def test_a_change_is_told_as_of_its_beginning():
    cfg = Detection(follow_changes=True)
    changes, state = run(circle(1000, bend=500), cfg)
    kinds = [kind for _, kind in changes]
    assert kinds == ["route_candidate", "route_confirmed", "route_change_candidate", "route_changed", "route_candidate", "route_confirmed"]
    assert changes[3][0] == 500.0 and state.confirmed and changes[5][0] >= 800.0
    assert [kind for _, kind in run(circle(1000), cfg)[0]] == ["route_candidate", "route_confirmed"]
    assert [kind for _, kind in run(circle(1000, bend=500))[0]] == ["route_candidate", "route_confirmed"]


def test_a_short_change_is_cancelled():
    rows, bent = circle(1000), circle(1000, bend=500)
    mixed = [bent[k] if 500 <= k < 545 else rows[k] for k in range(1000)]
    assert [kind for _, kind in run(mixed, Detection(follow_changes=True))[0]] == ["route_candidate", "route_confirmed", "route_change_candidate", "route_change_cancelled"]


def test_changes_of_routes_in_a_session_and_in_batch(spark, tmp_path):
    config = Engine(detection=Detection(follow_changes=True))
    rows = [(T0 + timedelta(seconds=t), 1, 1, 1, True, lat, lon, vn, ve, 1.0) for t, lat, lon, ve, vn in circle(700, bend=450)]
    s = spark.createDataFrame(rows, SAMPLE)
    session = Session(spark, f"file://{tmp_path}", config)
    for at in range(0, 700, 233):
        session.process_batch(s.where((F.unix_timestamp("sample_time") - START).between(at, at + 232)))
    whole = lifecycle.process(s, config=config)
    assert selftest.content(session.all_results()) == selftest.content(whole)
    assert (1, 450, "route_changed") in told(whole)


def test_samples_of_one_time_are_told_by_number(spark):
    rows = [(T0, 1, n, 5, n == 3, None, None, None, None, 1.0) for n in (7, 3, 9)]
    frame = lifecycle.frames_of(lifecycle.process(spark.createDataFrame(rows, SAMPLE))).collect()
    assert len(frame) == 1 and frame[0].active is True


def test_the_self_test_passes_and_notices_a_difference(spark, tmp_path):
    s = circle_samples(spark, [(1, 101, 0.0), (2, 102, 120.0)], 30)
    found = json.loads(selftest.run(spark, s, seconds=10, last=30, split=15))
    assert {c["name"]: c["status"] for c in found["checks"] if c["name"] != "capacity"} == {"batch_increment_equivalence": "passed", "checkpoint_restart_equivalence": "passed"}
    assert found["config_sha256"] == Engine().fingerprint() and found["checks"][1]["metrics"]["samples"] == 62.0
    # increments that leave the last samples out differ
    assert selftest.equivalence_check(s, f"file://{tmp_path}", 10, 19).status == "failed"


def test_a_stream_tells_silence_by_timers_as_the_batch_does(spark, tmp_path):
    rows = [(1, s, s < 25) for s in range(0, 31, 5)] + [(2, s, True) for s in range(0, 401, 20)] + [(3, 0, True), (3, 390, True)] + [(4, 100, None)]
    whole = samples(spark, rows)
    for first in range(0, 401, 100):
        samples(spark, [r for r in rows if first <= r[1] < first + 100]).repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lifecycle.stream_process(spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got, want = told(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")), told(lifecycle.process(whole))
    assert got == want and {kind for _, _, kind in want} == {"vehicle_activated", "vehicle_deactivated", "data_lost", "data_resumed", "vehicle_expired"}


def test_long_streams_pass_by_in_batches(spark):
    """Batches of some dozen rows give what whole streams give."""
    rows = [(T0 + timedelta(seconds=t), 1, v, v, True, lat, lon, vn, ve, 1.0) for v in (1, 2) for t, lat, lon, ve, vn in circle(400)]
    s = spark.createDataFrame(rows, SAMPLE)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = selftest.content(lifecycle.process(s)), selftest.content(lifecycle.route_states(s))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        assert (selftest.content(lifecycle.process(s)), selftest.content(lifecycle.route_states(s))) == whole
        assert lifecycle.route_changes(s).count() == 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
