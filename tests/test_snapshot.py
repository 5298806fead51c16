from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayring.config import Engine, Scoring
from wayring.operators.lifecycle import accepted, state_changes
from wayring.sources import snapshot
from wayring.streaming import lifecycle as streaming

T0 = datetime(2026, 1, 1)


def test_restore_needs_the_same_configuration(spark, tmp_path):
    s = spark.createDataFrame([(1, k % 3, T0 + timedelta(seconds=k, microseconds=549), k % 2 == 0) for k in range(30)], "server_id long, vehicle_identifier long, sample_time timestamp, active boolean")
    early = s.where("second(sample_time) < 20")
    snapshot.export_snapshot(early, str(tmp_path))
    states = snapshot.restore_snapshot(spark, str(tmp_path))
    assert states.count() == 3 and snapshot.resumed_samples(s, states).count() == 10
    with pytest.raises(ValueError, match="configuration"):
        snapshot.restore_snapshot(spark, str(tmp_path), Engine(scoring=Scoring(low_below=1.0)))


def test_partitioned_samples_and_report(spark, tmp_path):
    s = spark.createDataFrame([(1, T0), (2, T0 - timedelta(days=100))], "server_id long, sample_time timestamp")
    snapshot.write_samples(s, str(tmp_path / "s"))
    assert snapshot.retained(spark.read.parquet(str(tmp_path / "s")), "2026-01-02").count() == 1
    e = spark.createDataFrame([(1, "2026-01-01", 5.0), (2, "2026-01-01", 6.0)], "server_id long, start string, score double")
    report = snapshot.report_json(e, 1, "2025-01-01", "2027-01-01").first().report
    assert '"server":1' in report and '"score":5.0' in report and "6.0" not in report


def orbit(spark):
    from wayring.sources.simulator import circle_samples

    return circle_samples(spark, [(1, 101, 0.0), (2, 102, 90.0)], 360)


def test_routes_go_on_from_a_snapshot(spark, tmp_path):
    s = orbit(spark)
    cut = s.where("minute(sample_time) < 3")
    snapshot.export_snapshot(cut, str(tmp_path), routes=streaming.route_states(cut))
    rest = snapshot.resumed_samples(s, snapshot.restore_snapshot(spark, str(tmp_path)))
    states = snapshot.restore_routes(spark, str(tmp_path))
    parts = streaming.route_changes(cut).unionByName(streaming.route_changes(rest, states))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, streaming.route_changes(s).collect()))
    end = {r.vehicle_identifier: r for r in streaming.route_states(rest, states).collect()}
    assert all(r.confirmed and not r.time for r in end.values()) and len(end) == 2


def test_state_changes_go_on_from_a_snapshot(spark, tmp_path):
    seconds = [(1, s, s % 7 != 3) for s in (0, 5, 9, 40, 41, 70, 300)] + [(2, s, True) for s in (0, 60, 61, 900)] + [(None, 30, True)]
    s = spark.createDataFrame([(1, v, T0 + timedelta(seconds=k), a) for v, k, a in seconds], "server_id long, vehicle_identifier long, sample_time timestamp, active boolean")
    early = s.where(F.col("sample_time") <= F.lit(T0 + timedelta(seconds=65)))
    snapshot.export_snapshot(early, str(tmp_path))
    until = F.lit(snapshot.passed_gate(spark, str(tmp_path)).processed_until)
    late = snapshot.resumed_changes(s, snapshot.restore_snapshot(spark, str(tmp_path)), until)
    both = state_changes(early).unionByName(late)
    key = lambda r: repr(tuple(r))
    assert sorted(both.collect(), key=key) == sorted(state_changes(s).collect(), key=key)


@pytest.mark.parametrize("runs", [[(0, 20, 50, 200, 1000)], [(0, 20), (20, 50), (50, 200, 1000)]])
def test_streamed_state_changes_equal_the_batch_form(spark, tmp_path, runs):
    seconds = [(1, s, s % 7 != 3) for s in (0, 0, 5, 9, 40, 41, 70, 300)] + [(2, s, None if s == 61 else True) for s in (0, 60, 61, 900)] + [(None, 30, True)]
    s = spark.createDataFrame([(1, v, T0 + timedelta(seconds=k), a, n) for n, (v, k, a) in enumerate(seconds)], "server_id long, vehicle_identifier long, sample_time timestamp, active boolean, n long")
    for cuts in runs:  # each run goes on from the checkpoint of the one before
        for a, b in zip(cuts, cuts[1:], strict=False):
            s.where(F.col("sample_time").between(F.lit(T0 + timedelta(seconds=a)), F.lit(T0 + timedelta(seconds=b - 1)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = streaming.stream_state_changes(stream, ties=("n",)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
    key = lambda r: repr(tuple(r))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == sorted(state_changes(accepted(s, "n")).collect(), key=key)


def test_debug_state(spark):
    s = orbit(spark)
    early = {r.vehicle_identifier: r for r in streaming.debug_state(streaming.route_states(s.where("minute(sample_time) < 1"))).collect()}
    assert early[101].history_count == 60 and not early[101].confirmed and (early[101].history_end - early[101].history_start).total_seconds() == 59
    late = streaming.debug_state(streaming.route_states(s)).first()
    assert late.history_count == 0 and late.confirmed and late.history_start is None and late.last_evaluation is not None


def test_ranges_have_to_begin_before_they_end(spark):
    with pytest.raises(ValueError, match="range"):
        snapshot.report_json(spark.createDataFrame([(1, "x")], "server_id long, start string"), 1, "2027-01-01", "2026-01-01")


def test_json_lines_round_trip(spark):
    s = orbit(spark).where("second(sample_time) < 5")
    back = snapshot.from_json_lines(snapshot.json_lines(s.withColumn("reliability", F.when(F.col("vehicle_number") == 1, 0.25)))).drop("field_quality")
    assert sorted(back.collect()) == sorted(s.withColumn("reliability", F.when(F.col("vehicle_number") == 1, 0.25).otherwise(1.0)).select(back.columns).collect())


def test_a_lagging_stream_goes_on_from_a_snapshot(spark, tmp_path):
    row = lambda v, second, active: (1, v, T0 + timedelta(seconds=second), active)
    schema = "server_id long, vehicle_identifier long, sample_time timestamp, active boolean"
    snapshot.export_snapshot(spark.createDataFrame([row(1, 0, True), row(2, 0, True), row(1, 100, True), row(3, 0, True)], schema), str(tmp_path))
    until = F.lit(snapshot.passed_gate(spark, str(tmp_path)).processed_until)
    later = spark.createDataFrame([row(2, 60, False), row(3, 15, True), row(1, 90, False)], schema)
    found = snapshot.resumed_changes(later, snapshot.restore_snapshot(spark, str(tmp_path)), until).collect()
    got = sorted((r.vehicle_identifier, int((r.change_time - T0).total_seconds()), r.kind) for r in found)
    assert got == [(2, 60, "data_resumed"), (2, 60, "vehicle_deactivated"), (2, 80, "data_lost"), (3, 15, "data_resumed"), (3, 35, "data_lost")]
