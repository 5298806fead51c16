from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wayring.config import Join
from wayring.operators import lifecycle, temporal
from wayring.sources.fixtures import raw_points

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def points(spark, *rows):
    data = [(1, 7, m, T0 + timedelta(seconds=s), float(v)) for m, s, v in rows]
    return spark.createDataFrame(data, "server_id long, vehicle_number long, metric string, source_time timestamp, value double")


BASE = [("vehicle_identifier", 0, 107), ("active", 0, 1), ("latitude_deg", 0, 31), ("latitude_deg", 2, 33), ("longitude_deg", 0, 34), ("longitude_deg", 2, 36)]


def joined(spark, *rows):
    return [r.asDict() for r in temporal.join_metrics(points(spark, *rows)).orderBy("sample_time").collect()]


def test_linear_interpolation_and_reliability(spark):
    rows = joined(spark, *BASE)
    assert [r["latitude_deg"] for r in rows] == [31.0, 32.0, 33.0]
    assert rows[0]["reliability"] == 1.0 and rows[1]["reliability"] == pytest.approx(0.95) and rows[2]["reliability"] == pytest.approx(0.90)
    assert rows[1]["field_quality"]["latitude_deg"] == "interpolated" and rows[1]["field_quality"]["active"] == "forward_filled"


def test_no_back_fill_of_identifier(spark):
    # at second 1 the position would be interpolated from second 0, when no identifier was known
    rows = joined(spark, ("vehicle_identifier", 1, 107), *BASE[1:])
    assert [(r["sample_time"].second, r["vehicle_identifier"]) for r in rows] == [(2, 107)]


def test_identity_change_blocks_interpolation(spark):
    rows = joined(spark, *BASE, ("vehicle_identifier", 1, 108))
    assert [(r["sample_time"].second, r["vehicle_identifier"]) for r in rows] == [(0, 107), (2, 108)]


def test_inactive_rows_need_no_position(spark):
    rows = joined(spark, ("vehicle_identifier", 0, 107), ("active", 0, 0), ("active", 2, 0))
    assert len(rows) == 3 and all(r["active"] is False and r["latitude_deg"] is None for r in rows)


def test_tolerance_is_inclusive(spark):
    rows = joined(spark, ("vehicle_identifier", 0, 107), ("active", 0, 0), ("active", 6, 0))
    assert [r["sample_time"].second for r in rows] == [0, 1, 2, 3, 4, 5]


def test_conflicts_are_raised_when_strict(spark):
    p = points(spark, *BASE, ("latitude_deg", 0, 40))
    assert temporal.conflicts(p).count() == 1
    with pytest.raises(Exception, match="conflicting"):
        temporal.join_metrics(p, strict=True).collect()


def test_bad_values_are_raised(spark):
    with pytest.raises(Exception, match="mapped"):
        joined(spark, *BASE, ("active", 1, 3))
    with pytest.raises(Exception, match="whole"):
        joined(spark, ("vehicle_identifier", 0, 1.5), *BASE[1:])


def test_values_that_are_not_finite_are_raised(spark):
    for bad in ("nan", "inf", "-inf"):
        with pytest.raises(Exception, match="finite"):
            joined(spark, *BASE[:3], ("latitude_deg", 2, bad), *BASE[4:])
        with pytest.raises(Exception, match="whole"):
            joined(spark, ("vehicle_identifier", 0, bad), *BASE[1:])


def test_activity_as_text(spark):
    p = points(spark, *BASE).withColumn("text", F.when(F.col("metric") == "active", " OFF "))
    assert [r.active for r in temporal.join_metrics(p).collect()] == [False] * 3
    with pytest.raises(Exception, match="mapped"):
        temporal.join_metrics(p.withColumn("text", F.when(F.col("metric") == "active", "maybe"))).collect()


def test_first_of_conflicting_points_stays(spark):
    p = points(spark, ("latitude_deg", 0, 40), ("latitude_deg", 0, 31)).withColumn("ingest_order", F.when(F.col("value") == 40, 1).otherwise(2))
    assert temporal.deduplicated(p).first().value == 40 and temporal.deduplicated(p.drop("ingest_order")).first().value == 31


def test_empty_input(spark):
    assert joined(spark) == []


def samples(spark, *rows):
    return spark.createDataFrame([(1, 107, T0 + timedelta(seconds=s), a) for s, a in rows], "server_id long, vehicle_identifier long, sample_time timestamp, active boolean")


def test_lifecycle_timers(spark):
    c = lifecycle.state_changes(samples(spark, (0, True), (25, True), (26, None), (27, False)), observed_until=F.lit(T0 + timedelta(seconds=400)))
    got = sorted(((r.change_time.replace(tzinfo=timezone.utc) - T0).total_seconds(), r.kind) for r in c.collect())
    assert got == [(0, "vehicle_activated"), (20, "data_lost"), (25, "data_resumed"), (47, "data_lost"), (327, "vehicle_expired")]


def test_late_rows_are_dropped(spark):
    s = samples(spark, (0, True), (0, False), (1, True)).withColumn("n", F.monotonically_increasing_id())
    assert lifecycle.accepted(s, "n").count() == 2


def test_rows_that_grow_wide_are_spread_over_many_tasks(spark):
    rows = temporal.asof_rows(raw_points(spark, "/root/testdata/sf0.001"), Join(grid_seconds=3600, tolerance_seconds=172_800))
    assert rows.rdd.getNumPartitions() == 16
