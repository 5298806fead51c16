import math

import pytest
from pyspark.sql import functions as F

from wayring.functions import geo
from wayring.operators import detection
from wayring.sources.simulator import circle_samples
from wayring.streaming import lifecycle

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def value(spark, column, points=SQUARE):
    df = spark.createDataFrame([(points,)], "pts array<struct<x:double,y:double>>")
    return df.withColumn("segs", geo.segments(F.col("pts"))).select(column.alias("v")).first().v


def test_square(spark):
    s = F.col("segs")
    assert value(spark, geo.length(s)) == 40.0
    at = value(spark, geo.point_at_phase(s, F.lit(0.125)))
    assert (at.x, at.y) == (5.0, 0.0)
    last = value(spark, geo.point_at_phase(s, F.lit(0.875)))
    assert (last.x, last.y, last.segment) == (0.0, 5.0, 3)
    assert [(p.x, p.y) for p in value(spark, geo.resampled(s, 8))][:3] == [(0.0, 0.0), (5.0, 0.0), (10.0, 0.0)]
    hit = value(spark, geo.project(s, F.lit(5.0), F.lit(-2.0)))
    assert (hit.distance, hit.segment, hit.phase) == (2.0, 0, 0.125)


def test_bad_polylines_are_raised(spark):
    with pytest.raises(Exception, match="three points"):
        value(spark, F.col("segs"), SQUARE[:2])


def test_phases_and_angles(spark):
    assert value(spark, geo.phase_distance(F.lit(0.98), F.lit(0.02))) == pytest.approx(0.04)
    assert value(spark, geo.angle_error_deg(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0))) == 180.0
    assert value(spark, geo.angle_error_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) is None


def test_circle_curvature(spark):
    ring = [(10 * math.cos(2 * math.pi * k / 64), 10 * math.sin(2 * math.pi * k / 64)) for k in range(64)]
    assert value(spark, geo.curvature_at_phase(F.col("segs"), F.lit(0.3)), ring) == pytest.approx(0.1, abs=0.005)


def test_round_trip(spark):
    p = geo.local_m(F.lit(31.81), F.lit(34.82), F.lit(31.8), F.lit(34.8))
    back = value(spark, geo.wgs84(p["x"], p["y"], F.lit(31.8), F.lit(34.8)))
    assert back.lat == pytest.approx(31.81, abs=1e-9) and back.lon == pytest.approx(34.82, abs=1e-9)


def circle(spark, seconds=360):
    return circle_samples(spark, [(1, 101, 0.0), (2, 102, 120.0)], seconds)


def test_circle_is_detected_with_a_bump(spark):
    bump = F.when(F.unix_timestamp("sample_time") % 3600 == 120, F.col("longitude_deg") + 120 / (geo.EARTH_RADIUS_M * math.cos(math.radians(31.8))) * 180 / math.pi).otherwise(F.col("longitude_deg"))
    r = detection.detect_routes(circle(spark).withColumn("longitude_deg", bump)).orderBy("vehicle_identifier").first()
    assert r.family == "si" and r.outliers == 1 and r.direction == "clockwise"
    assert r.long_m == pytest.approx(100, abs=3) and r.period_s == pytest.approx(120, abs=4)


def test_short_or_partial_streams_have_no_route(spark):
    assert detection.detect_routes(circle(spark, 200)).count() == 0
    slow = circle_samples(spark, [(1, 101, 0.0)], 360, period=800.0)
    assert detection.detect_routes(slow).count() == 0


def test_phase_follows_the_route(spark):
    c = circle(spark)
    f = detection.with_phase(c, detection.detect_routes(c))
    assert f.where("phase is null or phase < 0 or phase >= 1 or distance_m > 2").count() == 0


def test_phase_begins_with_the_confirming_sample(spark):
    c = circle(spark)
    changes = lifecycle.route_changes(c).where("kind = 'route_confirmed'").select(*detection.KEY, F.timestamp_seconds("change_s").alias("confirmed_at"))
    f = detection.with_phase(c, detection.detect_routes(c), confirmed=changes).join(changes, detection.KEY)
    assert f.where("(phase is null) = (sample_time >= confirmed_at)").count() == 0 and f.where("phase is null").count() > 0
    assert detection.with_phase(c, detection.detect_routes(c), confirmed=changes.limit(0)).where("phase is not null or route_id is not null").count() == 0


def test_step_and_native_detection_agree(spark):
    c = circle(spark)
    changes = {(r.vehicle_identifier, r.kind): r for r in lifecycle.route_changes(c).collect()}
    start = c.selectExpr("min(unix_timestamp(sample_time)) s").first().s
    confirmed = changes[101, "route_confirmed"].change_s
    assert changes[101, "route_candidate"].change_s - start >= 60 and confirmed - start >= 300
    native = detection.detect_routes(c.where(F.unix_timestamp("sample_time") <= confirmed)).where("vehicle_identifier = 101").first()
    assert changes[101, "route_confirmed"].period_s == pytest.approx(native.period_s) and changes[101, "route_confirmed"].quality == pytest.approx(native.quality)


def test_micro_batches_equal_one_batch(spark, tmp_path):
    c = circle(spark)
    start = c.selectExpr("min(unix_timestamp(sample_time)) s").first().s
    for k in range(0, 361, 90):
        c.where(F.unix_timestamp("sample_time") - start >= k).where(F.unix_timestamp("sample_time") - start < k + 90).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for limit in (2, 10):  # the first run stops after two files; the second goes on from its checkpoint
        stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = lifecycle.stream_route_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
    key = lambda r: tuple(r)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == sorted(lifecycle.route_changes(c).collect(), key=key)


def test_the_least_segment_wins_where_rounding_parts_equal_distances(spark, tmp_path):
    import oracle
    from wayring.plans import catalog

    spark.sql("select 311L as s_suppkey, 1 as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    con = oracle.connect("/nowhere")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    for name in ("project_polyline", "tangent_error"):
        assert oracle.differences(spark, con, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], str(tmp_path)) == []


def test_places_on_a_line_are_computed_once(spark):
    frame = spark.createDataFrame([], "segs array<struct<x:double,y:double,dx:double,dy:double,len:double,before:double>>, phase double")
    plan = frame.select(geo.curvature_at_phase(F.col("segs"), F.col("phase")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") == 3


def test_few_suppliers_are_spread_over_all_tasks(spark):
    from wayring.sources.simulator import orbits

    made = orbits(spark, "/root/testdata/sf0.001", seconds=20)
    assert made.rdd.getNumPartitions() == 4
    assert lifecycle.process(made).rdd.getNumPartitions() == 4
