"""Streams that share a bucket of the stateful operator, and files of the orbits' stream."""

from datetime import UTC, datetime, timedelta

import pytest

from wayring import selftest
from wayring.config import Detection, Engine
from wayring.plans import streaming
from wayring.streaming import lifecycle

T0 = datetime(2026, 1, 1, tzinfo=UTC)
SAMPLE = "sample_time timestamp, server_id long, vehicle_number long, vehicle_identifier long, active boolean, latitude_deg double, longitude_deg double, velocity_north_mps double, velocity_east_mps double, reliability double"


def circling(vehicle, seconds, bend=None, skipped=()):
    """A vehicle on a circle, which grows at ``bend``, but for some seconds."""
    from test_sessions import circle

    return [(T0 + timedelta(seconds=t), 1, vehicle, vehicle, True, lat, lon, vn, ve, 1.0) for t, lat, lon, ve, vn in circle(seconds, period=90.0 + vehicle, bend=bend) if int(t) not in skipped]


@pytest.mark.parametrize("buckets", [1, 3])
def test_streams_of_one_bucket_keep_their_own_states(spark, tmp_path, buckets):
    """Five streams in fewer buckets: routes, a change, silence, expiry and samples of one time told by number, as in one batch."""
    config = Engine(detection=Detection(follow_changes=True))
    rows = circling(1, 700) + circling(2, 700, bend=420) + circling(3, 700, skipped=range(200, 240)) + circling(4, 700, skipped=range(330, 690)) + circling(5, 150)
    rows += [(T0 + timedelta(seconds=s), 1, number, 6, number == 2, None, None, None, None, 1.0) for s in (0, 300) for number in (None, 3, 2)]
    for first in range(0, 700, 100):
        part = [r for r in rows if first <= (r[0] - T0).total_seconds() < first + 100]
        spark.createDataFrame(part, SAMPLE).repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lifecycle.stream_process(spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), config, buckets=buckets)
    out = streaming.run_to_end(spark, stream, "buckets")
    whole = lifecycle.process(spark.createDataFrame(rows, SAMPLE), config=config)
    assert selftest.content(out) == selftest.content(whole)
    assert {r.kind for r in whole.where("output = 'change'").select("kind").distinct().collect()} >= {"route_confirmed", "route_changed", "data_lost", "data_resumed", "vehicle_expired"}


def test_a_micro_batch_of_orbits_has_files_of_all_parts(spark):
    """No two minutes of the stream are written by one task."""
    stream = streaming.orbit_stream(spark, "/root/testdata/sf0.001")
    seen = []
    stream.writeStream.foreachBatch(lambda df, k: seen.append((len(df.inputFiles()), df.count()))).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(n for _, n in seen) == 3580
    assert {files for files, _ in seen} != {1} and len({files for files, _ in seen}) == 1
