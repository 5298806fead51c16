"""The polling source: what is fetched when, restarts, and reads that are counted."""

import json

from wayring.sources.polling import POINTS, Fetch, PlanLog, PolledServers, Polling, polled

CFG = Polling(awake_seconds=60)


def polls(identifiers, servers, until, cfg=CFG, wanted=None):
    """All fetches by poll time, and the servers that were asked for by each question."""
    asked, out, state = [], {}, {}

    def newest(some, after, upto):
        asked.append(list(some))
        found = {s: max((t for t in identifiers.get(s, ()) if after < t <= upto), default=None) for s in some}
        return {s: t for s, t in found.items() if t is not None}

    for now in range(0, until + 1, cfg.awake_seconds):
        state, fetches = polled(json.loads(json.dumps(state)), now, servers, newest, cfg, tuple(wanted or ()) if now == 120 else ())
        out[now] = [(f.server, f.after, f.until) for f in fetches]
    return out, asked


def test_dormant_servers_share_one_probe():
    found, asked = polls({}, [1, 2, 3], 900)
    assert not any(found.values()) and asked == [[1, 2, 3]] * 4


def test_waking_reads_back_and_sleep_follows_silence():
    found, asked = polls({2: range(400, 701, 30)}, [1, 2], 1500)
    assert found[600] == [(2, 300, 600)] and found[660] == [(2, 600, 660)] and not any(found[t] for t in range(0, 600, 60))
    # the last identifier is at 700: the poll at 1020 finds five minutes without any
    assert found[1020] == [(2, 960, 1020)] and not any(found[t] for t in range(1080, 1501, 60))
    assert asked.count([1, 2]) == 5 and [1] in asked


def test_a_return_takes_in_what_came_late():
    found, _ = polls({1: [*range(10, 301, 10), *range(550, 900, 10)]}, [1], 900)
    assert found[600] == [(1, 300, 600)]
    assert found[660] == [(1, 600, 660)]


def test_a_wanted_server_wakes_at_once():
    found, _ = polls({}, [1, 2], 600, wanted=[2])
    assert found[120] == [(2, -180, 120)] and found[180] == [(2, 120, 180)] and not found[480]


def test_the_stream_reads_what_the_polls_fetch(spark, tmp_path):
    rows = [(s, s * 10, m, t, float(t)) for s in (1, 2, 3) for t in range(0, 2000, 20) for m in ("vehicle_identifier", "latitude_deg") if m != "vehicle_identifier" or (s == 2 and 400 <= t <= 700) or (s == 3 and t > 1500)]
    spark.createDataFrame(rows, POINTS).write.parquet(f"{tmp_path}/points")
    spark.dataSource.register(PolledServers)

    def run(end):
        stream = spark.readStream.format("polled_servers").options(path=f"{tmp_path}/points", plans=f"file://{tmp_path}/plans", servers="[1, 2, 3]", start="0", end=str(end), polls="7", polling=json.dumps({"awake_seconds": 60})).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        query.processAllAvailable()
        query.stop()

    run(900)
    run(2000)  # a restart goes on behind the last plan
    identifiers = {s: [t for k, _, m, t, _ in rows if k == s and m == "vehicle_identifier"] for s in (1, 2, 3)}
    found, _ = polls(identifiers, [1, 2, 3], 1980)
    want = sorted(repr(r) for fetches in found.values() for server, after, until in fetches for r in rows if r[0] == server and after < r[3] <= until)
    assert sorted(repr(tuple(r)) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want and want
    log = PlanLog(f"file://{tmp_path}/plans")
    planned = [Fetch(**f) for n in range(1, log.newest() + 1) for f in log.read(n)["fetches"]]
    assert [(f.server, f.after, f.until) for f in planned] == [f for now in sorted(found) for f in found[now]]
