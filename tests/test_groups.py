"""Groups through time, arrangements of templates, typed points, recomputed scores: against plain Python."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayring.config import Scoring
from wayring.operators import groups, templates as T, typed
from wayring.operators.recompute import ScoreHistory
from wayring.session import shared_folder

LINKS = "server_id long, a long, b long, from_s long, to_s long"


def reach(pairs):
    label = {}
    for a, b in pairs:
        old = {label.get(a, a), label.get(b, b)}
        label.setdefault(a, a)
        label.setdefault(b, b)
        for k, v in label.items():
            if v in old:
                label[k] = min(old)
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    shared_folder(spark)
    rng = random.Random(seed)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.label for r in groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == reach([(a, b) for a, b in pairs if a is not None and a != b])
    assert groups.components(spark.createDataFrame([], "a long, b long")).collect() == []


def simulated(links, keep=0.6):
    """Memberships epoch by epoch."""
    out = {}
    for server in {r[0] for r in links}:
        own = [r[1:] for r in links if r[0] == server]
        times = sorted({t for _, _, f, u in own for t in (f, u)})
        before = {}
        for at, until in zip(times, times[1:]):
            label = reach([(a, b) for a, b, f, u in own if f <= at < u])
            now = {}
            for m, g in label.items():
                now.setdefault(g, set()).add(m)
            ids = {}
            for g, members in now.items():
                heirs = [i for i, old in before.items() if len(old & members) >= keep * len(old)]
                ids[g] = heirs[0] if len(heirs) == 1 else f"{server}:{at}:{g}"
            before = {ids[g]: members for g, members in now.items()}
            for i, members in before.items():
                for m in members:
                    spans = out.setdefault((server, m, i), [])
                    if spans and spans[-1][1] == at:
                        spans[-1][1] = until
                    else:
                        spans.append([at, until])
    return sorted((s, m, i, a, z) for (s, m, i), spans in out.items() for a, z in spans)


@pytest.mark.parametrize("seed", range(4))
def test_memberships_equal_a_simulation(spark, seed):
    shared_folder(spark)
    rng = random.Random(seed)
    links = {}
    for _ in range(50):
        server, a = rng.randint(1, 2), rng.randint(1, 11)
        b = a + rng.randint(1, 3)
        begin = rng.randint(0, 60) * 10
        links[server, a, b, begin] = (server, a, b, begin, begin + rng.randint(1, 20) * 10)
    rows = list(links.values())
    got = sorted(map(tuple, groups.memberships(spark.createDataFrame(rows, LINKS)).collect()))
    assert got == simulated(rows)


def test_links_count_after_two_minutes_and_outlive_silence(spark):
    rows = [(1, 2, 1, 0, 100), (1, 1, 2, 390, 420), (1, 3, 4, 0, 119), (1, 3, 4, 420, 500), (1, 5, 6, 0, 60), (1, 7, 7, 0, 900)]
    got = sorted(map(tuple, groups.stable_links(spark.createDataFrame(rows, "server_id long, a long, b long, start_s long, end_s long")).collect()))
    assert got == [(1, 1, 2, 120, 720)]


def test_wrong_ways_lead_to_an_alert_and_out(spark):
    spells = spark.createDataFrame([(1, 1, 0, 59), (1, 2, 0, 60), (1, 3, 100, 460), (1, 4, 100, 700)], "server_id long, member long, start_s long, end_s long")
    got = {r.member: (r.alert_s, r.exit_s) for r in groups.wrong_ways(spells).collect()}
    assert got == {2: (60, None), 3: (160, None), 4: (160, 460)}
    links = spark.createDataFrame([(1, 4, 5, 0, 900), (1, 5, 6, 0, 900)], LINKS)
    exits = spark.createDataFrame([(1, 4, 460, 700), (1, 4, 600, 750), (1, 6, 0, 100), (2, 5, 0, 900), (1, 6, 800, 1000)], "server_id long, member long, from_s long, to_s long")
    assert sorted(map(tuple, groups.without_exits(links, exits).collect())) == [(1, 4, 5, 0, 460), (1, 4, 5, 750, 900), (1, 5, 6, 100, 800)]


def test_a_reversal_of_all_is_none_of_one(spark):
    rows = [(1, 1, m, s, -1 if s >= 50 or (m == 2 and s >= 20) else 1) for m in (1, 2, 3) for s in range(100)]
    got = sorted(map(tuple, groups.against_group(spark.createDataFrame(rows, "server_id long, group_id long, member long, second long, direction long")).collect()))
    assert got == [(1, 1, 2, 20, 49)]


def test_changelog(spark):
    m = spark.createDataFrame([(1, 5, "g", 3, 9)], "server_id long, member long, group_id string, from_s long, to_s long")
    assert sorted(map(tuple, groups.group_changelog(m).collect())) == [(3, "group_joined", 1, 5, "g"), (9, "group_left", 1, 5, "g")]


def delta(a, b):
    d = abs(a - b) % 1.0
    return min(d, 1.0 - d)


def center(values):
    found = []
    for anchor in values:
        line = sorted(anchor + (v - anchor + 0.5) % 1.0 - 0.5 for v in values)
        c = ((line[(len(line) - 1) // 2] + line[len(line) // 2]) / 2) % 1.0
        found.append((sum(delta(v, c) for v in values), max(delta(v, c) for v in values), c))
    return min(found)


def test_fits_equal_all_permutations(spark):
    rng = random.Random(8)
    shapes = [T.Template(f"t{k}", "si", tuple(T.Slot(f"s{j}", rng.choice("AB"), rng.random(), rng.choice([1, 1, -1]), rng.choice([None, None, "in"])) for j in range(n))) for k, n in enumerate([2, 3, 4, 5, 5, 3])]
    rows = []
    for g in range(60):
        shape = rng.choice(shapes)
        for m, s in enumerate(rng.sample(shape.slots, len(shape.slots))):
            rows.append((g, m, s.vehicle_type, rng.random() * 3 - 1, rng.choice(["in", "out", None])))
    df = spark.createDataFrame(rows, "group_id long, member long, vehicle_type string, phase double, role string")
    got = {(r.group_id, r.template_id): (r.mean_error, r.max_error) for r in T.fit_templates(df, shapes).collect()}
    want = {}
    for g in range(60):
        members = [r for r in rows if r[0] == g]
        for shape in shapes:
            for order in permutations(shape.slots):
                if len(order) == len(members) and all(s.vehicle_type == m[2] and s.role in (None, m[4]) for s, m in zip(order, members)):
                    total, most, _ = center([(m[3] % 1.0 * s.sign - s.offset % 1.0) % 1.0 for s, m in zip(order, members)])
                    found = (round(total / len(members), 15), round(most, 15))
                    want[g, shape.template_id] = min(want.get((g, shape.template_id), found), found)
    assert set(got) == set(want) and want
    for key, (mean, most) in want.items():
        assert got[key][0] == pytest.approx(mean, abs=1e-12) and got[key][1] == pytest.approx(most, abs=1e-9)


def test_eight_slots_alike_or_different_and_many_templates(spark):
    alike = T.Template("alike", "si", tuple(T.Slot(f"s{k}", "x", k / 8) for k in range(8)))
    different = [T.Template(f"d{n}", "si", tuple(T.Slot(f"s{k}", f"t{k}", (k * (n + 1) / 8) % 1.0) for k in range(8))) for n in range(1000)]
    rows = [(1, k, "x", k / 8 + 0.03) for k in range(8)] + [(2, k, f"t{k}", k * 3 / 8 + 0.2) for k in range(8)]
    found = {(r.group_id, r.template_id): r for r in T.fit_templates(spark.createDataFrame(rows, "group_id long, member long, vehicle_type string, phase double"), [alike, *different]).collect()}
    assert len(found) == 1001 and found[1, "alike"].mean_error == pytest.approx(0, abs=1e-9) and found[2, "d2"].mean_error == pytest.approx(0, abs=1e-9)
    assert T.template_table(spark, [alike, *different]).count() == 1001


def judged(spark, rows):
    """Rows of (metric, second or None, JSON text)."""
    df = spark.createDataFrame([(1, 1, m, t, v, k) for k, (m, t, v) in enumerate(rows)], "server_id long, vehicle_number long, metric string, second long, json string, ingest_order long")
    points = df.select("server_id", "vehicle_number", "metric", F.timestamp_seconds("second").alias("source_time"), F.parse_json("json").alias("value"), "ingest_order")
    return typed.sorted_out(points)


def test_equality_of_typed_values(spark):
    lat = "latitude_deg"
    rows = [(lat, 1, "true"), (lat, 1, "1"), (lat, 1, "1.0"), (lat, 2, "107"), (lat, 2, "107.0"), (lat, 3, '"1"'), (lat, 3, "1"), (lat, 4, "9007199254740993"), (lat, 4, "9007199254740992"), (lat, 5, '" 1_0.5e1 "'), (lat, 5, '"105"')]
    j = judged(spark, rows)
    assert sorted((int(r.source_time.timestamp()), r.reason, r.copies) for r in typed.refused(j).collect()) == [(1, "repeated", 2), (2, "repeated", 1), (3, "conflict", 1), (4, "conflict", 1), (5, "conflict", 1)]
    assert sorted((int(r.source_time.timestamp()), r.value) for r in typed.accepted(j).collect()) == [(1, 1.0), (2, 107.0), (3, 1.0), (4, 9007199254740992.0), (5, 105.0)]


def test_reasons_of_refused_points(spark):
    rows = [
        ("latitude_deg", 1, '"abc"'), ("latitude_deg", 2, '"-Infinity"'), ("latitude_deg", 3, "null"), ("latitude_deg", 4, '{"a": 1}'), ("latitude_deg", None, "1"), ("colour", 1, "1"), (None, 1, "1"),
        ("vehicle_identifier", 1, "1.5"), ("vehicle_identifier", 2, "-1"), ("vehicle_identifier", 3, '"12"'), ("vehicle_identifier", 4, "12.0"), ("vehicle_identifier", 5, "true"),
        ("active", 1, '" ON "'), ("active", 2, "false"), ("active", 3, "1"), ("active", 4, "1.0"), ("active", 5, '"maybe"'), ("active", 6, "0"), ("latitude_deg", 7, '"1.0d"'), ("latitude_deg", 7, "5"),
    ]
    j = judged(spark, rows)
    second = lambda r: None if r.source_time is None else int(r.source_time.timestamp())
    assert sorted(((r.metric, second(r), r.reason) for r in typed.refused(j).collect()), key=repr) == sorted(
        [
            ("latitude_deg", 1, "not_numeric"), ("latitude_deg", 2, "not_finite"), ("latitude_deg", 3, "no_value"), ("latitude_deg", 4, "not_numeric"), ("latitude_deg", None, "no_time"), ("colour", 1, "unknown_metric"), (None, 1, "unknown_metric"),
            ("vehicle_identifier", 1, "not_whole"), ("vehicle_identifier", 2, "not_whole"), ("active", 4, "not_mapped"), ("active", 5, "not_mapped"), ("latitude_deg", 7, "not_numeric"),
        ], key=repr,
    )
    assert sorted((r.metric, second(r), r.value) for r in typed.accepted(j).collect()) == [
        ("active", 1, 1.0), ("active", 2, 0.0), ("active", 3, 1.0), ("active", 6, 0.0), ("latitude_deg", 7, 5.0), ("vehicle_identifier", 3, 12.0), ("vehicle_identifier", 4, 12.0), ("vehicle_identifier", 5, 1.0),
    ]
    assert typed.accepted(j).count() + typed.refused(j).agg(F.sum("copies")).first()[0] == len(rows)


def test_scores_are_computed_once_for_each_setting(spark, tmp_path):
    from wayring.sources.fixtures import primitive_metrics

    metrics = primitive_metrics(spark, "/root/testdata/sf0.001").withColumn("day", F.pmod("group_id", F.lit(3)))
    history = ScoreHistory(spark, f"file://{tmp_path}")
    old, new = Scoring(), Scoring(total_weights=(10.0, 90.0))
    early = metrics.where("day < 2")
    assert [history.recompute(early, old), history.recompute(early, old), history.recompute(metrics, old), history.recompute(metrics, new), history.recompute(metrics, new)] == [2, 0, 1, 3, 0]
    assert history.scores(old).count() == history.scores(new).count() == metrics.count()
    assert history.scores(old).agg(F.avg("total")).first() != history.scores(new).agg(F.avg("total")).first()


@pytest.mark.parametrize("seed", range(3))
def test_memberships_of_crowds_equal_those_of_all_pairs(spark, seed):
    from wayring.operators import crowds

    shared_folder(spark)
    rng = random.Random(seed)
    rows, pairs = [], []
    for m in range(26):
        server, place = rng.randint(1, 2), rng.randint(0, 4)
        start = rng.randint(0, 20) * 40
        for _ in range(rng.randint(1, 2)):
            end = start + rng.choice([100, 120, 160, 300, 520])
            rows.append((server, m, place, start, end))
            start = end + rng.choice([301, 340, 500])
    # places stand in a row; the neighbours of a place are near it
    for s, a, p, f, t in rows:
        for s2, b, p2, f2, t2 in rows:
            if s == s2 and a < b and abs(p - p2) in (0, 1) and max(f, f2) < min(t, t2):
                pairs.append((s, a, b, max(f, f2), min(t, t2)))
    links = [tuple(r) for r in groups.stable_links(spark.createDataFrame(pairs, "server_id long, a long, b long, start_s long, end_s long")).collect()]
    spells = spark.createDataFrame(rows, "server_id long, member long, place long, start_s long, end_s long")
    got = sorted(map(tuple, crowds.memberships(spells, lambda a, b: F.abs(a - b) == 1).collect()))
    assert got == simulated(links) and got
    assert sorted(map(tuple, crowds.links(spells, lambda a, b: F.abs(a - b) == 1).collect())) == sorted(links)


def test_crowds_grow_without_their_pairs(spark):
    from wayring.operators import crowds

    shared_folder(spark)
    spells = spark.range(20_000).select(F.lit(1).cast("long").alias("server_id"), F.col("id").alias("member"), (F.col("id") % 2).alias("place"), (F.col("id") % 50).alias("start_s"), (F.col("id") % 50 + 400).alias("end_s"))
    got = crowds.memberships(spells, lambda a, b: F.abs(a - b) == 1)
    # when 400 of the last 800 leave at once, those who stay are a new group
    assert sorted(r["count"] for r in got.groupBy("group_id").count().collect()) == [400, 20_000]


def test_spells_whose_links_would_run_together_are_refused(spark):
    from wayring.operators import crowds

    spells = spark.createDataFrame([(1, 1, 0, 0, 200), (1, 1, 0, 400, 700)], "server_id long, member long, place long, start_s long, end_s long")
    with pytest.raises(Exception, match="more than the hold apart"):
        crowds.islands(spells).collect()


def test_links_of_one_place_are_dealt_to_many_parts_and_never_shuffled(spark):
    from wayring.operators import crowds

    spells = spark.range(400).select(F.lit(1).cast("long").alias("server_id"), F.col("id").alias("member"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("start_s"), F.lit(200).cast("long").alias("end_s"))
    got = crowds.links(spells, lambda a, b: F.lit(False))
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 400 * 399 // 2 and len(parts) > 3


def test_candidates_read_their_members_once(spark):
    from wayring.plans.templates import TEMPLATES
    from wayring.sources.fixtures import template_members

    plan = T.candidates(template_members(spark, "/root/testdata/sf0.001"), TEMPLATES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    rows = [(1, m, "A", 0.1 * m) for m in range(5)] + [(2, m, "A", 0.1 * m) for m in range(2)]
    found = T.candidates(spark.createDataFrame(rows, "group_id long, member long, vehicle_type string, phase double"), TEMPLATES).collect()
    assert [(r.group_id, r.template_id, r.n) for r in found] == [(2, "pair", 2)]


def test_fits_of_many_groups_equal_those_of_each():
    rng = random.Random(3)
    slots = [("b", "A", 0.0, 1, None), ("a", "A", 0.25, -1, None), ("d", "B", 0.5, 1, "in"), ("c", "A", 0.75, 1, None)]
    kinds = (("A", None), ("B", "in"), ("A", None), ("A", "in"))
    phases = [[rng.choice([0.0, 0.25, 0.5, 0.75, rng.random()]) for _ in kinds] for _ in range(3000)]
    got = T.best_fits(kinds, np.array(phases), slots)
    assert got == [T.best_fit([(*k, p) for k, p in zip(kinds, row)], slots) for row in phases]
    assert T.best_fits((("C", None), ("A", None)), np.array([[0.1, 0.2]]), slots[:2]) == [None]


def test_advantages_take_an_expression(spark):
    s = spark.createDataFrame([(1, "p", 40.0), (1, "z", 90.0), (1, "q", 90.0), (2, "p", 40.0), (3, "q", 40.0)], "group_id long, template_id string, score double")
    own = s.select("group_id").distinct().withColumn("current_template_id", F.lit("p"))
    assert T.advantages(s, F.lit("p")).collect() == T.advantages(s, own).collect() == [(1, "q", 50.0)]
