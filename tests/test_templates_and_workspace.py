import pytest
from pyspark.sql import functions as F

from wayring.operators import events, templates as T, workspace as W

RING = T.Template("ring", "si", tuple(T.Slot(f"s{k}", f"t{k}", k / 3) for k in range(3)))


def fit(spark, members, template):
    df = spark.createDataFrame([(1, f"m{k}", t, p) for k, (t, p) in enumerate(members)], "group_id long, member string, vehicle_type string, phase double")
    return T.fit_templates(df, [template])


def test_ring_with_common_phase(spark):
    r = fit(spark, [(f"t{k}", k / 3 + 31 / 360) for k in range(3)], RING).first()
    assert r.common_phase * 360 == pytest.approx(31) and r.max_error == pytest.approx(0, abs=1e-9)


def test_pair_splits_the_error_evenly(spark):
    pair = T.Template("pair", "si", (T.Slot("a", "x", 0.0), T.Slot("b", "x", 0.5)))
    m = T.member_fits(fit(spark, [("x", 0.0), ("x", 0.6)], pair)).collect()
    assert [r.error_cycle for r in m] == pytest.approx([0.05, 0.05])


def test_types_and_counts_must_match(spark):
    assert fit(spark, [("t0", 0.0), ("t1", 0.3)], RING).count() == 0
    assert fit(spark, [("t0", 0.0), ("t1", 0.3), ("t1", 0.6)], RING).count() == 0


def test_opposite_sign(spark):
    pair = T.Template("pair", "si", (T.Slot("a", "x", 0.0), T.Slot("b", "y", 0.0, -1)))
    r = fit(spark, [("x", 0.2), ("y", 0.8)], pair).first()
    assert r.common_phase == pytest.approx(0.2) and r.max_error == pytest.approx(0, abs=1e-9)


def test_bad_templates():
    with pytest.raises(ValueError):
        T.Template("t", "free", RING.slots)
    with pytest.raises(ValueError):
        T.Template("t", "si", RING.slots[:1])


def test_mirrored_templates_share_a_key(spark):
    rows = spark.createDataFrame([("SO", "m", "a — b — c", [2, 0]), ("SO", "m", "c — b — a", [0, 2]), ("SI", "m", "a — b", [1, 2]), ("SI", "m", "b — a", [2, 1])], "f string, m string, c string, v array<int>")
    keys = [r.k for r in rows.select(W.canonical_key(F.col("f"), F.col("m"), F.col("c"), F.col("v")).alias("k")).collect()]
    assert keys[0] == keys[1] and keys[2] != keys[3]


def test_every_template_is_compared(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (4, "a"), (5, "b"), (6, "a"), (7, "c")], "template_id long, key string")
    assert sorted((r.template_id, r.first_id) for r in W.duplicates_of_first(rows).collect()) == [(4, 1), (5, 2), (6, 1)]


def test_large_groups_keep_their_first_five_places(spark):
    groups = spark.createDataFrame([(1, 1), (2, 3), (3, 7)], "group_id long, n int")
    got = {(r.group_id, r.first, r.second) for r in W.vehicle_pairs(W.first_places(groups)).collect()}
    assert got == {(g, i, j) for g, n in ((2, 3), (3, 5)) for j in range(n) for i in range(j)}


def test_writes_get_revisions_and_limits(spark):
    log = spark.createDataFrame([("w", 4, "x")], "workspace_id string, revision long, state string")
    writes = spark.createDataFrame([("w", "a", 1, "d" * 600), ("w", "b", 2, "e"), ("bad id!", "c", 3, "f")], "workspace_id string, state string, arrival long, detail string")
    out = W.accepted_writes(writes, log).orderBy("revision").collect()
    assert [(r.revision, r.state) for r in out] == [(5, "a"), (6, "b")] and len(out[0].detail) == 500


def test_hydration_and_mapping(spark):
    r = spark.range(1).select(W.hydrated(F.create_map(F.lit("a"), F.lit(9)), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).alias("m")).first()
    assert r.m == {"a": 9, "b": 2}
    raw = spark.createDataFrame([("b", "active", "color", "green", 5)], "bucket string, measurement string, key string, value string, t int")
    mapping = spark.createDataFrame([("b", "active", "color", "active", "special", "green", "true", "forward-fill")], "bucket string, measurement string, key string, system_key string, value_mode string, source_value string, mapped_value string, fill_mode string")
    assert tuple(W.mapped_values(raw, mapping).first()) == (5, "active", "true", "forward-fill")


def test_rebalanced(spark):
    rows = [("x", 1, 60, 40), ("x", 2, 20, None), ("x", 3, 20, None), ("y", 1, 7, None), ("z", 1, 0, None), ("z", 2, 0, None), ("z", 3, 9, 30)]
    got = {(r.set_id, r.place): r.weight for r in W.rebalanced(spark.createDataFrame(rows, "set_id string, place int, weight int, value int")).collect()}
    assert got == {("x", 1): 40, ("x", 2): 30, ("x", 3): 30, ("y", 1): 7, ("z", 1): 35, ("z", 2): 35, ("z", 3): 30}


def test_templates_need_finite_offsets():
    with pytest.raises(ValueError):
        T.Template("t", "si", (T.Slot("a", "A", 0.0), T.Slot("b", "A", float("inf"))))


def test_group_identity(spark):
    before = spark.createDataFrame([(1, m) for m in "abcde"] + [(2, m) for m in "xy"], "group_id long, member string")
    after = spark.createDataFrame([(7, m) for m in "abc"] + [(8, m) for m in "dexy"], "group_id long, member string")
    got = {r.group_id: r.kept_id for r in events.group_identity(before, after).collect()}
    assert got == {7: 1, 8: 2}


def test_many_ranges_of_types_meet_their_ids_without_a_broadcast(spark):
    types = spark.createDataFrame([(k, k * 30, k * 30 + 19) for k in range(40)], "type_id long, min_id long, max_id long")
    vehicles = spark.range(0, 1300, 7).withColumnRenamed("id", "vehicle_id")
    plain, dealt = (sorted(map(tuple, W.with_vehicle_type(vehicles, types, most, 16).select("vehicle_id", "type_id").collect()), key=repr) for most in (100, 0))
    assert plain == dealt and len(plain) == vehicles.count()
