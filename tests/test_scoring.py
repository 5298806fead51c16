from pyspark.sql import functions as F
import pytest

from wayring.config import Band, Engine, Scoring
from wayring.functions.scoring import band_score, group_scores, with_scores

METRICS = "group_id long, position long, family string, active boolean, position_error double, period_error_ratio double, movement_error_ratio double, distance_error_b_ratio double, tangent_error_deg double, curvature_error_ratio double, reliability double, speed_fraction double, wrong_direction_seconds double"


def metrics(spark, *changes):
    ideal = dict(group_id=1, position=1, family="si", active=True, position_error=0.0, period_error_ratio=0.0, movement_error_ratio=0.0, distance_error_b_ratio=0.0, tangent_error_deg=0.0, curvature_error_ratio=0.0, reliability=1.0, speed_fraction=1.0, wrong_direction_seconds=0.0)
    rows = [ideal | {"position": k} | c for k, c in enumerate(changes, 1)]
    names = [c.split()[0] for c in METRICS.split(", ")]
    return with_scores(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], METRICS))


def one(spark, **change):
    return metrics(spark, change).first()


def test_bands(spark):
    values = spark.createDataFrame([(0.0,), (10.0,), (20.0,), (30.0,), (99.0,), (None,)], "e double").select(band_score(F.col("e"), Band(10, 30)).alias("s"))
    assert [r.s for r in values.collect()] == [100.0, 100.0, 50.0, 0.0, 0.0, None]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1.0,)], "e double").select(band_score(F.col("e"), Band(10, 30))).collect()
    with pytest.raises(ValueError):
        Band(3, 2)


def test_ideal_vehicle(spark):
    r = one(spark)
    assert (r.sync, r.route, r.total, r.primary_reason) == (100.0, 100.0, 100.0, None)


def test_half_position_error(spark):
    r = one(spark, position_error=20.0)
    assert (r.sync, r.total, r.primary_reason) == (70.0, 77.5, "phase_alignment")


def test_so_uses_cycles(spark):
    assert one(spark, family="so", position_error=0.15).c_position == pytest.approx(50.0)


def test_low_speed_hides_tangent_and_curvature(spark):
    r = one(spark, speed_fraction=0.2, tangent_error_deg=90.0, curvature_error_ratio=5.0)
    assert r.route == 100.0 and r.c_tangent is None and r.c_curvature is None


def test_wrong_direction(spark):
    r = one(spark, wrong_direction_seconds=60.0)
    assert (r.sync, r.total, r.primary_reason) == (0.0, 25.0, "wrong_direction")


def test_invalid_rows(spark):
    reasons = [r.primary_reason for r in metrics(spark, {"active": None}, {"active": False}, {"reliability": 0.59}, {"family": "free"}).orderBy("position").collect()]
    assert reasons == ["inactive", "inactive", "low_reliability", "free_route"]


def test_groups(spark):
    g = group_scores(metrics(spark, {"position_error": 20.0}, {}, {"active": False}), "group_id", "position").first()
    assert (g.valid, g.valid_vehicles, g.members, g.sync, g.route, g.total, g.primary_reason) == (True, 2, 3, 85.0, 100.0, 88.75, "phase_alignment")
    alone = group_scores(metrics(spark, {}), "group_id", "position").first()
    assert (alone.valid, alone.total, alone.primary_reason) == (False, None, "insufficient_coverage")


def test_reason_ties_by_first_occurrence(spark):
    g = group_scores(metrics(spark, {"period_error_ratio": 0.2}, {"movement_error_ratio": 0.3}), "group_id", "position").first()
    assert g.primary_reason == "period"


def test_config_round_trip():
    e = Engine(scoring=Scoring(low_below=40.0))
    assert Engine.from_json(e.to_json()) == e and e.fingerprint() != Engine().fingerprint()
