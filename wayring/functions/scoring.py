"""Score expressions: error bands, weighted means over what is there, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayring.config import Band, Scoring, shares

#: Reason texts in the order in which equal losses are told.
REASONS = ("phase_alignment", "period", "movement", "distance", "tangent", "curvature")


def band_score(error: Column, band: Band) -> Column:
    """100 through ``band.full``, 0 from ``band.zero``, linear between; null stays null, negative errors are raised."""
    linear = F.lit(100.0) * (F.lit(band.zero) - error) / F.lit(band.zero - band.full)
    return (
        F.when(error < 0, F.raise_error(F.lit("error must not be negative")).cast("double"))
        .when(error <= band.full, F.lit(100.0))
        .when(error >= band.zero, F.lit(0.0))
        .when(error.isNotNull(), linear)
    )


def weighted_mean(values: list[Column], weights: tuple[float, ...]) -> Column:
    """Mean over the values that are not null, weights renormalised."""
    top = sum((F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    bottom = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    return top / F.nullif(bottom, F.lit(0.0))


def validity_reason(cfg: Scoring = Scoring()) -> Column:
    """Why a vehicle has no score, null if it has one: not active, then reliability, then a free route."""
    return (
        F.when(~F.coalesce(F.col("active"), F.lit(False)), "inactive")
        .when(F.col("reliability") < cfg.least_reliability, "low_reliability")
        .when(F.col("family") == "free", "free_route")
    )


def with_scores(metrics: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    """``metrics`` with validity, component scores, the three scores, losses by reason and the primary reason.

    Expects the columns of :func:`wayring.sources.fixtures.primitive_metrics`.  One projection after another, no
    shuffle.  Invalid rows have null scores and their validity reason as primary reason.
    """
    low_speed = F.col("speed_fraction") < cfg.least_speed_fraction
    valid = F.col("invalid_reason").isNull()
    scored = metrics.withColumn("invalid_reason", validity_reason(cfg)).withColumns({"valid": valid, "low_speed": low_speed})
    position = F.when(F.col("family") == "si", band_score(F.col("position_error"), cfg.si_position)).otherwise(band_score(F.col("position_error"), cfg.so_position))
    parts = {
        "c_position": position,
        "c_period": band_score(F.col("period_error_ratio"), cfg.period),
        "c_movement": band_score(F.col("movement_error_ratio"), cfg.movement),
        "c_distance": band_score(F.col("distance_error_b_ratio"), cfg.distance),
        "c_tangent": F.when(~F.col("low_speed"), band_score(F.col("tangent_error_deg"), cfg.tangent)),
        "c_curvature": F.when(~F.col("low_speed"), band_score(F.col("curvature_error_ratio"), cfg.curvature)),
    }
    scored = scored.withColumns({name: F.when(F.col("valid"), value) for name, value in parts.items()})
    sync_w, route_w, total_w = shares(cfg.sync_weights), shares(cfg.route_weights), shares(cfg.total_weights)
    weights = [w * total_w[0] for w in sync_w] + [w * total_w[1] for w in route_w]
    scored = scored.withColumns({f"loss_{r}": (F.lit(100.0) - F.col(c)) * F.lit(w) for r, c, w in zip(REASONS, parts, weights, strict=True)})
    backwards = (F.col("family") == "si") & ~F.col("low_speed") & (F.col("wrong_direction_seconds") >= cfg.wrong_direction_seconds)
    names = list(parts)
    scored = scored.withColumn("backwards", F.col("valid") & backwards).withColumns(
        {
            "sync_raw": F.when(F.col("valid"), F.when(backwards, F.lit(0.0)).otherwise(weighted_mean([F.col(c) for c in names[:3]], sync_w))),
            "route_raw": F.when(F.col("valid"), weighted_mean([F.col(c) for c in names[3:]], route_w)),
        }
    )
    # the largest loss; among equal ones the first in the order of REASONS
    scored = scored.withColumn("primary_loss", F.greatest(*(F.col(f"loss_{r}") for r in REASONS)))
    worst = F.coalesce(*(F.when(F.col(f"loss_{r}") == F.col("primary_loss"), F.lit(r)) for r in REASONS))
    return scored.withColumns(
        {
            "sync": F.round("sync_raw", 6),
            "route": F.round("route_raw", 6),
            "total": F.round(weighted_mean([F.col("sync_raw"), F.col("route_raw")], total_w), 6),
            "primary_reason": F.coalesce("invalid_reason", F.when(F.col("backwards"), F.lit("wrong_direction")).otherwise(F.when(F.col("primary_loss") > 0, worst))),
        }
    )


def group_scores(scored: DataFrame, group: str, position: str, least_valid: int = 2) -> DataFrame:
    """Means of the valid members' scores and their most common reason, the first by ``position`` among equals.

    Two aggregations on the group key; the first one is partial on (group, reason), so nothing is gathered.
    """
    by_reason = scored.groupBy(group, "primary_reason").agg(
        F.count("*").alias("members"),
        F.count_if("valid").alias("n"),
        F.sum(F.when(F.col("valid"), F.col("sync"))).alias("sync"),
        F.sum(F.when(F.col("valid"), F.col("route"))).alias("route"),
        F.sum(F.when(F.col("valid"), F.col("total"))).alias("total"),
        F.min(F.when(F.col("valid"), F.col(position))).alias("first"),
    )
    told = F.when((F.col("n") > 0) & F.col("primary_reason").isNotNull(), F.struct(F.col("n"), (-F.col("first")).alias("order"), F.col("primary_reason").alias("reason")))
    out = by_reason.groupBy(group).agg(F.sum("members").alias("members"), F.sum("n").alias("valid_vehicles"), F.sum("sync").alias("s"), F.sum("route").alias("r"), F.sum("total").alias("t"), F.max(told).alias("worst"))
    enough = F.col("valid_vehicles") >= least_valid
    mean = {name: F.when(enough, F.round(F.col(x) / F.col("valid_vehicles"), 6)) for name, x in (("sync", "s"), ("route", "r"), ("total", "t"))}
    return out.select(group, "members", "valid_vehicles", enough.alias("valid"), *(c.alias(n) for n, c in mean.items()), F.when(enough, F.col("worst.reason")).otherwise("insufficient_coverage").alias("primary_reason"))
