"""Workspace: template keys, mappings, route bank, labels, and the revisioned key-value store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The separator of constellations, the relation codes, the allowed pair angles, limits of the store.
SEPARATOR = " — "
RELATIONS = {"same": 0, "mixed": 1, "opposite": 2}
PAIR_ANGLES = (45, 90, 120)
MOST_PLACES = 5
WORKSPACE_ID = r"^[A-Za-z0-9_-]{1,80}$"
MOST_STATE_CHARS = 750_000
AUDIT_LIMITS = {"area": 40, "action": 80, "detail": 500}


def canonical_key(family: Column, mix: Column, constellation: Column, values: Column) -> Column:
    """A key that mirrored constellations share; for SO also those with reversed values."""
    mirrored = F.array_join(F.reverse(F.split(constellation, SEPARATOR)), SEPARATOR)
    joined = F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
    backwards = F.array_join(F.transform(F.reverse(values), lambda v: v.cast("string")), ",")
    return F.concat_ws("|", family, mix, F.least(constellation, mirrored), F.when(F.upper(family) == "SI", joined).otherwise(F.least(joined, backwards)))


def new_templates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose canonical key no existing template has; both need a column ``key``."""
    return candidates.join(existing.select("key").distinct(), "key", "left_anti")


def duplicates_of_first(templates: DataFrame) -> DataFrame:
    """Templates (``template_id, key``) whose key one of a smaller id has, with the least such id as ``first_id``."""
    first = templates.groupBy("key").agg(F.min("template_id").alias("first_id"))
    return templates.join(first, "key").where("template_id > first_id")


def first_places(members: DataFrame) -> DataFrame:
    """Groups (``group_id, n``) with no more places than a template has; the first ones of larger groups stay."""
    return members.withColumn("n", F.least("n", F.lit(MOST_PLACES)))


def relation_code(relation: Column) -> Column:
    return F.when(relation == "same", 0).when(relation == "mixed", 1).otherwise(2)


def relation_name(code: Column) -> Column:
    return F.when(code == 0, "same").when(code == 1, "mixed").otherwise("opposite")


def vehicle_pairs(members: DataFrame, angle: Column | None = None) -> DataFrame:
    """Pairs i < j of a group's places (``group_id, n`` with n places), with an angle; 90 by default."""
    i = F.explode(F.sequence(F.lit(0), F.col("n") - 2))
    rows = members.where("n >= 2").withColumn("first", i).withColumn("second", F.explode(F.sequence(F.col("first") + 1, F.col("n") - 1)))
    return rows.select("group_id", "first", "second", (F.lit(90) if angle is None else angle).alias("angle"))


def angle_sets(count: Column) -> Column:
    """Five angle patterns for the pairs of 2 to 5 vehicles; no pattern for other counts."""
    pairs = (count * (count - 1) / 2).cast("int")
    places = F.sequence(F.lit(0), pairs - 1)
    rotated = lambda by: F.transform(places, lambda k: F.get(F.array(*map(F.lit, PAIR_ANGLES)), ((k + by) % len(PAIR_ANGLES)).cast("int")))
    sets = F.array(*(F.array_repeat(F.lit(a), pairs) for a in PAIR_ANGLES), rotated(0), rotated(1))
    return F.when(count.between(2, 5), sets).otherwise(F.array().cast("array<array<int>>"))


def vehicles_of_pairs(pairs: Column) -> Column:
    """How many vehicles have so many pairs."""
    return F.round((F.lit(1.0) + F.sqrt(pairs * 8.0 + 1.0)) / 2.0).cast("int")


def with_vehicle_type(vehicles: DataFrame, types: DataFrame, most_broadcast: int = 10_000, block: int = 1 << 20) -> DataFrame:
    """Vehicle type by id range, ends included; ``types`` is ``type_id, min_id, max_id``.

    Up to ``most_broadcast`` ranges are broadcast; more meet the ids of their own blocks of ids in an equality join.
    """
    within = F.col("vehicle_id").between(F.col("min_id"), F.col("max_id"))
    if types.count() <= most_broadcast:
        return vehicles.join(F.broadcast(types), within, "left")
    of = lambda c: F.floor(F.col(c) / block).cast("long")
    dealt = types.where("min_id <= max_id").withColumn("__block", F.explode(F.sequence(of("min_id"), of("max_id"))))
    return vehicles.withColumn("__own", of("vehicle_id")).join(dealt, (F.col("__own") == F.col("__block")) & within, "left").drop("__own", "__block")


def mapped_values(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fields of a time-series source as metrics: ``bucket, measurement, key, value`` to ``metric, value, fill_mode``.

    ``special`` mappings replace their source value; ``as-is`` ones keep the value.
    """
    joined = raw.join(mapping, ["bucket", "measurement", "key"])  # a small mapping is broadcast by its size
    value = F.when((F.col("value_mode") == "special") & (F.col("value") == F.col("source_value")), F.col("mapped_value")).otherwise(F.col("value"))
    return joined.select(*(c for c in raw.columns if c not in ("bucket", "measurement", "key", "value")), F.col("system_key").alias("metric"), value.alias("value"), "fill_mode")


def rebalanced(weights: DataFrame) -> DataFrame:
    """``set_id, place, weight`` after one weight of each set was set to ``value`` (null in the other rows).

    What is left of 100 goes to the other places in proportion to their weights (evenly without any), in steps of
    5; the last of them takes what the steps leave.  No weight is below 0: where rounding up has used the rest before,
    the last has none.  Sets without a value stay as they are.  One shuffle by set.
    """
    whole = Window.partitionBy("set_id")
    so_far = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    other = F.col("value").isNull()
    value = F.max("value").over(whole)
    rest = F.when(value.isNotNull(), F.greatest(F.lit(0), 100 - value))
    total, count = F.sum(F.when(other, F.col("weight"))).over(whole), F.count(F.when(other, 1)).over(whole)
    share = F.when(total > 0, F.col("weight") / total).otherwise(F.lit(1.0) / count)
    rows = weights.withColumns({"__rest": rest, "__last": other & (F.col("place") == F.max(F.when(other, F.col("place"))).over(whole))})
    rows = rows.withColumn("__part", F.when(other, F.greatest(F.lit(0), F.floor(share * F.col("__rest") / 5 + 0.5) * 5)))
    left = F.greatest(F.lit(0), F.col("__rest") - F.coalesce(F.sum("__part").over(so_far), F.lit(0)))
    weight = F.when(F.col("__rest").isNull(), F.col("weight")).when(~other, F.col("value")).when(F.col("__last"), left).otherwise(F.col("__part"))
    return rows.select("set_id", "place", weight.alias("weight"))


def route_bank(routes: DataFrame, family: str = "all", arena: str = "all", vehicle_type: str = "all") -> DataFrame:
    for column, wanted in (("family", family), ("arena", arena), ("vehicle_type", vehicle_type)):
        if wanted != "all":
            routes = routes.where(F.col(column) == wanted)
    return routes


def ground_truth(judged: DataFrame) -> DataFrame:
    """Two labels, sync and route, of each judged group (``group_id, judged, sync, route``)."""
    layers = F.array(F.struct(F.lit("sync").alias("layer"), F.col("sync").alias("score")), F.struct(F.lit("route").alias("layer"), F.col("route").alias("score")))
    return judged.withColumn("x", F.explode(layers)).select("group_id", quality_bucket(F.col("judged")).alias("quality"), "x.layer", "x.score")


def quality_bucket(score: Column, good: float = 80.0, low: float = 50.0) -> Column:
    return F.when(score >= good, "good").when(score < low, "low").when(score.isNotNull(), "medium")


def latest_states(log: DataFrame) -> DataFrame:
    """The newest revision of each workspace of an append-only log (``workspace_id, revision, state``)."""
    return log.groupBy("workspace_id").agg(F.max("revision").alias("revision"), F.max_by("state", "revision").alias("state"))


def newest_audit(audit: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` entries; entries of one time are told by id."""
    return audit.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def accepted_writes(writes: DataFrame, log: DataFrame) -> DataFrame:
    """Writes as rows for the log: revisions follow the workspace's newest one in the order of arrival.

    Ids that do not match and states over the limit are left out; audit fields are cut to their limits.
    """
    fine = writes.where(F.col("workspace_id").rlike(WORKSPACE_ID) & (F.char_length("state") <= MOST_STATE_CHARS))
    now = log.groupBy("workspace_id").agg(F.max("revision").alias("base"))
    order = Window.partitionBy("workspace_id").orderBy("arrival")
    rows = fine.withColumn("place", F.row_number().over(order)).join(now, "workspace_id", "left")
    cut = [F.left(F.col(c), F.lit(n)).alias(c) for c, n in AUDIT_LIMITS.items() if c in writes.columns]
    return rows.select("workspace_id", (F.coalesce("base", F.lit(0)) + F.col("place")).alias("revision"), "state", "arrival", *cut)


def accepted_notes(notes: DataFrame) -> DataFrame:
    """Notes with a title left after trimming."""
    return notes.withColumn("title", F.trim("title")).where("title <> ''")


def newest_notes(notes: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` accepted notes; notes of one time are told by id."""
    return accepted_notes(notes).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def valid_range(start: Column, end: Column) -> Column:
    """Whether a range has both ends and begins before it ends."""
    return F.coalesce(start < end, F.lit(False))


def selected_servers(wanted: DataFrame, servers: DataFrame) -> DataFrame:
    """Adds ``server_id`` to rows with ``wanted``: that server where it is enabled, else the first enabled one.

    Without any enabled server it is null.  ``servers`` has ``server_id, enabled``.
    """
    enabled = servers.where("enabled").select("server_id").distinct()
    first = enabled.agg(F.min("server_id").alias("__first"))  # one row
    found = wanted.join(enabled, F.col("wanted") == F.col("server_id"), "left").crossJoin(F.broadcast(first))
    return found.withColumn("server_id", F.coalesce("server_id", "__first")).drop("__first")


def alert_summary(cards: DataFrame, key: list[str], alert: Column, unread: Column) -> DataFrame:
    """The first group (by ``group_id``) with an alert and the number of its unread alerts, for each key."""
    return cards.groupBy(*key).agg(F.min(F.when(alert, F.col("group_id"))).alias("first_alert"), F.count_if(alert & unread).alias("unread"))


def hydrated(stored: Column, defaults: Column) -> Column:
    """A stored map over the defaults, key by key."""
    kept = F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(stored, k), F.lit(False)))
    return F.coalesce(F.map_concat(kept, stored), defaults)


def chosen_templates(groups: DataFrame, overrides: DataFrame, at: Column) -> DataFrame:
    """Template of each group: its override where it is in effect at a time, else its default."""
    active = overrides.where(F.col("effective_from") <= at).groupBy("server_id", "group_id").agg(F.max_by("template_id", "effective_from").alias("override"))
    return groups.join(active, ["server_id", "group_id"], "left").withColumn("template_id", F.coalesce("override", "default_template_id")).drop("override")
