"""Queries on events, workspaces, templates as text, and the spec-derived ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.operators import events as E
from wayring.operators import workspace as W
from wayring.plans.registry import query, rounded, rounded_sql
from wayring.session import shared_folder
from wayring.plans.scoring import GROUPS_SQL, SCORES_SQL, _groups, _scored
from wayring.functions.scoring import REASONS
from wayring.sources import snapshot
from wayring.sources.fixtures import investigation_events, lifecycle_samples

EVENTS_SQL = "ev AS (SELECT o_orderkey AS event_id, o_custkey % 3 + 1 AS server_id, CASE WHEN o_orderkey % 2 = 1 THEN 'so' ELSE 'si' END AS family, o_orderdate AS start, o_orderkey % 50 + 10 AS duration_min, least(100.0, round(o_totalprice / 5000.0::DOUBLE, 0)) AS score FROM orders)"


@query(f"WITH {EVENTS_SQL} SELECT server_id, family, sum(duration_min)::BIGINT AS minutes, floor(sum(score * duration_min) / sum(duration_min) + 0.5)::BIGINT AS weighted_score FROM ev GROUP BY ALL")
def duration_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = investigation_events(spark, sf_dir)
    return e.groupBy("server_id", "family").agg(F.sum("duration_min").alias("minutes"), E.weighted_score(F.col("score"), F.col("duration_min")).alias("weighted_score"))


@query(f"WITH {EVENTS_SQL} SELECT server_id, arg_min(event_id, (-score, event_id)) AS event_id, max(score) AS score FROM ev GROUP BY server_id")
def best_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest score of each server, the first id among equals; a partial maximum, no sort."""
    return investigation_events(spark, sf_dir).groupBy("server_id").agg(F.max_by("event_id", F.struct("score", -F.col("event_id"))).alias("event_id"), F.max("score").alias("score"))


@query(f"WITH {EVENTS_SQL} SELECT server_id, family, CASE WHEN score >= 80 THEN 'good' WHEN score < 50 THEN 'low' ELSE 'medium' END AS quality, count(*) AS events FROM ev GROUP BY ALL")
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigation_events(spark, sf_dir).groupBy("server_id", "family", W.quality_bucket(F.col("score")).alias("quality")).agg(F.count("*").alias("events"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, duration_min, score FROM ev WHERE family = 'si' AND start >= TIMESTAMP '1996-01-01' AND start < TIMESTAMP '1996-04-01' AND server_id = 2")
def events_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = investigation_events(spark, sf_dir)
    return e.where("family = 'si' and start >= timestamp '1996-01-01' and start < timestamp '1996-04-01' and server_id = 2").select("event_id", "duration_min", "score")


_OWN_LOSS = " UNION ALL ".join(f"SELECT '{r}' AS reason, loss_{r} AS loss FROM s WHERE valid AND primary_reason = '{r}'" for r in REASONS)


@query(f"{SCORES_SQL}, ls AS ({_OWN_LOSS}), rc AS (SELECT reason, count(*) AS vehicles, avg(loss) AS impact, 100.0 * count(*) / (SELECT count(*) FROM s WHERE valid) AS share FROM ls GROUP BY 1) SELECT reason, vehicles, {rounded_sql('share', 3)} AS share_pct, {rounded_sql('impact', 3)} AS impact, {rounded_sql('share * impact / 100.0', 3)} AS contribution FROM rc")
def root_cause_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.root_causes(_scored(spark, sf_dir))
    return c.select("reason", "vehicles", *(rounded(x, 3).alias(x) for x in ("share_pct", "impact", "contribution"))).orderBy(F.col("contribution").desc(), "reason")


_TEMPLATES_SQL = f"""tp AS (SELECT o_orderkey AS template_id, CASE WHEN o_orderkey % 2 = 1 THEN 'SO' ELSE 'SI' END AS family, o_orderstatus AS mix, concat_ws('{W.SEPARATOR}', o_orderstatus, o_orderpriority, 'x' || (o_custkey % 4)::VARCHAR) AS constellation, [o_orderkey % 3, o_custkey % 3] AS vals, o_orderdate AS made FROM orders),
tk AS (SELECT *, concat_ws('|', family, mix, least(constellation, array_to_string(list_reverse(string_split(constellation, '{W.SEPARATOR}')), '{W.SEPARATOR}')),
  CASE WHEN family = 'SI' THEN array_to_string(vals, ',') ELSE least(array_to_string(vals, ','), array_to_string(list_reverse(vals), ',')) END) AS key FROM tp)"""


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = o.select(
        F.col("o_orderkey").alias("template_id"), F.when(F.col("o_orderkey") % 2 == 1, "SO").otherwise("SI").alias("family"), F.col("o_orderstatus").alias("mix"),
        F.concat_ws(W.SEPARATOR, "o_orderstatus", "o_orderpriority", F.concat(F.lit("x"), (F.col("o_custkey") % 4).cast("string"))).alias("constellation"), F.array(F.col("o_orderkey") % 3, F.col("o_custkey") % 3).alias("vals"), F.col("o_orderdate").alias("made"),
    )
    return t.withColumn("key", W.canonical_key(F.col("family"), F.col("mix"), F.col("constellation"), F.col("vals")))


@query(f"WITH {_TEMPLATES_SQL} SELECT template_id, key FROM tk")
def canonical_template_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir).select("template_id", "key")


@query(f"WITH {_TEMPLATES_SQL} SELECT template_id, key FROM tk WHERE made >= DATE '1995-02-01' AND key NOT IN (SELECT key FROM tk WHERE made < DATE '1995-02-01')")
def duplicate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates since a date that none from before it equals."""
    t = _templates(spark, sf_dir)
    return W.new_templates(t.where("made >= DATE '1995-02-01'"), t.where("made < DATE '1995-02-01'")).select("template_id", "key")


@query(f"WITH {_TEMPLATES_SQL} SELECT t.template_id, f.first_id, t.key FROM tk t JOIN (SELECT key, min(template_id) AS first_id FROM tk GROUP BY key) f ON t.key = f.key WHERE t.template_id > f.first_id")
def duplicate_templates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that one of a smaller id equals, over all orders."""
    return W.duplicates_of_first(_templates(spark, sf_dir)).select("template_id", "first_id", "key")


@query("WITH g AS (SELECT l_orderkey AS group_id, least(count(*), 5)::INTEGER AS n FROM lineitem GROUP BY 1) SELECT group_id, i AS first, j AS second, 90 AS angle FROM g, range(5) a(i), range(5) b(j) WHERE i < j AND j < n")
@query("WITH g AS (SELECT l_orderkey AS group_id, least(count(*), 5)::INTEGER AS n FROM lineitem GROUP BY 1) SELECT group_id, i AS first, j AS second, 90 AS angle FROM g, range(5) a(i), range(5) b(j) WHERE i < j AND j < n", name="pair_enumeration")
def pair_enumeration_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the first five places of every group, as the template editor lists them."""
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.count("*").cast("int").alias("n"))
    return W.vehicle_pairs(W.first_places(g)).select("group_id", F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second"), "angle")


@query("SELECT s_suppkey AS vehicle_id, s_suppkey * 37 % 500 AS number, CASE WHEN s_suppkey * 37 % 500 BETWEEN 100 AND 199 THEN 'storm' WHEN s_suppkey * 37 % 500 BETWEEN 200 AND 299 THEN 'lightning' WHEN s_suppkey * 37 % 500 BETWEEN 300 AND 399 THEN 'thunder' END AS type_id FROM supplier")
def vehicle_type_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") * 37 % 500).alias("vehicle_id"))
    types = spark.createDataFrame([("storm", 100, 199), ("lightning", 200, 299), ("thunder", 300, 399)], "type_id string, min_id long, max_id long")
    return W.with_vehicle_type(s, types).select(F.col("key").alias("vehicle_id"), F.col("vehicle_id").alias("number"), "type_id")


@query(f"WITH {EVENTS_SQL}, ed AS (SELECT event_id, 'note ' || event_id::VARCHAR AS note, CASE WHEN event_id % 14 = 0 THEN 'manual' END AS t FROM ev WHERE event_id % 7 = 0) SELECT event_id, coalesce(ed.note, '') AS note, coalesce(ed.t, 'auto-' || family) AS template_id FROM ev LEFT JOIN ed USING (event_id)")
def event_edits_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = investigation_events(spark, sf_dir).withColumn("template_id", F.concat(F.lit("auto-"), "family"))
    edits = e.where("event_id % 7 = 0").select("event_id", F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"), F.when(F.col("event_id") % 14 == 0, "manual").alias("template_id"))
    return E.overlaid(e, edits).select("event_id", "note", "template_id")


@query("SELECT o_custkey AS workspace_id, max(rev) AS revision, arg_max(o_orderkey, rev) AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rev FROM orders) GROUP BY 1")
def workspace_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("workspace_id"), F.col("o_orderkey").cast("string").alias("state"), F.col("o_orderkey").alias("arrival"))
    empty = spark.createDataFrame([], "workspace_id string, revision long")
    log = W.accepted_writes(o, empty)
    latest = W.latest_states(log)
    return latest.select(F.expr("cast(substring(workspace_id, 2) as bigint)").alias("workspace_id"), F.col("revision").cast("long").alias("revision"), F.col("state").cast("long").alias("state"))


@query("SELECT event_id AS id, ts AS created_at, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("action"))
    return W.newest_audit(a)


@query(f"WITH {EVENTS_SQL}, c AS (SELECT family AS category, count(*) AS scenarios, count(*) FILTER (score >= 50) AS passed FROM ev GROUP BY 1) SELECT category, scenarios, passed, {rounded_sql('passed / scenarios')} AS pass_ratio FROM (SELECT * FROM c UNION ALL SELECT 'total', sum(scenarios)::BIGINT, sum(passed)::BIGINT FROM c)")
def qa_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = investigation_events(spark, sf_dir).rollup("family").agg(F.count("*").alias("scenarios"), F.count_if(F.col("score") >= 50).alias("passed"))
    return r.select(F.coalesce("family", F.lit("total")).alias("category"), "scenarios", "passed", rounded(F.col("passed") / F.col("scenarios")).alias("pass_ratio"))


@query("SELECT s_suppkey AS route_id, 'arena-' || (s_nationkey % 3)::VARCHAR AS arena FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey % 3 = 1")
def route_bank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    routes = s.select(F.col("s_suppkey").alias("route_id"), F.when(F.col("s_suppkey") % 3 == 0, "SO").otherwise("SI").alias("family"), F.concat(F.lit("arena-"), (F.col("s_nationkey") % 3).cast("string")).alias("arena"), F.lit("storm").alias("vehicle_type"))
    return W.route_bank(routes, family="SO", arena="arena-1").select("route_id", "arena")


@query(f"{GROUPS_SQL} SELECT group_id, layer, CASE WHEN total >= 80 THEN 'good' WHEN total < 50 THEN 'low' ELSE 'medium' END AS quality, {rounded_sql('score', 3, 1.3e-5)} AS score FROM (SELECT group_id, total, 'sync' AS layer, sync AS score FROM gs WHERE valid UNION ALL SELECT group_id, total, 'route', route FROM gs WHERE valid)")
def ground_truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir).where("valid").withColumnRenamed("total", "judged")
    return W.ground_truth(g).select("group_id", "layer", "quality", rounded("score", 3, 1.3e-5).alias("score"))


@query("SELECT n, k AS pattern, len(p) AS pairs, p[1] AS first_angle, p[len(p)] AS last_angle FROM (SELECT n, k, list_transform(range((n * (n - 1) / 2)::INTEGER), lambda i: CASE k WHEN 0 THEN 45 WHEN 1 THEN 90 WHEN 2 THEN 120 WHEN 3 THEN [45, 90, 120][i % 3 + 1] ELSE [45, 90, 120][(i + 1) % 3 + 1] END) AS p FROM range(2, 6) a(n), range(5) b(k))")
def si_angle_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, 8).select(F.col("id").alias("n"))
    s = n.select("n", F.posexplode(W.angle_sets(F.col("n"))).alias("pattern", "p"))
    return s.select("n", F.col("pattern").cast("long").alias("pattern"), F.size("p").cast("long").alias("pairs"), F.get("p", F.lit(0)).alias("first_angle"), F.element_at("p", -1).alias("last_angle"))


_SERIES_SQL = "SELECT i, floor(greatest(0.0, least(100.0, 86.0 + sin(i / 7.0::DOUBLE + 2.0) * 4.0 - CASE WHEN i > 55.2 AND i < 79.2 THEN 10.0 ELSE 0.0 END)) + 0.5)::BIGINT AS sync, floor(greatest(0.0, least(100.0, 80.0 + sin(i / 11.0::DOUBLE + 1.0) * 4.0)) + 0.5)::BIGINT AS route FROM range(120) t(i)"


@query(_SERIES_SQL)
def score_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A demonstration series: a sinusoid with an incident, cut to 0..100 and rounded."""
    i = F.col("id")
    cut = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)) + 0.5).cast("long")
    incident = F.when((i > 120 * 0.46) & (i < 120 * 0.66), 10.0).otherwise(0.0)
    return spark.range(120).select(i.alias("i"), cut(F.sin(i / F.lit(7.0) + 2.0) * 4.0 + 86.0 - incident).alias("sync"), cut(F.sin(i / F.lit(11.0) + 1.0) * 4.0 + 80.0).alias("route"))


_CARDS = f"{GROUPS_SQL} SELECT group_id, total < 50 AS alert, {rounded_sql('total', 3, 1.3e-5)} AS total FROM gs WHERE valid ORDER BY (total < 50) DESC, {rounded_sql('total', 3, 1.3e-5)}, group_id"


@query(_CARDS)
def card_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir).where("valid")
    return g.select("group_id", (F.col("total") < 50).alias("alert"), rounded("total", 3, 1.3e-5).alias("total")).orderBy(F.col("alert").desc(), "total", "group_id")


@query(
    """WITH w AS (SELECT l_orderkey AS set_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_quantity::DOUBLE AS weight FROM lineitem),
s AS (SELECT *, place = 1 AS fixed, (set_id % 101)::DOUBLE AS value, sum(CASE WHEN place > 1 THEN weight END) OVER (PARTITION BY set_id) AS others, max(place) OVER (PARTITION BY set_id) AS last FROM w),
p AS (SELECT *, CASE WHEN fixed THEN value ELSE floor(weight / others * (100 - value) / 5 + 0.5) * 5 END AS part FROM s)
SELECT set_id, place, (CASE WHEN NOT fixed AND place = last THEN greatest(0, 100 - value - coalesce(sum(CASE WHEN NOT fixed THEN part END) OVER (PARTITION BY set_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) ELSE part END)::BIGINT AS weight FROM p"""
)
def weight_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first weight of each order is set, the others share the rest."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    w = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("set_id"), F.row_number().over(order).cast("long").alias("place"), F.col("l_quantity").cast("double").alias("weight"))
    changed = w.withColumn("value", F.when(F.col("place") == 1, F.col("set_id") % 101))
    return W.rebalanced(changed).select("set_id", "place", F.col("weight").cast("long").alias("weight"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'override-' || (event_id % 2)::VARCHAR ELSE 'default-' || family END AS template_id FROM ev")
def template_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = investigation_events(spark, sf_dir)
    g = e.select("server_id", F.col("event_id").alias("group_id"), F.concat(F.lit("default-"), "family").alias("default_template_id"))
    at = F.lit("2030-01-01").cast("timestamp")
    o = e.where("event_id % 5 = 0").select("server_id", F.col("event_id").alias("group_id"), F.concat(F.lit("override-"), (F.col("event_id") % 2).cast("string")).alias("template_id"), F.col("start").alias("effective_from"))
    later = o.withColumns({"template_id": F.lit("too late"), "effective_from": F.lit("2031-01-01").cast("timestamp")})
    return W.chosen_templates(g, o.unionByName(later), at).select(F.col("group_id").alias("event_id"), "template_id")


# --- spec-derived -----------------------------------------------------------------------------------------------

_SECONDS_SQL = "sec AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second, least(100.0, value * 4.0::DOUBLE) AS score, ts, event_id FROM events)"


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("k"), F.row_number().over(order).cast("long").alias("second"), F.least(F.lit(100.0), F.col("value") * 4.0).alias("score"))


@query(f"WITH {_SECONDS_SQL} SELECT k, second, {rounded_sql('avg(score) OVER (PARTITION BY k ORDER BY second RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)', 3)} AS smoothed FROM sec")
def score_smoothing_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seconds(spark, sf_dir).withColumn("time", F.timestamp_seconds("second"))
    return E.smoothed(s, ["k"], "time", "score").select("k", "second", rounded("smoothed", 3).alias("smoothed"))


_ALERT = 3


@query(
    f"""WITH {_SECONDS_SQL}, a AS (SELECT *, second - coalesce(max(CASE WHEN score >= 50 THEN second END) OVER w, 0) AS low_for, second - coalesce(max(CASE WHEN score < 60 THEN second END) OVER w, 0) AS fine_for FROM sec WINDOW w AS (PARTITION BY k ORDER BY second ROWS UNBOUNDED PRECEDING)),
m AS (SELECT k, second, CASE WHEN low_for >= {_ALERT} THEN 'open' WHEN fine_for >= {_ALERT - 1} THEN 'close' END AS mark FROM a),
e AS (SELECT *, lag(mark) OVER (PARTITION BY k ORDER BY second) AS was FROM m WHERE mark IS NOT NULL),
f AS (SELECT *, lead(second) OVER (PARTITION BY k ORDER BY second) AS closed_at FROM e WHERE (was IS NULL AND mark = 'open') OR was <> mark) SELECT k, second AS opened_at, closed_at FROM f WHERE mark = 'open'"""
)
def alert_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from wayring.config import Scoring

    cfg = replace(Scoring(), alert_open_seconds=_ALERT, alert_recovery_seconds=_ALERT - 1)
    return E.alert_intervals(_seconds(spark, sf_dir), ["k"], "second", "score", cfg)


@query("WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 129600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS event FROM s) SELECT user_id AS vehicle_identifier, event::BIGINT AS event, min(ts) AS start_time, max(ts) AS end_time, count(*) AS rows FROM n GROUP BY 1, 2")
def membership_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.membership_events(lifecycle_samples(spark, sf_dir), ["vehicle_identifier"], "sample_time", 129_600)


_VERSIONS_SQL = "v AS (SELECT l_orderkey AS event_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS version, l_quantity AS mean_score, (l_discount * 600)::DOUBLE AS start_s, (l_tax * 600 + 1000)::DOUBLE AS end_s FROM lineitem)"


@query(f"WITH {_VERSIONS_SQL}, c AS (SELECT *, lag(version) OVER w IS NULL OR round(abs(mean_score - lag(mean_score) OVER w), 6) >= 5 OR round(abs(start_s - lag(start_s) OVER w), 6) >= 30 OR round(abs(end_s - lag(end_s) OVER w), 6) >= 30 AS shown FROM v WINDOW w AS (PARTITION BY event_id ORDER BY version)) SELECT event_id, version FROM c WHERE shown")
def event_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("event_id"), F.row_number().over(order).cast("long").alias("version"), F.col("l_quantity").alias("mean_score"), F.round(F.col("l_discount") * 600, 6).alias("start_s"), F.round(F.col("l_tax") * 600 + 1000, 6).alias("end_s")
    )
    return E.visible_revisions(v).select("event_id", "version")


@query(
    """WITH RECURSIVE rt AS (SELECT s_nationkey AS server_id, s_suppkey AS id, (s_suppkey % 10 * 37)::DOUBLE AS x, (s_suppkey % 7 * 41)::DOUBLE AS y, (60 + 15 * (s_suppkey % 7))::DOUBLE AS size, (90 + 15 * (s_suppkey % 5))::DOUBLE AS p, s_suppkey % 2 AS d FROM supplier),
lk AS (SELECT a.id AS a, b.id AS b FROM rt a JOIN rt b ON a.server_id = b.server_id AND a.d = b.d AND a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= greatest(a.size, b.size) * 0.3 AND abs(a.p - b.p) <= greatest(a.p, b.p) * 0.2),
w AS (SELECT id AS node, id AS label FROM rt UNION SELECT lk.b, w.label FROM w JOIN lk ON w.node = lk.a) SELECT node, min(label) AS label FROM w GROUP BY node"""
)
def group_formation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_nationkey").alias("server_id"), k.alias("route_id"), (k % 10 * 37).cast("double").alias("x"), (k % 7 * 41).cast("double").alias("y"), (k % 7 * 15 + 60).cast("double").alias("size_m"), (k % 5 * 15 + 90).cast("double").alias("period_s"), (k % 2).alias("direction")
    )
    shared_folder(spark)  # components are checkpointed there
    return E.connected(r.select(F.col("route_id").alias("node")), E.si_neighbours(r))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at, 'note ' || o_orderkey AS title FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty notes, as the notes table lists them; every third has a blank title."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    title = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" note "), F.col("o_orderkey").cast("string"), F.lit(" ")))
    return W.newest_notes(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), title.alias("title")))


@query(f"WITH {EVENTS_SQL} SELECT event_id, coalesce(start < TIMESTAMP '1995-06-17 00:00:00', false) AS valid FROM ev")
def range_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit("1995-06-17 00:00:00").cast("timestamp_ntz")
    return investigation_events(spark, sf_dir).select("event_id", W.valid_range(F.col("start").cast("timestamp_ntz"), end).alias("valid"))


@query("SELECT c_custkey AS key, coalesce(n_nationkey, (SELECT min(n_nationkey) FROM nation WHERE n_nationkey % 3 <> 0)) AS server_id FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n ON c_nationkey = n_nationkey")
def selected_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server that each customer wants, or the first enabled one."""
    servers = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("server_id"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("wanted"))
    return W.selected_servers(wanted, servers).select("key", "server_id")


@query(f"WITH {EVENTS_SQL} SELECT server_id, min(CASE WHEN score < 50 THEN event_id END) AS first_alert, sum((score < 50 AND event_id % 4 = 1)::INTEGER)::BIGINT AS unread FROM ev GROUP BY ALL")
def first_alert_and_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = investigation_events(spark, sf_dir).withColumnRenamed("event_id", "group_id")
    return W.alert_summary(cards, ["server_id"], F.col("score") < 50, F.col("group_id") % 4 == 1)


@query(f"WITH {EVENTS_SQL}, e AS (SELECT event_id, start + to_minutes(duration_min) AS ends FROM ev) SELECT event_id, ends + INTERVAL 120 SECOND <= (SELECT max(ends) FROM e) AS final FROM e")
def finalised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = investigation_events(spark, sf_dir).select("event_id", F.expr("start + make_dt_interval(0, 0, cast(duration_min AS int))").alias("ends"))
    newest = e.agg(F.max("ends").alias("newest"))  # one row
    return e.crossJoin(F.broadcast(newest)).select("event_id", E.finalised(F.col("ends"), F.col("newest")).alias("final"))


_SO_SQL = "so AS (SELECT s_nationkey % 3 AS server_id, s_suppkey AS route_id, (s_suppkey * 37 % 2000)::DOUBLE AS x0, (s_suppkey * 53 % 2000)::DOUBLE AS y0, (s_suppkey * 37 % 2000 + 60 + s_suppkey % 5 * 20)::DOUBLE AS x1, (60 + s_suppkey % 5 * 20)::DOUBLE AS leg_m, (90 + s_suppkey % 6 * 15)::DOUBLE AS period_s FROM supplier)"


@query(
    f"""WITH {_SO_SQL}, e AS (SELECT server_id, route_id, x0 AS x, y0 AS y, leg_m, period_s FROM so UNION ALL SELECT server_id, route_id, x1, y0, leg_m, period_s FROM so)
SELECT DISTINCT a.route_id AS a, b.route_id AS b FROM e a JOIN e b ON a.server_id = b.server_id AND a.route_id < b.route_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= greatest(a.leg_m, b.leg_m) AND abs(a.period_s - b.period_s) <= greatest(a.period_s, b.period_s) * 0.2::DOUBLE"""
)
def so_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stadiums of three servers whose ends lie near each other."""
    k = F.col("s_suppkey")
    x, y, leg = (k * 37 % 2000).cast("double"), (k * 53 % 2000).cast("double"), (k % 5 * 20 + 60).cast("double")
    ends = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + leg).alias("x"), y.alias("y")))
    routes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_nationkey") % 3).alias("server_id"), k.alias("route_id"), ends.alias("ends"), leg.alias("leg_m"), (k % 6 * 15 + 90).cast("double").alias("period_s"))
    return E.so_neighbours(routes)


@query("SELECT l_orderkey AS group_id, sum((l_discount >= 0.06::DOUBLE)::INTEGER)::BIGINT AS reliable FROM lineitem GROUP BY l_orderkey HAVING sum((l_discount >= 0.06::DOUBLE)::INTEGER) >= 2")
def reliable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("group_id"), F.col("l_discount").alias("reliability"))
    return E.reliable_groups(members, 0.06)


@query("SELECT user_id AS vehicle_identifier, ts AS sample_time, event_type <> 'error' AS active, CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS reliability FROM events")
def sample_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to JSON lines and back; every fifth comes without its reliability."""
    s = lifecycle_samples(spark, sf_dir)
    lines = snapshot.json_lines(s.withColumn("reliability", F.when(F.col("event_id") % 5 != 0, 0.5)).drop("event_id"))
    return snapshot.from_json_lines(lines).select("vehicle_identifier", F.col("sample_time").cast(s.schema["sample_time"].dataType).alias("sample_time"), "active", "reliability")
