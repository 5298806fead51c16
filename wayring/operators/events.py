"""Events and what is told about them: smoothing, alerts, membership, revisions, root causes, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayring.config import Grouping, Scoring
from wayring.functions.geo import angle_error_deg
from wayring.functions.scoring import REASONS
from wayring.operators.groups import components


def weighted_score(score: Column, minutes: Column) -> Column:
    """Duration-weighted mean, halves rounded up."""
    return F.floor(F.sum(score * minutes) / F.nullif(F.sum(minutes), F.lit(0)) + 0.5).cast("long")


def overlaid(events: DataFrame, edits: DataFrame) -> DataFrame:
    """Events with note and template of their edits; the edits stay a layer of their own."""
    e = edits.select("event_id", F.col("note").alias("edit_note"), F.col("template_id").alias("edit_template"))
    return events.join(e, "event_id", "left").withColumns({"note": F.coalesce("edit_note", F.lit("")), "template_id": F.coalesce("edit_template", "template_id")}).drop("edit_note", "edit_template")


def root_causes(scored: DataFrame) -> DataFrame:
    """Share of the valid vehicles, mean loss and contribution of each primary reason.

    One partial aggregation by reason; the total is a window over its few rows.
    """
    by = scored.where("valid").groupBy(F.col("primary_reason").alias("reason")).agg(F.count("*").alias("vehicles"), F.avg("primary_loss").alias("impact"))
    c = by.withColumn("share_pct", F.col("vehicles") * 100.0 / F.sum("vehicles").over(Window.partitionBy())).where(F.col("reason").isin(*REASONS))
    return c.select("reason", "vehicles", "share_pct", "impact", (F.col("share_pct") * F.col("impact") / 100.0).alias("contribution"))


def smoothed(scores: DataFrame, key: list[str], time: str, score: str, seconds: int = Scoring().smoothing_seconds) -> DataFrame:
    """Mean over the last seconds, the present one included."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return scores.withColumn("smoothed", F.avg(score).over(w))


def alert_intervals(scores: DataFrame, key: list[str], second: str, score: str, cfg: Scoring = Scoring()) -> DataFrame:
    """Alerts with hysteresis: opened after a run of low scores, closed after a run of recovered ones.

    Null scores are neither: they leave runs as they are, and no alert opens or closes at them.
    A low run is consecutive rows under ``low_below`` for ``alert_open_seconds``, a recovery run rows from
    ``alert_recovery_score`` on for ``alert_recovery_seconds``.  Runs and their ends come from windows; the
    first recovery after an opening closes it, and openings before that belong to the same alert.
    """
    w = Window.partitionBy(*key).orderBy(second)
    s = scores.withColumns({"low": F.col(score) < cfg.low_below, "fine": F.col(score) >= cfg.alert_recovery_score})
    for name in ("low", "fine"):
        s = s.withColumn(f"{name}_start", F.max(F.when(~F.col(name), F.col(second))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(second).over(Window.partitionBy(*key))
    s = s.withColumns({f"{n}_for": F.when(F.col(n), F.col(second) - F.coalesce(F.col(f"{n}_start"), start - 1)) for n in ("low", "fine")})
    marks = s.withColumn("mark", F.when(F.col("low_for") >= cfg.alert_open_seconds, "open").when(F.col("fine_for") >= cfg.alert_recovery_seconds, "close")).where("mark is not null")
    edges = marks.withColumn("was", F.lag("mark").over(w)).where("was is null and mark = 'open' or was <> mark")
    out = edges.withColumn("closed_at", F.lead(second).over(w)).where("mark = 'open'")
    return out.select(*key, F.col(second).alias("opened_at"), "closed_at")


def membership_events(rows: DataFrame, key: list[str], time: str, gap_seconds: int) -> DataFrame:
    """Unbroken intervals of presence: rows of a key no more than ``gap_seconds`` apart."""
    w = Window.partitionBy(*key).orderBy(time)
    fresh = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(F.col(time).cast("timestamp")).over(w)) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    numbered = rows.withColumn("fresh", fresh).withColumn("event", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "event").agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count("*").alias("rows"))


def finalised(end: Column, observed_until: Column, seconds: int = Grouping().finalize_seconds) -> Column:
    """Whether an event's end lies so far back that it is final; null without an end."""
    return F.unix_micros(end.cast("timestamp")) + seconds * 1_000_000 <= F.unix_micros(observed_until.cast("timestamp"))


def visible_revisions(versions: DataFrame, score_points: float = 5.0, boundary_seconds: float = 30.0) -> DataFrame:
    """Versions of events that become visible: the first, and each that moves the mean or a boundary enough.

    ``versions`` has ``event_id, version, mean_score, start_s, end_s``; each is compared with the one before it.
    """
    w = Window.partitionBy("event_id").orderBy("version")
    moved = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    changed = (moved("mean_score") >= score_points) | (moved("start_s") >= boundary_seconds) | (moved("end_s") >= boundary_seconds)
    v = versions.withColumn("shown", F.coalesce(changed, F.lag("version").over(w).isNull())).where("shown")
    return v.drop("shown")


def si_neighbours(routes: DataFrame, cfg: Grouping = Grouping()) -> DataFrame:
    """Links (a, b) of SI routes that may form a group: near centres, like periods, one direction.

    ``routes`` has ``server_id, route_id, x, y, size_m, period_s, direction``.  Centres are put into square cells
    of the largest allowed distance per server, so each route meets only those of its own and the next cells.
    """
    reach = routes.groupBy("server_id").agg((F.max("size_m") * cfg.si_center_ratio).alias("cell"))
    r = routes.join(reach, "server_id").withColumns({"gx": F.floor(F.col("x") / F.col("cell")), "gy": F.floor(F.col("y") / F.col("cell"))})
    a = r.withColumn("cx", F.explode(F.array(*(F.col("gx") + d for d in (-1, 0, 1))))).withColumn("cy", F.explode(F.array(*(F.col("gy") + d for d in (-1, 0, 1)))))
    a = a.select("server_id", "direction", F.col("cx").alias("gx"), F.col("cy").alias("gy"), *(F.col(c).alias(f"a_{c}") for c in ("route_id", "x", "y", "size_m", "period_s")))
    j = a.join(r, ["server_id", "direction", "gx", "gy"]).where("a_route_id < route_id")
    near = F.hypot(F.col("x") - F.col("a_x"), F.col("y") - F.col("a_y")) <= F.greatest("size_m", "a_size_m") * cfg.si_center_ratio
    alike = F.abs(F.col("period_s") - F.col("a_period_s")) <= F.greatest("period_s", "a_period_s") * cfg.si_period_ratio
    return j.where(near & alike).select(F.col("a_route_id").alias("a"), F.col("route_id").alias("b"))


def so_neighbours(routes: DataFrame, cfg: Grouping = Grouping()) -> DataFrame:
    """Links (a, b) of SO routes that may form a group: an end of each within the longer leg, like periods.

    ``routes`` has ``server_id, route_id, ends`` (an array of ``x, y``), ``leg_m, period_s``.  Ends are put into
    square cells of the longest leg of their server, so each meets only those of its own and the next cells.
    """
    reach = routes.groupBy("server_id").agg(F.max("leg_m").alias("cell"))
    columns = ("route_id", "x", "y", "leg_m", "period_s")
    r = routes.join(reach, "server_id").withColumn("end", F.explode("ends"))
    r = r.select("server_id", "route_id", "end.x", "end.y", "leg_m", "period_s", F.floor(F.col("end.x") / F.col("cell")).alias("gx"), F.floor(F.col("end.y") / F.col("cell")).alias("gy"))
    around = F.array(*(F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    a = r.withColumn("at", F.explode(around)).select("server_id", "at.gx", "at.gy", *(F.col(c).alias(f"a_{c}") for c in columns))
    near = F.hypot(F.col("x") - F.col("a_x"), F.col("y") - F.col("a_y")) <= F.greatest("leg_m", "a_leg_m")
    alike = F.abs(F.col("period_s") - F.col("a_period_s")) <= F.greatest("period_s", "a_period_s") * cfg.so_period_ratio
    links = a.join(r, ["server_id", "gx", "gy"]).where("a_route_id < route_id").where(near & alike)
    return links.select(F.col("a_route_id").alias("a"), F.col("route_id").alias("b")).distinct()


def reliable_groups(members: DataFrame, least: float = Scoring().least_reliability) -> DataFrame:
    """``group_id, reliable`` of groups with two reliable members or more; a null reliability is not reliable."""
    return members.groupBy("group_id").agg(F.count_if(F.col("reliability") >= least).alias("reliable")).where("reliable >= 2")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` of every node: the least node that links reach, itself without any."""
    found = components(links.select("a", "b"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def group_identity(before: DataFrame, after: DataFrame, keep: float = Grouping().identity_fraction) -> DataFrame:
    """Group ids across two epochs (``group_id, member``): an id lives on where enough of its members stay together."""
    size = before.groupBy("group_id").agg(F.count("*").alias("size"))
    shared = before.withColumnRenamed("group_id", "old_id").join(after, "member").groupBy("group_id", "old_id").agg(F.count("*").alias("shared"))
    rated = shared.join(size.withColumnRenamed("group_id", "old_id"), "old_id").where(F.col("shared") >= F.col("size") * keep)
    # an id whose members were merged with another surviving group's is not passed on
    return rated.groupBy("group_id").agg(F.count("*").alias("heirs"), F.max("old_id").alias("old_id")).select("group_id", F.when(F.col("heirs") == 1, F.col("old_id")).otherwise(F.col("group_id")).alias("kept_id"))


def hysteresis(rows: DataFrame, key: list[str], second: str, opens: Column, closes: Column, open_seconds: int, close_seconds: int) -> DataFrame:
    """Intervals opened by a condition that held for a time and closed by another one that did.

    Template suggestions (a better template by 30 points for 120 s, closed under 15 points for 30 s) and changes of
    a confirmed route (a fifth of its geometry or period for 120 s) are such intervals.
    """
    w = Window.partitionBy(*key).orderBy(second)
    start = F.min(second).over(Window.partitionBy(*key))
    s = rows.withColumns({"__open": F.coalesce(opens, F.lit(False)), "__close": F.coalesce(closes, F.lit(False))})
    for name in ("__open", "__close"):
        broken = F.max(F.when(~F.col(name), F.col(second))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        s = s.withColumn(f"{name}_for", F.when(F.col(name), F.col(second) - F.coalesce(broken, start - 1)))
    s = s.withColumn("mark", F.when(F.col("__open_for") >= open_seconds, "open").when(F.col("__close_for") >= close_seconds, "close")).where("mark is not null")
    edges = s.withColumn("was", F.lag("mark").over(w)).where("was is null and mark = 'open' or was <> mark")
    out = edges.withColumn("closed_at", F.lead(second).over(w)).where("mark = 'open'")
    return out.select(*key, F.col(second).alias("opened_at"), "closed_at")


def suggestions(advantages: DataFrame, key: list[str], second: str, advantage: str, rejections: DataFrame | None = None, opens: tuple[float, int] = (30.0, 120), closes: tuple[float, int] = (15.0, 30)) -> DataFrame:
    """Intervals in which another template is suggested: better by so many points for so long, until it is hardly better for a while.

    ``rejections`` has the key, ``rejected_at`` and ``event_end``: a rejection ends what is suggested then, and hides what
    would be until the end of the event.
    """
    found = hysteresis(advantages, key, second, F.col(advantage) >= opens[0], F.col(advantage) < closes[0], opens[1], closes[1])
    if rejections is None:
        return found
    r = found.join(rejections.select(*key, "rejected_at", "event_end"), key, "left")
    hidden = (F.col("opened_at") >= F.col("rejected_at")) & (F.col("opened_at") < F.col("event_end"))
    cut = (F.col("opened_at") < F.col("rejected_at")) & (F.coalesce("closed_at", "event_end") > F.col("rejected_at"))
    shown = r.where(~F.coalesce(hidden, F.lit(False))).withColumn("closed_at", F.when(cut, F.col("rejected_at")).otherwise(F.col("closed_at")))
    return shown.groupBy(*key, "opened_at").agg(F.min("closed_at").alias("closed_at"))  # the first of several rejections


def jumps(samples: DataFrame, key: list[str], second: str, x: str, y: str, expected_speed: Column, factor: float = 2.0) -> DataFrame:
    """Samples whose way from the last one needs more than ``factor`` times the expected speed."""
    w = Window.partitionBy(*key).orderBy(second)
    way = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    speed = way / F.nullif(F.col(second) - F.lag(second).over(w), F.lit(0))
    return samples.withColumn("derived_speed", speed).withColumn("jump", F.coalesce(F.col("derived_speed") > expected_speed * factor, F.lit(False)))


def agreement(samples: DataFrame, key: list[str], second: str, x: str, y: str, east: str, north: str, heading_deg: float = 60.0, size_ratio: float = 0.70) -> DataFrame:
    """Adds ``agrees``: whether the reported velocity and the way since the last sample point alike and are about as large.

    The way over its time is the velocity derived from positions; the sizes agree while they differ by at most
    ``size_ratio`` of the larger.  Without a last sample, or where both stand still, they agree.
    """
    w = Window.partitionBy(*key).orderBy(second)
    dt = F.nullif(F.col(second) - F.lag(second).over(w), F.lit(0))
    s = samples.withColumns({"__e": (F.col(x) - F.lag(x).over(w)) / dt, "__n": (F.col(y) - F.lag(y).over(w)) / dt})
    own, derived = F.hypot(east, north), F.hypot("__e", "__n")
    near = F.abs(own - derived) <= F.greatest(own, derived) * size_ratio
    alike = F.coalesce(angle_error_deg(F.col("__e"), F.col("__n"), F.col(east), F.col(north)) <= heading_deg, F.lit(True))
    return s.withColumn("agrees", F.coalesce(near, F.lit(True)) & alike).drop("__e", "__n")


def accepted_runs(samples: DataFrame, key: list[str], second: str, jump: str, seconds: int = Grouping().run_seconds, agrees: str | None = None) -> DataFrame:
    """Adds ``run``, the number of jumps so far, and ``accepted``: a run after a jump counts once it went on for a time without another.

    With ``agrees``, a column that tells consistent samples, the time begins anew after each that is not.
    """
    w = Window.partitionBy(*key).orderBy(second)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = samples.withColumn("run", F.sum(F.coalesce(F.col(jump), F.lit(False)).cast("long")).over(run))
    broken = F.col(jump) if agrees is None else F.col(jump) | ~F.coalesce(F.col(agrees), F.lit(True))
    began = F.max(F.when(broken, F.col(second))).over(run)
    return s.withColumn("accepted", (F.col("run") == 0) | (F.col(second) - began >= seconds))


def resumed_scores(samples: DataFrame, key: list[str], second: str, gap_seconds: int, seconds: int = 10, agrees: str | None = None) -> DataFrame:
    """Adds ``live``: false from the first sample after a gap on until ``seconds`` of consistent samples have passed, once and for all."""
    w = Window.partitionBy(*key).orderBy(second)
    back = F.coalesce(F.col(second) - F.lag(second).over(w) >= gap_seconds, F.lit(False))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.col("__back") if agrees is None else F.col("__back") | ~F.coalesce(F.col(agrees), F.lit(True))
    s = samples.withColumn("__back", back).withColumns({"__gaps": F.sum(F.col("__back").cast("int")).over(run), "__last": F.max(F.when(broken, F.col(second))).over(run)})
    after = Window.partitionBy(*key, "__gaps").orderBy(second).rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("live", (F.col("__gaps") == 0) | F.bool_or(F.col(second) - F.col("__last") >= seconds).over(after)).drop("__back", "__gaps", "__last")


def inner_turns(samples: DataFrame, key: list[str], second: str, heading_deg: str, phase: str, turns: float = 2.0, within: float = 0.10, cleared: float = 0.20) -> DataFrame:
    """Adds ``inner_turn``: so many local turns while the cycle went on by ``within`` at most, until it went on by ``cleared``.

    Heading and phase are unwrapped by running sums of their smallest steps; the window of the last ``within``
    cycles is a range over the unwrapped phase.
    """
    w = Window.partitionBy(*key).orderBy(second)
    step = F.pmod(F.col(heading_deg) - F.lag(heading_deg).over(w) + 180.0, F.lit(360.0)) - 180.0
    ahead = F.abs(F.pmod(F.col(phase) - F.lag(phase).over(w) + 0.5, F.lit(1.0)) - 0.5)
    s = samples.withColumns({"__turn": F.coalesce(step, F.lit(0.0)), "__ahead": F.coalesce(ahead, F.lit(0.0))})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"__heading": F.sum("__turn").over(run), "__progress": (F.sum("__ahead").over(run) * 1e6).cast("long")})
    recent = Window.partitionBy(*key).orderBy("__progress").rangeBetween(-int(within * 1e6), 0)
    spread = F.max("__heading").over(recent) - F.min("__heading").over(recent)
    last = F.max(F.when(F.col("__found"), F.col("__progress"))).over(run)
    s = s.withColumn("__found", spread >= turns * 360.0).withColumn("inner_turn", F.coalesce(F.col("__progress") - last < int(cleared * 1e6), F.lit(False)))
    return s.drop("__turn", "__ahead", "__heading", "__progress", "__found")
