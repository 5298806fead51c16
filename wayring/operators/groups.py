"""Groups of vehicles through time: stable links, components per epoch, identities that outlive changes of members.

Links hold over intervals of seconds.  The vehicles that any link ever joins form a fleet; a fleet's epochs lie between
the times at which one of its links begins or ends.  Groups are the components of an epoch, and a group goes on in the
next epoch's group that keeps enough of its members.  All of it is joins, windows and star contractions; nothing is
replayed in order, and no task holds a server.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayring.config import Grouping, Scoring
from wayring.session import dropped, materialized


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the least node that links reach.

    Large and small stars in turn: every round hangs a node's greater neighbours, then its lesser ones, on the least of
    them, which ends after a number of rounds that grows with the logarithm of the nodes.  Each round is written to the
    shared folder and the one before it deleted.
    """
    edges = materialized(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "links")
    before = None
    while True:
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        before, last = seen, edges
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = materialized(hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        dropped(last)


def stable_links(intervals: DataFrame, cfg: Grouping = Grouping()) -> DataFrame:
    """``server_id, a, b, from_s, to_s``: when links count, from intervals ``server_id, a, b, start_s, end_s`` in which they hold.

    Intervals of a link no more than the hold apart are one.  It counts once it has held for the confirmation time, and
    for the hold after its end, in which memberships outlive silence; shorter ones never count.
    """
    i = intervals.where("a <> b and start_s < end_s").select("server_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "start_s", "end_s")
    w = Window.partitionBy("server_id", "a", "b").orderBy("start_s", "end_s")
    reached = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    i = i.withColumn("fresh", F.coalesce(F.col("start_s") > reached + cfg.hold_seconds, F.lit(True)).cast("int"))
    i = i.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = i.groupBy("server_id", "a", "b", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return whole.where(F.col("end_s") - F.col("start_s") >= cfg.confirm_seconds).select("server_id", "a", "b", (F.col("start_s") + cfg.confirm_seconds).alias("from_s"), (F.col("end_s") + cfg.hold_seconds).alias("to_s"))


def wrong_ways(spells: DataFrame, scoring: Scoring = Scoring(), cfg: Grouping = Grouping()) -> DataFrame:
    """Spells (``server_id, member, start_s, end_s``) of moving against the own group that are long enough for an alert.

    Adds ``alert_s`` and, for those that go on so long that the vehicle leaves, ``exit_s``.  A reversal of a whole group
    is no such spell: the group's direction is that of most of its members (:func:`against_group`).
    """
    s = spells.withColumns({"alert_s": F.col("start_s") + scoring.wrong_direction_seconds, "exit_s": F.col("start_s") + scoring.wrong_direction_seconds + cfg.exit_seconds})
    return s.where("alert_s <= end_s").withColumn("exit_s", F.when(F.col("exit_s") < F.col("end_s"), F.col("exit_s")))


def against_group(directions: DataFrame) -> DataFrame:
    """Spells of moving against the group, from ``server_id, group_id, member, second, direction`` (1 or -1).

    At each second the group's direction is that of most members; even groups have none.  A spell is an unbroken
    run of the member's own seconds.
    """
    total = directions.groupBy("server_id", "group_id", "second").agg(F.signum(F.sum("direction")).alias("common"))
    d = directions.join(total, ["server_id", "group_id", "second"]).withColumn("against", (F.col("common") != 0) & (F.col("direction") != F.col("common")))
    w = Window.partitionBy("server_id", "group_id", "member").orderBy("second")
    d = d.withColumn("run", F.sum(F.coalesce(F.col("against") != F.lag("against").over(w), F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("against").groupBy("server_id", "group_id", "member", "run").agg(F.min("second").alias("start_s"), F.max("second").alias("end_s")).drop("run")


def without_exits(links: DataFrame, exits: DataFrame) -> DataFrame:
    """Links less the times (``server_id, member, from_s, to_s``) at which one of their members is out."""
    out = exits.select("server_id", "member", F.struct("from_s", "to_s").alias("out"))
    numbered = links.withColumn("link", F.struct("server_id", "a", "b", "from_s"))
    of = lambda side: numbered.join(out.withColumnRenamed("member", side), ["server_id", side]).select("link", "out")
    gathered = of("a").unionByName(of("b")).groupBy("link").agg(F.array_sort(F.collect_set("out")).alias("outs"))  # one link's exits
    pieces = "array<struct<from_s:bigint,to_s:bigint>>"
    start = F.struct(F.col("from_s").cast("long").alias("at"), F.array().cast(pieces).alias("kept"))

    def step(acc: Column, out: Column) -> Column:
        piece = F.array(F.struct(acc["at"].alias("from_s"), F.least(out["from_s"], F.col("to_s")).cast("long").alias("to_s"))).cast(pieces)
        kept = F.when((out["from_s"] > acc["at"]) & (acc["at"] < F.col("to_s")), F.concat(acc["kept"], piece)).otherwise(acc["kept"])
        return F.struct(F.greatest(acc["at"], out["to_s"]).cast("long").alias("at"), kept.alias("kept"))

    rest = lambda acc: F.concat(acc["kept"], F.array(F.struct(acc["at"].alias("from_s"), F.col("to_s").cast("long").alias("to_s"))).cast(pieces))
    cut = numbered.join(gathered, "link", "left").withColumn("piece", F.explode(F.aggregate(F.coalesce("outs", F.array().cast("array<struct<from_s:bigint,to_s:bigint>>")), start, step, rest)))
    return cut.where("piece.from_s < piece.to_s").select("server_id", "a", "b", "piece.from_s", "piece.to_s")


def memberships(links: DataFrame, keep: float = Grouping().identity_fraction) -> DataFrame:
    """``server_id, member, group_id, from_s, to_s``: who was in which group when, from links that count (``server_id, a, b, from_s, to_s``).

    A group keeps its id in the next epoch's group that holds at least ``keep`` of its members, unless another group's
    id would go there too: merged groups get a new id, as do groups without a forerunner.  An id names the server, the
    second at which the group began and its least member then.
    """
    named = links.select(F.struct("server_id", F.col("a").alias("member")).alias("a"), F.struct("server_id", F.col("b").alias("member")).alias("b"), "server_id", "from_s", "to_s").where("from_s < to_s")
    fleets = components(named)
    own = named.join(fleets.select(F.col("node").alias("a"), F.col("label").alias("fleet")), "a")
    # a link's epochs are numbered, so that it meets them by number and not by a range of times
    times = own.select("fleet", F.explode(F.array("from_s", "to_s")).alias("at_s")).distinct()
    order = Window.partitionBy("fleet").orderBy("at_s")
    epochs = materialized(times.withColumns({"epoch": F.row_number().over(order), "until_s": F.lead("at_s").over(order)}), "epochs")
    begin, end = epochs.select("fleet", F.col("at_s").alias("from_s"), F.col("epoch").alias("first")), epochs.select("fleet", F.col("at_s").alias("to_s"), (F.col("epoch") - 1).alias("last"))
    alive = own.join(begin, ["fleet", "from_s"]).join(end, ["fleet", "to_s"]).withColumn("epoch", F.explode(F.sequence("first", "last")))
    at = lambda side: F.struct("fleet", "epoch", F.col(f"{side}.member").alias("member"))
    found = components(alive.select(at("a").alias("a"), at("b").alias("b")))
    rows = materialized(found.select("node.fleet", "node.epoch", "node.member", F.col("label.member").alias("least")), "groups")
    size = rows.groupBy("fleet", "epoch", "least").agg(F.count("*").alias("size"))
    before = rows.select("fleet", (F.col("epoch") + 1).alias("epoch"), "member", F.col("least").alias("was"))
    stay = rows.join(before, ["fleet", "epoch", "member"]).groupBy("fleet", "epoch", "least", "was").agg(F.count("*").alias("shared"))
    stay = stay.join(size.select("fleet", (F.col("epoch") + 1).alias("epoch"), F.col("least").alias("was"), "size"), ["fleet", "epoch", "was"]).where(F.col("shared") >= F.col("size") * keep)
    heirs = stay.groupBy("fleet", "epoch", "least").agg(F.count("*").alias("forerunners"), F.min("was").alias("was")).where("forerunners = 1")
    group = lambda epoch, least: F.struct("fleet", epoch.alias("epoch"), F.col(least).alias("least"))
    # each group has one forerunner and one heir at most, so chains of them are components, and their first is the least
    chains = components(heirs.select(group(F.col("epoch"), "least").alias("a"), group(F.col("epoch") - 1, "was").alias("b")))
    rows = rows.withColumn("node", group(F.col("epoch"), "least")).join(chains, "node", "left").withColumn("root", F.coalesce("label", "node"))
    starts = epochs.select("fleet", F.col("epoch").alias("began"), F.col("at_s").alias("began_s"))
    rows = rows.withColumn("began", F.col("root.epoch")).join(starts, ["fleet", "began"]).join(epochs, ["fleet", "epoch"])
    rows = rows.withColumn("group_id", F.concat_ws(":", F.col("fleet.server_id"), F.col("began_s"), F.col("root.least")))
    w = Window.partitionBy("fleet", "member", "group_id").orderBy("epoch")
    runs = rows.withColumn("run", F.col("epoch") - F.row_number().over(w))
    return runs.groupBy(F.col("fleet.server_id").alias("server_id"), "member", "group_id", "run").agg(F.min("at_s").alias("from_s"), F.max("until_s").alias("to_s")).drop("run")


def group_changelog(members: DataFrame) -> DataFrame:
    """``at_s, kind, server_id, member, group_id`` of memberships: who joins and leaves which group when."""
    both = F.array(F.struct(F.col("from_s").alias("at_s"), F.lit("group_joined").alias("kind")), F.struct(F.col("to_s").alias("at_s"), F.lit("group_left").alias("kind")))
    return members.withColumn("x", F.explode(both)).select("x.at_s", "x.kind", "server_id", "member", "group_id")
