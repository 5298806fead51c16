"""Connected components of a link table by repeated contraction; no driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayring.llm._io import discard, written


def components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """``node, label`` for every node of ``links`` (columns ``a, b``); the label is one node of the component.

    Each round maps a node to the first of itself and its neighbours in some order and contracts the links
    accordingly; the rounds' maps are then composed.  The first round orders nodes by value, which ends groups
    that hang on one least node; each later round orders them by a hash of its own, so that no arrangement of
    values is slow: half the nodes of a path are expected to go in a round, and no fewer in denser groups.
    Self links and repeated links are harmless; null ends are ignored; without links the result is empty.
    The tables of the rounds are deleted; ``rounds`` gathers the links left before each.
    """
    edges = written(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "cc-edges")
    result: DataFrame | None = None
    turn = 0
    while left := edges.count():
        if rounds is not None:
            rounds.append(left)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.col(c)) if turn == 0 else (lambda c, turn=turn: F.xxhash64(c, F.lit(turn)))
        nearest = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("label"))).alias("n"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("label"))
        step = written(nearest.select(F.col("a").alias("node"), F.least("n", own)["label"].alias("label")), "cc-map")
        before = result
        if before is None:
            result = step
        else:
            next_ = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
            result = written(before.join(next_, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        x, y = step.select(F.col("node").alias("a"), F.col("label").alias("x")), step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        fewer = written(edges.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        discard(edges, *([before, step] if before is not None else []))
        edges, turn = fewer, turn + 1
    if result is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    discard(edges)
    return result
