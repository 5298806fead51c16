"""Mixing sources to target weights (operator 6): a subset-sum fit of each source's word budget.

Documents are counted by exact length.  Whole repeats of a source come first; the remaining budget is shared
over the lengths in proportion and closed by bounded-knapsack dynamic programming over length counts.  The
documents of each length are then picked by a seeded hash, down to the exact count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayring.llm._io import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
#: Sources are labels: their totals are collected, and more than so many are an error.
MOST_SOURCES = 100_000
#: Hash bands in which the documents of one source and length are counted and picked.
BANDS = 4096


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Targets that add up to all sizes: weights in the order of code points (null last), each at most ``repeats`` times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_ = float(sum(sizes.values())), list(names)
    out: dict[str | None, float] = {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > repeats * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near ``budget``.

    All but the last four longest documents' worth of words is shared over the lengths in proportion; the rest is
    fitted exactly by the documents that are left.
    """
    order = np.argsort(-lengths, kind="stable")
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * have).sum())
    if budget >= total:
        return counts.copy()
    reserve = 4 * int(size[0])
    share = have * (max(0, budget - reserve) / total)
    take = np.floor(share).astype(np.int64)
    left = budget - int((size * take).sum())
    # single documents, the largest fractions first, until the rest is small enough to be fitted exactly
    while left > reserve:
        before = left
        for k in np.argsort(-(share - take), kind="stable"):
            if left - size[k] >= reserve and take[k] < have[k]:
                take[k] += 1
                left -= int(size[k])
        if left == before:
            break
    # bounded knapsack: bit b says that b units of words can be reached; powers of two split each count.  For each sum
    # the first item that reaches it is kept: what it leaves was reached by earlier ones
    unit = max(1, int(np.gcd.reduce(size)))
    room = left // unit
    mask, reached, items, first = (1 << (room + 1)) - 1, 1, [], np.full(room + 1, -1, np.int32)
    for k in np.flatnonzero(size).tolist():
        weight, more, step = int(size[k]) // unit, int(have[k] - take[k]), 1
        more = min(more, room // weight)
        while more > 0 and not reached >> room & 1:
            n = min(step, more)
            new = (reached << (n * weight)) & mask & ~reached
            reached |= new
            bits = np.unpackbits(np.frombuffer(new.to_bytes(room // 8 + 1, "little"), np.uint8), bitorder="little")
            first[np.flatnonzero(bits)] = len(items)
            items.append((k, n, n * weight))
            more -= n
            step *= 2
    best = reached.bit_length() - 1
    while best:
        k, n, weight = items[first[best]]
        take[k] += n
        best -= weight
    # where one more document comes nearer from above than the fit does from below
    gap = budget - int((size * take).sum())
    if gap > 0 and (have > take).any():
        off = np.where(have > take, np.abs(size - gap), np.iinfo(np.int64).max)
        if off.min() < gap:
            take[int(off.argmin())] += 1
    out = np.zeros(len(counts), np.int64)
    out[order] = take
    return out


def mix_sources(docs: DataFrame, seed: int = 20240607, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    ``taken`` is the row's size times how often the mix uses it (0 to ``repeats``).  Null texts and texts
    without words have size 0 and are never taken; rows without a source form one source, the last; repeated
    rows count each and, being alike, are interchangeable; other columns are ignored.  The texts are read once
    and never shuffled; a very long text is only counted, and may exceed what its source lacks.  Documents of one length are
    told by a seeded hash of the id, ties by the id.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("k"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        ).withColumn("band", F.pmod("h", F.lit(BANDS)).cast("int")),
        "mix-sizes",
    )
    totals = sized.groupBy("k", "source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    targets = source_targets({r.source: r.n for r in totals}, weights, repeats)
    plan = []
    for r in totals:
        base = min(repeats, int(targets[r.source] // r.n)) if r.n else 0
        plan.append((r.k, r.n, float(targets[r.source]), base, 0 if base >= repeats or not r.n else int(round(targets[r.source] - base * r.n))))
    plan_df = F.broadcast(spark.createDataFrame(plan, "k string, source_size long, target double, base int, budget long"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        extra = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]))
        return pdf[["k", "size"]].assign(extra=extra)

    bands = sized.groupBy("k", "size", "band").agg(F.count("*").alias("n"))
    lengths = bands.groupBy("k", "size").agg(F.sum("n").alias("n"))
    chosen = lengths.where("size > 0").join(plan_df.where("budget > 0").select("k", "budget"), "k").groupBy("k").applyInPandas(fit, "k string, size long, extra long")
    before = F.sum("n").over(Window.partitionBy("k", "size").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    quota = bands.withColumn("before", F.coalesce(before, F.lit(0))).join(chosen, ["k", "size"]).select("k", "size", "band", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("quota"), F.col("n").alias("in_band"))
    marked = sized.join(quota, ["k", "size", "band"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    sure = marked.where("quota = 0 or quota = in_band").withColumn("extra", (F.col("quota") > 0).cast("int"))
    rank = F.row_number().over(Window.partitionBy("k", "size", "band").orderBy("h", "doc_id"))
    some = marked.where("quota > 0 and quota < in_band").withColumn("extra", (rank <= F.col("quota")).cast("int"))
    return (
        sure.unionByName(some)
        .join(plan_df, "k")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("base") + F.col("extra"))).cast("long").alias("taken"))
    )
