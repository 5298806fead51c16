"""Fitting groups of vehicles to synchronization templates.

A template is a list of slots (slot id, vehicle type, phase offset, sign, optional role).  Groups meet the templates of
their own multiset of vehicle types.  Members that may take the same slots, and slots that are of one type and role,
make blocks; only orders within blocks are tried, in tasks, a bounded number at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayring.config import Scoring
from wayring.functions.scoring import band_score


@dataclass(frozen=True)
class Slot:
    slot_id: str
    vehicle_type: str
    offset: float
    sign: int = 1
    role: str | None = None


@dataclass(frozen=True)
class Template:
    template_id: str
    family: str
    slots: tuple[Slot, ...]

    def __post_init__(self) -> None:
        if self.family == "free":
            raise ValueError("free routes have no templates")
        if len(self.slots) < 2 or len({s.slot_id for s in self.slots}) != len(self.slots):
            raise ValueError("a template needs two slots or more with ids of their own")
        if any(not s.slot_id or not s.vehicle_type or s.sign not in (-1, 1) for s in self.slots):
            raise ValueError("slots need an id, a vehicle type and a sign of 1 or -1")
        if not all(math.isfinite(s.offset) for s in self.slots):
            raise ValueError("phase offsets must be finite")
        if len(self.slots) > 8:
            raise ValueError("templates have eight slots at most")


def cycle_delta(value: Column, reference: Column) -> Column:
    """Signed difference of phases in [-0.5, 0.5)."""
    return F.pmod(value - reference + 0.5, F.lit(1.0)) - 0.5


def circular_l1_center(phases: Column) -> Column:
    """The phase with the least sum of distances: among the medians of the phases unwrapped about each of them.

    Two phases are split evenly.  Ties go to the smaller largest distance, then to the smaller phase.
    """
    n = F.size(phases)
    distance = lambda a, b: F.least(F.abs(F.pmod(a - b, F.lit(1.0))), 1.0 - F.abs(F.pmod(a - b, F.lit(1.0))))

    def median(anchor: Column) -> Column:
        line = F.array_sort(F.transform(phases, lambda v: anchor + cycle_delta(v, anchor)))
        low, high = F.get(line, F.floor((n - 1) / 2).cast("int")), F.get(line, F.floor(n / 2).cast("int"))
        return F.pmod((low + high) / 2.0, F.lit(1.0))

    def rated(c: Column) -> Column:
        each = F.transform(phases, lambda v: distance(v, c))
        return F.struct(F.aggregate(each, F.lit(0.0), lambda a, b: a + b).alias("sum"), F.array_max(each).alias("most"), c.alias("phase"))

    centers = F.transform(phases, median)
    return F.when(n == 1, F.pmod(F.get(phases, F.lit(0)), F.lit(1.0))).otherwise(F.array_min(F.transform(centers, rated))["phase"])


SLOTS = "array<struct<slot_id:string,vehicle_type:string,offset:double,sign:int,role:string>>"
#: Assignments that are rated together.
TRIED = 4096


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``template_id, types, slots``: a row per template, with its vehicle types in order."""
    rows = [(t.template_id, sorted(s.vehicle_type for s in t.slots), [(s.slot_id, s.vehicle_type, s.offset % 1.0, s.sign, s.role) for s in t.slots]) for t in templates]
    return spark.createDataFrame(rows, f"template_id string, types array<string>, slots {SLOTS}")


@lru_cache(maxsize=16)
def assignments(members: tuple[tuple[str, str | None], ...], slots: tuple[tuple[str, str | None], ...]) -> tuple[np.ndarray, ...]:
    """Legal orders of the slots for the members (each as type and role), ``TRIED`` rows at most in one array.

    A slot takes members of its type, and of its role if it has one, so only orders within blocks of one type and role
    come up.  Groups and templates that agree in types and roles share the arrays, which a task keeps for the last few.
    """
    return tuple(_assignments(members, slots))


def _assignments(members: tuple, slots: tuple) -> Iterator[np.ndarray]:
    fits = [[k for k, (kind, role) in enumerate(slots) if kind == m and (role is None or role == r)] for m, r in members]
    waiting: list[list[int]] = []

    def dealt(at: int, used: int, chosen: list[int]) -> Iterator[list[int]]:
        if at == len(members):
            yield list(chosen)
            return
        for k in fits[at]:
            if not used >> k & 1:
                chosen.append(k)
                yield from dealt(at + 1, used | 1 << k, chosen)
                chosen.pop()

    for one in dealt(0, 0, []):
        waiting.append(one)
        if len(waiting) == TRIED:
            yield np.array(waiting, np.int64)
            waiting = []
    if waiting:
        yield np.array(waiting, np.int64).reshape(-1, len(members))


def _centers(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The circular L1 centre of each row and the distances to it; as :func:`circular_l1_center`."""
    n = shifted.shape[1]
    if n == 1:
        return shifted[:, 0], np.zeros_like(shifted)
    line = np.sort(shifted[:, :, None] + (shifted[:, None, :] - shifted[:, :, None] + 0.5) % 1.0 - 0.5, axis=2)
    middle = ((line[:, :, (n - 1) // 2] + line[:, :, n // 2]) / 2.0) % 1.0
    far = np.abs(shifted[:, None, :] - middle[:, :, None]) % 1.0
    far = np.minimum(far, 1.0 - far)
    total = far[:, :, 0].copy()
    for k in range(1, n):  # in the order of the members
        total += far[:, :, k]
    most = far.max(axis=2)
    best = np.lexsort((middle, most, total), axis=1)[:, 0]
    rows = np.arange(len(shifted))
    return middle[rows, best], far[rows, best]


def best_fit(members: list[tuple[str, str | None, float]], slots: list[tuple]) -> tuple[float, float, float, list[float], list[int]] | None:
    """Common phase, mean and largest error, the members' errors and their slots, of the best legal assignment."""
    phases = np.array([m[2] for m in members])
    offset, sign = np.array([s[2] for s in slots]), np.array([s[3] for s in slots])
    by_id = np.empty(len(slots), np.int64)
    by_id[sorted(range(len(slots)), key=lambda k: slots[k][0])] = np.arange(len(slots))
    best: tuple | None = None
    for order in assignments(tuple(m[:2] for m in members), tuple((s[1], s[4]) for s in slots)):
        center, errors = _centers((phases * sign[order] - offset[order]) % 1.0)
        mean, most = errors.sum(axis=1) / len(members), errors.max(axis=1)
        keys = (center, *by_id[order].T[::-1], np.round(most, 15), np.round(mean, 15))
        k = int(np.lexsort(keys)[0])
        found = (tuple(float(key[k]) for key in reversed(keys)), float(center[k]), float(mean[k]), float(most[k]), errors[k].tolist(), order[k].tolist())
        if best is None or found[0] < best[0]:
            best = found
    return None if best is None else best[1:]


def candidates(members: DataFrame, templates: list[Template]) -> DataFrame:
    """Groups beside each template of their multiset of types: ``group_id, template_id, n, members, slots``; one pass over the members."""
    role = F.col("role") if "role" in members.columns else F.lit(None).cast("string")
    one = F.struct(F.col("member"), F.col("vehicle_type"), F.pmod(F.col("phase"), F.lit(1.0)).alias("phase"), role.alias("role"))
    sizes = sorted({len(t.slots) for t in templates})
    # a group larger than any template fits none: of its rows only one too many is gathered
    at = F.row_number().over(Window.partitionBy("group_id").orderBy("member"))
    few = members.withColumn("__at", at).where(F.col("__at") <= max(sizes, default=0) + 1)
    groups = few.groupBy("group_id").agg(F.sort_array(F.collect_list(one)).alias("members"), F.count("*").cast("int").alias("n")).where(F.col("n").isin(*sizes))
    groups = groups.withColumn("types", F.array_sort(F.transform("members", lambda m: m["vehicle_type"])))
    # as many rows as templates were given
    return groups.join(F.broadcast(template_table(members.sparkSession, templates)), "types").select("group_id", "template_id", "n", "members", "slots")


def best_fits(members: tuple[tuple[str, str | None], ...], phases: np.ndarray, slots: list[tuple]) -> list[tuple | None]:
    """:func:`best_fit` for groups of one kind of members, a row of phases each; some thousand assignments are rated together."""
    orders = assignments(members, tuple((s[1], s[4]) for s in slots))
    if len(orders) != 1:
        return [best_fit([(*m, p) for m, p in zip(members, row, strict=True)], slots) for row in phases.tolist()]
    order, n = orders[0], len(members)
    offset, sign = np.array([s[2] for s in slots]), np.array([s[3] for s in slots])
    by_id = np.empty(n, np.int64)
    by_id[sorted(range(n), key=lambda k: slots[k][0])] = np.arange(n)
    order = order[np.lexsort(by_id[order].T[::-1])]  # the first of equal ones has the first slot ids
    out: list[tuple | None] = []
    step = max(1, TRIED // len(order))
    for k in range(0, len(phases), step):
        part = phases[k : k + step]
        center, errors = _centers(((part[:, None, :] * sign[order] - offset[order]) % 1.0).reshape(-1, n))
        mean, most = errors.sum(axis=1) / n, errors.max(axis=1)
        shape = (len(part), len(order))
        best = np.lexsort((np.round(most, 15).reshape(shape), np.round(mean, 15).reshape(shape)), axis=1)[:, 0]
        at = np.arange(len(part)) * len(order) + best
        out.extend(zip(center[at].tolist(), mean[at].tolist(), most[at].tolist(), errors[at].tolist(), order[best].tolist(), strict=True))
    return out


def legal_assignments(members: DataFrame, templates: list[Template]) -> DataFrame:
    """Groups with each arrangement that their members may take: types agree, and roles where the slot has one.

    ``members`` has ``group_id, member, vehicle_type, phase`` and perhaps ``role``; one shuffle by group.
    """
    found = candidates(members, templates)
    schema = found.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                slots = [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in row.slots]
                for orders in assignments(tuple((m["vehicle_type"], m["role"]) for m in row.members), tuple((s[1], s[4]) for s in slots)):
                    out = [(row.group_id, row.template_id, row.n, row.members, [slots[k] for k in order]) for order in orders.tolist()]
                    yield pd.DataFrame(out, columns=list(pdf.columns))

    return found.mapInPandas(run, schema)


def fit_templates(members: DataFrame, templates: list[Template]) -> DataFrame:
    """Best fit of each group to each template that it can take: ``common_phase``, errors and the slots in member order.

    The best has the least mean error, then the least largest one (both to 15 digits), then the first slot ids,
    then the smaller phase.  Groups without a legal assignment give no row.
    """
    fits = fitted(candidates(members, templates), templates)
    return fits.select("group_id", "template_id", "common_phase", "mean_error", "max_error", "errors", "members", "slots")


def fitted(found: DataFrame, templates: list[Template]) -> DataFrame:
    """Rows of :func:`candidates`, perhaps with further columns, and the best fit of each; ``slots`` in the order of the members.

    Only types, roles and phases go to Python, where rows that agree in all but the phases are rated together.
    """
    slots = {t.template_id: [(s.slot_id, s.vehicle_type, s.offset % 1.0, s.sign, s.role) for s in t.slots] for t in templates}

    @F.pandas_udf("common_phase double, mean_error double, max_error double, errors array<double>, slot_order array<int>")
    def fit(template: pd.Series, types: pd.Series, roles: pd.Series, phases: pd.Series) -> pd.DataFrame:
        alike: dict[tuple, list[int]] = {}
        for k, (t, kinds, own) in enumerate(zip(template, types, roles, strict=True)):
            alike.setdefault((t, tuple(zip(kinds, own, strict=True))), []).append(k)
        out: list[tuple] = [(None,) * 5] * len(template)
        for (t, kinds), at in alike.items():
            for k, best in zip(at, best_fits(kinds, np.array([phases.iat[k] for k in at], np.float64), slots[t]), strict=True):
                out[k] = best or out[k]
        return pd.DataFrame(out, columns=["common_phase", "mean_error", "max_error", "errors", "slot_order"])

    # marked as not deterministic, so that the optimizer does not run it once more for the filter
    each = lambda name: F.transform("members", lambda m: m[name])
    f = found.withColumn("fit", fit.asNondeterministic()("template_id", each("vehicle_type"), each("role"), each("phase"))).where("fit.slot_order is not null")
    names = [c for c in found.columns if c not in ("n", "slots")]
    return f.select(*names, "fit.common_phase", "fit.mean_error", "fit.max_error", "fit.errors", F.transform("fit.slot_order", lambda k: F.get("slots", k)).alias("slots"))


def pair_fits(found: DataFrame) -> DataFrame:
    """Rows of :func:`candidates` with two members, perhaps with further columns, and the ``errors`` of the best fit of each, as expressions.

    Two members split evenly what their difference lacks of their slots' offsets, so no centre is looked for.  The difference is
    taken of the phases as they are, which may lie beyond a cycle: nothing is rounded between it and the error.
    """
    x, y = (F.get("members", F.lit(k)) for k in (0, 1))
    takes = lambda m, s: (m["vehicle_type"] == s["vehicle_type"]) & (s["role"].isNull() | F.coalesce(s["role"] == m["role"], F.lit(False)))

    def error(a: Column, b: Column) -> Column:
        lacks = x["phase"] * a["sign"] - y["phase"] * b["sign"] - (a["offset"] - b["offset"])
        return F.when(takes(x, a) & takes(y, b), F.abs(lacks - F.rint(lacks)) / 2.0)

    a, b = (F.get("slots", F.lit(k)) for k in (0, 1))
    f = found.where("n = 2").withColumn("__error", F.least(error(a, b), error(b, a))).where("__error is not null")
    return f.withColumn("errors", F.array("__error", "__error")).drop("n", "__error")


def member_fits(fits: DataFrame) -> DataFrame:
    """One row per member of a fit: slot, expected phase and position error in cycles and degrees."""
    each = fits.select("group_id", "template_id", "common_phase", F.explode(F.arrays_zip("members", "slots", "errors")).alias("z"))
    expected = F.pmod((F.col("common_phase") + F.col("z.slots.offset")) * F.col("z.slots.sign"), F.lit(1.0))
    return each.select("group_id", "template_id", F.col("z.members.member").alias("member"), F.col("z.slots.slot_id").alias("slot_id"), expected.alias("expected_phase"), F.col("z.errors").alias("error_cycle"), (F.col("z.errors") * 360.0).alias("error_deg"))


def fit_scores(fits: DataFrame, templates: list[Template], cfg: Scoring = Scoring(), key: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """The key (``group_id``, perhaps with a time) and ``template_id, score``: the mean position score of a fit's members, by the band of the template's family."""
    family = F.create_map(*(F.lit(x) for t in templates for x in (t.template_id, t.family)))
    degrees, cycles = (lambda e: band_score(e * 360.0, cfg.si_position)), (lambda e: band_score(e, cfg.so_position))
    each = F.when(family[F.col("template_id")] == "si", F.transform("errors", degrees)).otherwise(F.transform("errors", cycles))
    return fits.select(*key, "template_id", (F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.size("errors")).alias("score"))


def advantages(scores: DataFrame, current: DataFrame | Column, key: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """How much better each group's best other template is than its own: the key (``group_id``, perhaps with a time) and ``template_id, advantage``.

    ``current`` has ``group_id`` and ``current_template_id``, or is the latter as an expression.  Groups whose own template
    does not fit, or that fit no other, have none; of equally good ones the first by id is named.
    """
    s = scores.withColumn("current_template_id", current) if isinstance(current, Column) else scores.join(current, "group_id")
    own, other = F.col("template_id") == F.col("current_template_id"), F.col("template_id") != F.col("current_template_id")
    told = s.groupBy(*key).agg(
        F.max(F.when(own, F.col("score"))).alias("own"), F.max(F.when(other, F.col("score"))).alias("best"), F.min(F.when(other, F.struct((-F.col("score")).alias("s"), "template_id")))["template_id"].alias("template_id")
    )
    return told.where("own is not null and best is not null").select(*key, "template_id", (F.col("best") - F.col("own")).alias("advantage"))
