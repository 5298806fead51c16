"""Lifecycle of vehicle streams: routes, frames, activation and data loss, in batch and in Structured Streaming.

Batch and stream call the same steps for each sample, so one large batch, micro-batches and a restart from a
checkpoint or a snapshot give the same changes and frames.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayring.config import Detection, Engine, Grouping, Timing
from wayring.session import SETTINGS, spread
from wayring.streaming.route_steps import FIELDS, Route, RouteState, advance, look

KEY = ["server_id", "vehicle_identifier"]
CHANGES = "server_id long, vehicle_identifier long, change_s double, kind string, route_id string, family string, subtype string, direction string, period_s double, quality double, fit_fraction double, cycles double"
ROUTE_STATE = "server_id long, vehicle_identifier long, last_time double, last_look double, candidate boolean, confirmed boolean, " + ", ".join(f"{f} array<double>" for f in FIELDS) + ", " + Route.SCHEMA
STATE_CHANGES = "server_id long, vehicle_identifier long, at_us long, kind string"
#: What the samples of a stream give: changes, with details and geometry where a route is found, and a frame per accepted sample.
RESULTS = "output string, server_id long, vehicle_identifier long, at_us long, kind string, route_id string, family string, subtype string, direction string, period_s double, quality double, fit_fraction double, cycles double, active boolean, latitude_deg double, longitude_deg double, velocity_east_mps double, velocity_north_mps double, reliability double, phase double, " + Route.SCHEMA
DETAILS = ("family", "subtype", "direction", "period_s", "quality", "fit_fraction", "cycles")
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
_SAMPLE = ["second", "active", "latitude_deg", "longitude_deg", "velocity_east_mps", "velocity_north_mps", "reliability"]


def columns_of(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.strip().split(" ") for c in schema.split(","))])


_RESULTS = arrow_schema(RESULTS)


def prepared(samples: DataFrame) -> DataFrame:
    """The columns that the steps read; samples of one time are told by vehicle number, where there is one."""
    number = F.col("vehicle_number") if "vehicle_number" in samples.columns else F.lit(None)
    at = F.unix_micros(F.col("sample_time").cast("timestamp"))
    keys, values = (F.col(c).cast("long").alias(c) for c in KEY), (F.col(c).cast("double").alias(c) for c in _SAMPLE[2:])
    return samples.where("sample_time is not null").select(*keys, at.alias("at_us"), (at / 1e6).alias("second"), "active", *values, number.cast("long").alias("number"))


def in_time(rows: DataFrame, *first: str) -> DataFrame:
    """Rows by stream and in order of time, so that streams pass by in record batches and none is held whole."""
    return spread(rows, *KEY).sortWithinPartitions(*KEY, *first, "at_us", F.col("number").asc_nulls_last())


def runs(batch: pa.RecordBatch) -> list[tuple[tuple, int, int]]:
    """The streams in a record batch of rows in order, each with its first row and the one behind its last."""
    keys, fresh = [batch.column(c) for c in KEY], np.zeros(max(len(batch) - 1, 0), bool)
    for column in keys:
        column = column if pa.types.is_integer(column.type) else column.dictionary_encode().indices  # noqa: PLW2901
        value, null = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
        fresh |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    at = [0, *(np.flatnonzero(fresh) + 1).tolist(), len(batch)]
    return [(tuple(c[i].as_py() for c in keys), i, j) for i, j in zip(at, at[1:], strict=False) if i < j]


def _finite(column: pa.Array) -> pa.Array:
    return pc.if_else(pc.is_nan(column), pa.scalar(None, column.type), column) if pa.types.is_floating(column.type) else column


def values_of(batch: pa.RecordBatch) -> list[list]:
    """Times and sample values as lists; NaN is no value."""
    return [_listed(batch.column(c)) for c in ("at_us", *_SAMPLE)]


def _listed(column: pa.Array) -> list:
    """A column as a list, by way of numpy, which is many times faster than one value after the other."""
    floating = pa.types.is_floating(column.type)
    values = (column if floating else column.fill_null(False if pa.types.is_boolean(column.type) else 0)).to_numpy(zero_copy_only=False)
    out = values.tolist()
    if floating or column.null_count:
        for k in np.flatnonzero(np.isnan(values) if floating else column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[k] = None
    return out


def stirring(batch: pa.RecordBatch, config: Engine) -> list[int]:
    """The places of the samples that are more than one more place of an active, unbroken stream: each is a step of its own."""
    at = batch.column("at_us").fill_null(0).to_numpy()
    calm = batch.column("active").fill_null(False).to_numpy(zero_copy_only=False)
    for c in ("latitude_deg", "longitude_deg", "reliability"):
        calm = calm & (np.isfinite if c != "reliability" else lambda v: v > 0)(batch.column(c).fill_null(np.nan).to_numpy(zero_copy_only=False))
    gap = np.diff(at, prepend=at[:1])
    return np.flatnonzero(~(calm & (gap > 0) & (gap < deadlines(config)[0][0]))).tolist()


def record_batch(schema: pa.Schema, size: int, given: dict[str, list | pa.Array]) -> pa.RecordBatch:
    """Columns that are given, the others null."""
    arrays = [pa.nulls(size, f.type) if f.name not in given else given[f.name] if isinstance(given[f.name], pa.Array) else pa.array(given[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _in_order(pdf: pd.DataFrame) -> Iterator[tuple]:
    rows = pdf.sort_values(["at_us", "number"], kind="stable")
    return zip(rows["at_us"].tolist(), *(rows[c].astype(object).where(rows[c].notna(), None) for c in _SAMPLE), strict=True)


def route_id(key: tuple) -> str:
    return f"{key[0]}:{key[1]}:effective"


def _changes(key: tuple, state: RouteState, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, *sample in _in_order(pdf):
        for time, kind, found in advance(state, tuple(sample)):
            out.append((*key, time, kind, route_id(key), *(found.get(c) for c in DETAILS)))
    return pd.DataFrame(out, columns=columns_of(CHANGES))


def _held(states: pd.DataFrame) -> RouteState:
    if states.empty:
        return RouteState()
    row = states.iloc[0]
    history = {f: [float(x) for x in row[f]] for f in FIELDS}
    route = Route.of(*(row[c] for c in columns_of(Route.SCHEMA)))
    return RouteState(history, float(row["last_time"]), float(row["last_look"]), bool(row["candidate"]), bool(row["confirmed"]), route)


def _with_states(samples: DataFrame, states: DataFrame):
    """Samples by stream beside the stream's state, where there is one."""
    return prepared(samples).groupBy(*KEY).cogroup(states.groupBy(*KEY))


def _state_values(key: tuple, state: RouteState) -> tuple:
    return (*key, state.last_time, state.last_look, state.candidate, state.confirmed, *(state.history[f] for f in FIELDS), *state.route_values())


def _state_row(key: tuple, state: RouteState) -> pd.DataFrame:
    return pd.DataFrame([_state_values(key, state)], columns=columns_of(ROUTE_STATE))


def _route_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple[tuple, RouteState]]]]:
    """For each record batch the changes of its samples, and the states of the streams that ended."""
    key, state = None, None
    for batch in batches:
        found, ended = [], []
        rows = values_of(batch)[1:]
        for own, first, end in runs(batch):
            if own != key:
                if state is not None:
                    ended.append((key, state))
                key, state = own, RouteState()
            for sample in zip(*(c[first:end] for c in rows), strict=True):
                for time, kind, told in advance(state, sample):
                    found.append((*key, time, kind, route_id(key), *(told.get(c) for c in DETAILS)))
        yield found, ended
    if state is not None:
        yield [], [(key, state)]


def route_changes(samples: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Route candidates and confirmations of every stream, from all its samples; one shuffle by stream.

    With ``states`` of earlier samples (``route_states``) the streams go on from there; then the new samples of a stream
    are one group, else it comes in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in _route_steps(batches):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def resumed(key: tuple, pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _changes(key, _held(held), pdf)

    if states is None:
        schema = arrow_schema(CHANGES)
        return in_time(prepared(samples)).mapInArrow(run, CHANGES)
    return _with_states(samples, states).applyInPandas(resumed, CHANGES)


def route_states(samples: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """What every stream carries after its samples: unconfirmed history, last sample and look, candidate and route.

    Streams without new samples keep their state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ended in _route_steps(batches):
            if ended:
                rows = [_state_values(*one) for one in ended]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def resumed(key: tuple, pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        state = _held(held)
        _changes(key, state, pdf)
        return _state_row(key, state)

    if states is None:
        schema = arrow_schema(ROUTE_STATE)
        return in_time(prepared(samples)).mapInArrow(run, ROUTE_STATE)
    return _with_states(samples, states).applyInPandas(resumed, ROUTE_STATE)


def debug_state(states: DataFrame) -> DataFrame:
    """Diagnostics of ``route_states``: how much unconfirmed history a stream holds, from when to when, and its last look."""
    at = lambda x: F.timestamp_micros((x * 1e6).cast("long"))
    look = F.when(F.col("last_look") > float("-inf"), F.col("last_look"))
    return states.select(*KEY, F.size("time").alias("history_count"), at(F.array_min("time")).alias("history_start"), at(F.array_max("time")).alias("history_end"), "candidate", "confirmed", at(look).alias("last_evaluation"))


@dataclass
class Track:
    """A stream between two samples: its last one, the deadlines passed since, and what the route lifecycle carries."""

    last_us: int | None = None
    active: bool | None = None
    passed: int = 0
    routes: RouteState = field(default_factory=RouteState)

    def pass_deadlines(self, until_us: int, config: Engine) -> list[tuple[int, str]]:
        """Loss and expiry up to a time, stamped with their deadlines; expiry forgets the route."""
        out = []
        waits = deadlines(config)[self.passed :]
        if not waits or self.last_us is None or self.last_us + waits[0][0] > until_us:
            return out
        for wait, kind in waits:
            if self.last_us is None or self.last_us + wait > until_us:
                break
            out.append((self.last_us + wait, kind))
            self.passed += 1
            if kind == "vehicle_expired":
                self.routes.forget()
        return out

    def take(self, at_us: int, sample: tuple, config: Engine) -> list[tuple[int, str, dict | None]] | None:
        """Changes that follow from a sample; None for one that is not after the last, which changes nothing."""
        if self.last_us is not None and at_us <= self.last_us:
            return None
        out: list[tuple[int, str, dict | None]] = [(*c, None) for c in self.pass_deadlines(at_us, config)]
        active = None if sample[1] is None else bool(sample[1])
        if self.passed:
            out.append((at_us, "data_resumed", None))
        if active and not self.active:
            out.append((at_us, "vehicle_activated", None))
        elif active is False and self.active:
            out.append((at_us, "vehicle_deactivated", None))
        self.last_us, self.active, self.passed = at_us, active, 0
        found = advance(self.routes, (sample[0], active, *sample[2:]), config.detection, config.timing, config.grouping)
        # a change of a route is stamped with its start
        return out + [(round(time * 1e6), kind, told) for time, kind, told in found]


def deadlines(config: Engine) -> list[tuple[int, str]]:
    return _deadlines(config.timing.no_data_seconds, config.grouping.hold_seconds)


@lru_cache(maxsize=64)
def _deadlines(no_data_seconds: int, hold_seconds: int) -> list[tuple[int, str]]:
    return sorted([(no_data_seconds * 1_000_000, "data_lost"), (hold_seconds * 1_000_000, "vehicle_expired")])


class Gathered:
    """Changes and frames of the streams of one record batch, gathered by column."""

    def __init__(self, config: Engine) -> None:
        self.config = config
        self.clear()

    def clear(self) -> None:
        self.changes: list[tuple] = []
        self.frames: list[int] = []
        self.routes: list[str | None] = []
        self.phases: list[float | None] = []

    def tell(self, key: tuple, found: list[tuple]) -> None:
        self.changes.extend((key, *one) if len(one) == 3 else (key, *one, None) for one in found)

    def take(self, key: tuple, track: Track, rows: list[list], first: int, end: int, stirs: list[int] | None = None) -> None:
        """The samples of one stream from ``first`` to ``end``; ``track`` moves on.

        With ``stirs`` (:func:`stirring`) those between are taken by stretches, from look to look.
        """
        placed: dict[int, tuple[Route, list[int], list[int]]] = {}
        name, config, begun, k = route_id(key), self.config, len(self.frames), first
        at_us, follows = rows[0], config.detection.follow_changes
        while k < end:
            if stirs is not None and k > first and track.active and not track.passed and track.last_us == at_us[k - 1] and not (follows and track.routes.confirmed):
                at = bisect_left(stirs, k)
                calm = min(end, stirs[at]) if at < len(stirs) else end
                if calm > k:
                    k = self._stretch(key, track, rows, k, calm, placed)
                    continue
            sample = tuple(c[k] for c in rows[1:])
            changes = track.take(at_us[k], sample, config)
            if changes is not None:
                if changes:
                    self.tell(key, changes)
                route = track.routes.route
                if route is not None and sample[1] is not False and sample[2] is not None and sample[3] is not None:
                    self._place(placed, route, k, k + 1)
                self.frames.append(k)
            k += 1
        self.routes += [None] * (len(self.frames) - begun)
        self.phases += [None] * (len(self.frames) - begun)
        for route, at, row in placed.values():
            lat, lon = (np.array([rows[c][k] for k in row], float) for c in (3, 4))
            for k, phase in zip(at, route.phases(lat, lon).tolist(), strict=True):
                self.routes[k], self.phases[k] = name, phase

    def _place(self, placed: dict[int, tuple[Route, list[int], list[int]]], route: Route, first: int, end: int) -> None:
        """Samples on a route, which become the next frames."""
        _, at, row = placed.setdefault(id(route), (route, [], []))
        at.extend(range(len(self.frames), len(self.frames) + end - first))
        row.extend(range(first, end))

    def _stretch(self, key: tuple, track: Track, rows: list[list], first: int, end: int, placed: dict) -> int:
        """Samples that only go on, up to ``end`` or to a route that is to be watched; the place behind the last one taken."""
        routes, detection = track.routes, self.config.detection
        at_us, second = rows[0], rows[1]
        while first < end:
            if routes.confirmed:
                if detection.follow_changes:
                    break
                stop = end
                self._place(placed, routes.route, first, stop)
            else:
                due = bisect_left(second, routes.last_look + self.config.timing.batch_seconds, first, end)
                stop = min(due + 1, end)
                for name, c in zip(FIELDS, (1, 3, 4, 5, 6), strict=True):
                    routes.history[name].extend(rows[c][first:stop] if c < 5 else [math.nan if v is None else v for v in rows[c][first:stop]])
                found = look(routes, second[due], detection) if due < end else []
                if found:
                    self.tell(key, [(round(time * 1e6), kind, told) for time, kind, told in found])
                if routes.confirmed:  # of these the confirming sample alone is on the route
                    self.frames.extend(range(first, stop - 1))
                    self._place(placed, routes.route, stop - 1, stop)
                    first = stop - 1
            self.frames.extend(range(first, stop))
            track.last_us, routes.last_time = at_us[stop - 1], second[stop - 1]
            first = stop
        return first

    def batches(self, batch: pa.RecordBatch | None, schema: pa.Schema = _RESULTS) -> Iterator[pa.RecordBatch]:
        """``RESULTS`` of what was gathered from a record batch of samples; nothing is left."""
        if self.frames:
            taken = batch.select([*KEY, "at_us", *_SAMPLE]).take(pa.array(self.frames))
            own = {c: _finite(taken.column(c)) for c in (*KEY, "at_us", *_SAMPLE[1:])}
            yield record_batch(schema, len(taken), {"output": ["frame"] * len(taken), **own, "route_id": self.routes, "phase": self.phases})
        if self.changes:
            told = [c[3] or {} for c in self.changes]
            geometry = [c[3]["route"].values() if c[2] == "route_confirmed" else (None,) * 9 for c in self.changes]
            own = {"output": ["change"] * len(told), **{c: [x[0][k] for x in self.changes] for k, c in enumerate(KEY)}, "at_us": [c[1] for c in self.changes], "kind": [c[2] for c in self.changes]}
            own |= {"route_id": [route_id(c[0]) if c[3] else None for c in self.changes], **{c: [t.get(c) for t in told] for c in DETAILS}}
            own |= {c: [g[k] for g in geometry] for k, c in enumerate(columns_of(Route.SCHEMA))}
            yield record_batch(schema, len(told), own)
        self.clear()


_SAMPLES = pa.schema([*((c, pa.int64()) for c in (*KEY, "at_us")), ("second", pa.float64()), ("active", pa.bool_()), *((c, pa.float64()) for c in _SAMPLE[2:]), ("number", pa.int64())])


def process(samples: DataFrame, observed_until: Column | None = None, config: Engine = Engine()) -> DataFrame:
    """``RESULTS`` of one batch from the beginning: every change, and a frame for every accepted sample.

    Frames have route and phase from the confirming sample on, while the vehicle is not inactive and has a position.
    At the end deadlines count up to ``observed_until``, by default the newest sample of all streams.  One shuffle by stream;
    a stream's samples pass by in order of time, batch after batch, so no stream is too long.
    """
    rows = prepared(samples)
    until = rows.agg(F.max("at_us").alias("until_us")) if observed_until is None else samples.sparkSession.range(1).select(F.unix_micros(observed_until).alias("until_us"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, track, found, until_us = None, None, Gathered(config), None
        for batch in batches:
            rows, stirs = values_of(batch), stirring(batch, config)
            for own, first, end in runs(batch):
                if own != key:
                    if track is not None:
                        found.tell(key, track.pass_deadlines(until_us, config))
                    key, track, until_us = own, Track(), batch.column("until_us")[first].as_py()
                found.take(key, track, rows, first, end, stirs)
            yield from found.batches(batch)
        if track is not None:
            found.tell(key, track.pass_deadlines(until_us, config))
            yield from found.batches(None)

    return in_time(rows.crossJoin(F.broadcast(until))).mapInArrow(run, RESULTS)  # one row


def changes_of(found: DataFrame) -> DataFrame:
    """The changes among results."""
    return found.where("output = 'change'").select(F.timestamp_micros("at_us").alias("change_time"), "kind", *KEY, "route_id", *DETAILS)


def frames_of(found: DataFrame) -> DataFrame:
    """The frames among results."""
    return found.where("output = 'frame'").select(F.timestamp_micros("at_us").alias("sample_time"), *KEY, "active", "latitude_deg", "longitude_deg", "velocity_east_mps", "velocity_north_mps", "reliability", "route_id", "phase")


#: What a bucket holds of each of its streams, whether it moves or not: a row of arrays, one place a stream.
_LAST = "server_id long, vehicle_identifier long, last_us long, active boolean, passed int, last_look double, candidate boolean, rival_look double, confirmed boolean, points int"


class TrackProcessor(StatefulProcessor):
    """The steps of the streams of a bucket over Spark's state store.

    Calls and state requests cost much more than the steps of a sample, so that a call takes the samples of all streams of a
    bucket.  The last samples of its streams are one value; history, confirmed route and watched samples of a stream are
    entries of maps that are read and written only where the stream moves.  The deadline that comes first is the
    bucket's event-time timer; expiry drops history and route.
    """

    def __init__(self, config: Engine) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = "server_id long, vehicle_identifier long"
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"{c.strip().split(' ')[0]} array<{c.strip().split(' ')[1]}>" for c in _LAST.split(",")))
        # samples by column, as bytes: lists of numbers are encoded one by one on their way to the store
        self.history = handle.getMapState("history", key, "samples binary")
        self.route = handle.getMapState("route", key, Route.SCHEMA)
        self.watched = handle.getMapState("watched", key, "time array<double>, lat array<double>, lon array<double>, ve array<double>, vn array<double>, off array<boolean>")

    def _track(self, key: tuple, held: tuple) -> Track:
        last_us, active, passed, look, candidate, rival, confirmed, points = held
        route = Route.of(*self.route.getValue(key)) if confirmed else None
        rows = np.frombuffer(self.history.getValue(key)[0], "<f8").reshape(len(FIELDS), points).tolist() if points else [[] for _ in FIELDS]
        routes = RouteState(dict(zip(FIELDS, rows, strict=True)), last_us / 1e6, look, candidate, confirmed, route)
        if confirmed and self.config.detection.follow_changes and (watched := self.watched.getValue(key)) is not None:
            routes.watch(*watched, rival)
        return Track(last_us, active, passed, routes)

    def _stored(self, key: tuple, track: Track, before: tuple) -> tuple:
        """Write what the stream changed; what the bucket holds of it."""
        routes, (times, route, watching) = track.routes, before
        points = len(routes.history["time"])
        if routes.history["time"] != times:
            if points:
                self.history.updateValue(key, (np.array([routes.history[f] for f in FIELDS], "<f8").tobytes(),))
            else:
                self.history.removeKey(key)
        # a route that was lost and found again is another one
        if routes.route is not route:
            if routes.route is None:
                self.route.removeKey(key)
            else:
                self.route.updateValue(key, routes.route_values())
        if routes.recent_samples:
            self.watched.updateValue(key, routes.watch_values()[:-1])
        elif watching:
            self.watched.removeKey(key)
        return (track.last_us, track.active, track.passed, routes.last_look, routes.candidate, routes.rival_look, routes.route is not None, points)

    def _moved(self, frames: list[pd.DataFrame], until_us: int | None) -> pd.DataFrame:
        columns = self.last.get() if self.last.exists() else None
        held = {tuple(row[:2]): tuple(row[2:]) for row in zip(*columns, strict=True)} if columns else {}
        found, batch, waits = Gathered(self.config), None, deadlines(self.config)

        def move(key: tuple, step: Callable[[Track], None]) -> None:
            track = self._track(key, held[key]) if key in held else Track()
            routes = track.routes
            before = (list(routes.history["time"]), routes.route, bool(routes.recent_samples))
            step(track)
            held[key] = self._stored(key, track, before)

        if frames:
            rows = pa.Table.from_batches([pa.RecordBatch.from_pandas(pdf[_SAMPLES.names], schema=_SAMPLES, preserve_index=False) for pdf in frames])
            batch = rows.sort_by([(c, "ascending") for c in (*KEY, "at_us", "number")]).combine_chunks().to_batches()[0]  # without a number last
            values, stirs = values_of(batch), stirring(batch, self.config)
            for key, first, end in runs(batch):
                move(key, lambda track: found.take(key, track, values, first, end, stirs))  # noqa: B023
        if until_us is not None:
            for key, (last_us, _, passed, *_) in list(held.items()):
                if passed < len(waits) and last_us + waits[passed][0] <= until_us:
                    move(key, lambda track: found.tell(key, track.pass_deadlines(until_us, self.config)))  # noqa: B023
        self.last.update(tuple(list(c) for c in zip(*((*key, *row) for key, row in held.items()), strict=True)))
        self._timed([last_us + waits[passed][0] for last_us, _, passed, *_ in held.values() if passed < len(waits)])
        return pa.Table.from_batches(found.batches(batch), schema=_RESULTS).to_pandas()

    def _timed(self, due_us: list[int]) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if due_us:
            self.handle.registerTimer(-(min(due_us) // -1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._moved(list(rows), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._moved([], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def stream_process(samples: DataFrame, config: Engine = Engine(), late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """``RESULTS`` from a streaming DataFrame: changes and frames of one stateful operator.

    A sample counts if it is after the last one of its stream; Spark drops those ``late`` or more behind the newest
    sample of all streams, so ``late`` has to cover the largest lag of a stream, and deadlines of silent streams are
    noticed as much later (stamped with the deadline all the same).  :class:`wayring.streaming.session.Session` keeps lagging streams without such a bound.
    The state of a stream without a route is bounded by ``Detection.history_points``; expiry drops it.  Streams are dealt to
    ``buckets``, whose number stays as long as a checkpoint; a bucket's samples of one micro-batch are held by one task at a time.
    """
    # map states, timers and single keys of large states need this state store, whatever the session was built with
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    timed = samples.where("sample_time is not null").withColumn("sample_time", F.col("sample_time").cast("timestamp")).withWatermark("sample_time", late)
    keyed = prepared(timed).withColumn("bucket", F.pmod(F.hash(*KEY), F.lit(buckets))).groupBy("bucket")
    return keyed.transformWithStateInPandas(statefulProcessor=TrackProcessor(config), outputStructType=RESULTS, outputMode="Append", timeMode="EventTime")


def stream_route_changes(samples: DataFrame, detection: Detection = Detection(), late: str = "0 seconds") -> DataFrame:
    """Route candidates and confirmations from a streaming DataFrame, as :func:`route_changes` gives them."""
    found = stream_process(samples, Engine(detection=detection), late).where("kind in ('route_candidate', 'route_confirmed')")
    return found.select(*KEY, (F.col("at_us") / 1e6).alias("change_s"), "kind", "route_id", *DETAILS)


def stream_state_changes(samples: DataFrame, no_data_seconds: int = Timing().no_data_seconds, expire_seconds: int = Grouping().hold_seconds, late: str = "0 seconds", ties: tuple[str, ...] = ()) -> DataFrame:
    """``change_time, kind, server_id, vehicle_identifier`` from a streaming DataFrame, stamped as in the batch form.

    Deadlines of loss and expiry are event-time timers: they fire, in whole milliseconds, when the watermark of all
    streams (the newest sample less ``late``) reaches them; the watermark never goes back.  Samples without a time, at
    or before the watermark, or not after the last one of their stream are late and change nothing; of one time the
    first by ``ties`` counts within a micro-batch.  A stream's state is its last sample and the deadlines passed.
    """
    waits = sorted([(no_data_seconds * 1_000_000, "data_lost"), (expire_seconds * 1_000_000, "vehicle_expired")])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, active, passed = state.get if state.exists else (None, None, 0)
        out: list[tuple] = []

        def pass_deadlines(until: int) -> None:
            nonlocal passed
            while last is not None and passed < len(waits) and last + waits[passed][0] <= until:
                out.append((*key, last + waits[passed][0], waits[passed][1]))
                passed += 1

        rows = [pdf for pdf in frames if len(pdf)]
        if rows:
            pdf = pd.concat(rows, ignore_index=True).sort_values(["at_us", *ties], kind="stable")
            for at, now in zip(pdf["at_us"].tolist(), pdf["active"].astype(object).where(pdf["active"].notna(), None), strict=True):
                if last is not None and at <= last:
                    continue
                pass_deadlines(at)
                if last is not None and last + no_data_seconds * 1_000_000 <= at:
                    out.append((*key, at, "data_resumed"))
                if now and not active:
                    out.append((*key, at, "vehicle_activated"))
                elif now is False and active:
                    out.append((*key, at, "vehicle_deactivated"))
                last, active, passed = at, None if now is None else bool(now), 0
        watermark_ms = state.getCurrentWatermarkMs()
        pass_deadlines(watermark_ms * 1000)
        state.update((last, active, passed))
        if passed < len(waits):
            deadline_ms = -((last + waits[passed][0]) // -1000)
            state.setTimeoutTimestamp(max(deadline_ms - 1, watermark_ms))  # fires once the watermark is beyond it
        yield pd.DataFrame(out, columns=columns_of(STATE_CHANGES))

    timed = samples.where("sample_time is not null").select(*KEY, F.col("sample_time").cast("timestamp").alias("sample_time"), "active", *ties)
    keyed = timed.withWatermark("sample_time", late).withColumn("at_us", F.unix_micros("sample_time")).groupBy(*KEY)
    found = keyed.applyInPandasWithState(run, STATE_CHANGES, "last long, active boolean, passed int", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.timestamp_micros("at_us").alias("change_time"), "kind", *KEY)


def stream_first_samples(samples: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each set of keys in a stream; state is dropped once the watermark has passed."""
    return samples.withWatermark("sample_time", late).dropDuplicatesWithinWatermark(keys)
