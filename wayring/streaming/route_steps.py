"""The per-stream step of the route lifecycle, shared by its batch and streaming forms.

A stream's samples arrive in time order and the detector is asked at most every few seconds of event time, so
this part is stateful per stream; the newest ``Detection.history_points`` samples of one stream's unconfirmed
history are all it holds and looks at, so that neither state nor work grows with the history.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property
from operator import itemgetter
from typing import ClassVar

import numpy as np

from wayring.config import Detection, Grouping, Timing
from wayring.functions.geo import EARTH_RADIUS_M, EPSILON

FIELDS = ("time", "lat", "lon", "ve", "vn")


def _segments(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = np.empty_like(p)
    d[:-1], d[-1] = p[1:] - p[:-1], p[0] - p[-1]
    n = np.hypot(d[:, 0], d[:, 1])
    return d, n, np.concatenate([[0.0], np.cumsum(n)[:-1]])


def _median(values: np.ndarray) -> float:
    line = np.sort(values)
    return (line[(len(line) - 1) // 2] + line[len(line) // 2]) / 2.0


def _half_range(values: np.ndarray) -> float:
    """Half the way between the quantiles 0.05 and 0.95, interpolated as numpy does; one sort instead of two calls."""
    line, ends = np.sort(values), []
    for share in (0.05, 0.95):
        at = share * (len(line) - 1)
        k = min(int(at), len(line) - 2)
        low, step, t = line[k], line[k + 1] - line[k], at - k
        ends.append(low + step * t if t < 0.5 else line[k + 1] - step * (1 - t))
    return (ends[1] - ends[0]) / 2.0


def _outline(center: np.ndarray, a: float, b: float, turn: float, si: bool) -> np.ndarray:
    if si:
        angle = 2.0 * math.pi * np.arange(64) / 64.0
        along, across = a * np.cos(angle), b * np.sin(angle)
    else:
        half, bend, line = max(a - b, 0.0), math.pi * np.arange(24) / 23.0, np.arange(1, 9) / 9.0
        along = np.concatenate([half + b * np.cos(bend - math.pi / 2), half * (1 - 2 * line), -half + b * np.cos(bend + math.pi / 2), -half * (1 - 2 * line)])
        across = np.concatenate([b * np.sin(bend - math.pi / 2), np.full(8, b), b * np.sin(bend + math.pi / 2), np.full(8, -b)])
    return np.stack([center[0] + along * math.cos(turn) - across * math.sin(turn), center[1] + along * math.sin(turn) + across * math.cos(turn)], axis=1)


def _ways(x: np.ndarray, y: np.ndarray, apart: int) -> np.ndarray:
    dx, dy = x[apart:] - x[:-apart], y[apart:] - y[:-apart]
    return np.sqrt(dx * dx + dy * dy)


def _distances(poly: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance from a closed polyline alone, of so few points at a time that they stay in a processor's cache."""
    d, n, _ = _segments(poly)
    (px, py), (dx, dy), size, out = poly.T.copy(), d.T.copy(), n * n, np.empty(len(x))
    for at in range(0, len(x), 128):
        ex, ey = x[at : at + 128, None] - px, y[at : at + 128, None] - py
        share = (ex * dx + ey * dy) / size
        np.clip(share, 0.0, 1.0, out=share)
        ex -= dx * share
        ey -= dy * share
        ex *= ex
        ey *= ey
        ex += ey
        out[at : at + 128] = np.sqrt(ex.min(axis=1))
    return out


def polyline(center: np.ndarray, a: float, b: float, turn: float, si: bool, cfg: Detection) -> np.ndarray:
    """``point_limit`` points of the outline, 64 at most, at equal arc length."""
    raw = _outline(center, a, b, turn, si)
    d, n, before = _segments(raw)
    target = np.arange(min(cfg.point_limit, 64)) / min(cfg.point_limit, 64) * n.sum()
    k = np.minimum(np.searchsorted(before + n, target, "right"), len(n) - 1)
    return raw[k] + d[k] * np.clip((target - before[k]) / n[k], 0, 1)[:, None]


def period_of(speed: np.ndarray, step: np.ndarray, t: np.ndarray, length: float, cycles: float) -> float:
    """The length over the median of reported speeds, else of derived ones, else the time per cycle."""
    speed = speed[np.isfinite(speed) & (speed > EPSILON)]
    if not len(speed):
        dt = np.diff(t)
        speed = step[dt > 0] / dt[dt > 0]
        speed = speed[speed > EPSILON]
    return length / _median(speed) if len(speed) else (t[-1] - t[0]) / max(cycles, EPSILON)


def detect(rows: dict[str, np.ndarray], seconds: float, cfg: Detection = Detection()) -> dict | None:
    """The effective route of one stream's active, positioned samples in time order, or None."""
    t = rows["time"]
    if len(t) < cfg.least_samples or t[-1] - t[0] + EPSILON < seconds:
        return None
    lat0, lon0 = _median(rows["lat"]), _median(rows["lon"])
    x, y = np.radians(rows["lon"] - lon0) * (EARTH_RADIUS_M * math.cos(math.radians(lat0))), np.radians(rows["lat"] - lat0) * EARTH_RADIUS_M
    step, keep = _ways(x, y, 1), None
    moved = step[step > EPSILON]
    if len(moved):
        usual = _median(moved)
        wide = step > max(4.0 * usual, 1.0)
        inner = wide[:-1] & wide[1:]
        # few points lie far from both neighbours, and only for these it is asked how far apart the neighbours are
        if inner.any():
            at = np.flatnonzero(inner)
            at = at[np.hypot(x[at + 2] - x[at], y[at + 2] - y[at]) <= max(2.5 * usual, 1.5)]
            if len(at):
                keep = np.ones(len(x), bool)
                keep[at + 1] = False
                x, y = x[keep], y[keep]
                step = _ways(x, y, 1)
    n = len(x)
    if n < cfg.least_samples:
        return None
    center = np.array([_median(x), _median(y)])
    dx, dy = x - center[0], y - center[1]
    xx, yy, xy = (float(np.add.reduce(v)) / n for v in (dx * dx, dy * dy, dx * dy))
    turn = 0.5 * math.atan2(2.0 * xy, xx - yy)
    cos, sin = math.cos(turn), math.sin(turn)
    a, b = max(_half_range(dx * cos + dy * sin), EPSILON), max(_half_range(dy * cos - dx * sin), EPSILON)
    if b > a:
        a, b, turn = b, a, turn + math.pi / 2
    if b <= EPSILON:
        return None
    si = a / b <= cfg.si_axis_ratio
    near = max(b * cfg.closure_axis_ratio, 1.0)
    way = np.empty(n)
    way[0] = 0.0
    np.cumsum(step, out=way[1:])
    ex, ey = x - x[0], y - y[0]
    back = ex * ex + ey * ey <= near * near
    back[0] = False
    # a line of sixteen points or more about both ends is longer than three half axes: without a return no shape is drawn
    if cfg.point_limit >= 16 and not (back & (way >= 3.0 * a * cfg.closure_phase)).any():
        return None
    poly = polyline(center, a, b, turn, si, cfg)
    length = _segments(poly)[1].sum()
    cycles = way[-1] / length
    he, hn = np.empty(n), np.empty(n)
    for h, v in ((he, x), (hn, y)):
        h[1:-1], h[0], h[-1] = v[2:] - v[:-2], v[1] - v[0], v[-1] - v[-2]
    size = np.sqrt(he * he + hn * hn)
    with np.errstate(invalid="ignore", divide="ignore"):
        angle = np.degrees(np.arccos(np.clip((he * he[0] + hn * hn[0]) / (size * size[0]), -1, 1)))
    aligned = (size <= EPSILON) | (size[0] <= EPSILON) | (angle <= cfg.closure_heading_deg)
    closes = (way >= length * cfg.closure_phase) & back & aligned
    if cycles + EPSILON < cfg.closure_phase or cycles + EPSILON < cfg.least_cycles or not closes.any():
        return None
    # the dearest gate comes last: streams that close no route never pay for it
    fit = float(np.count_nonzero(_distances(poly, x, y) <= near)) / n
    if fit + EPSILON < cfg.least_fit:
        return None
    speed = np.hypot(rows["ve"], rows["vn"])
    period = period_of(speed if keep is None else speed[keep], step, t if keep is None else t[keep], length, cycles)
    area = (dx[:-1] * dy[1:] - dy[:-1] * dx[1:]).sum()
    way_round = "unknown" if abs(area) <= EPSILON else "counterclockwise" if area > 0 else "clockwise"
    quality = min(1.0, max(0.0, 0.55 * fit + 0.30 * (n / len(t)) + 0.15 * min(1.0, cycles)))
    lat, lon = lat0 + math.degrees(center[1] / EARTH_RADIUS_M), lon0 + math.degrees(center[0] / (EARTH_RADIUS_M * math.cos(math.radians(lat0))))
    told = {"family": "si" if si else "so", "subtype": "compact" if si else "hippodrome", "direction": way_round, "period_s": float(period), "quality": float(quality), "fit_fraction": float(fit), "cycles": float(cycles), "length_m": float(length)}
    # what is not told by changes: the shape about the median place, and how far the kept samples went
    told |= {"origin": (float(lat0), float(lon0)), "shape": (float(center[0]), float(center[1]), float(a), float(b), float(turn)), "kept": n, "travelled_m": float(way[-1])}
    return told | {"route": Route(float(lat), float(lon), poly[:, 0].tolist(), poly[:, 1].tolist(), float(near), float(length), float(period), float(fit), float(b))}


def project(poly: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and phase of the nearest place on a closed polyline for each point; the least segment on ties."""
    return _projected(poly, _segments(poly), points)


def _projected(poly: np.ndarray, segments: tuple[np.ndarray, np.ndarray, np.ndarray], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, n, before = segments
    share = np.clip(((points[:, None, 0] - poly[:, 0]) * d[:, 0] + (points[:, None, 1] - poly[:, 1]) * d[:, 1]) / (n * n), 0, 1)
    off = np.hypot(points[:, None, 0] - (poly[:, 0] + d[:, 0] * share), points[:, None, 1] - (poly[:, 1] + d[:, 1] * share))
    k = off.argmin(axis=1)
    rows = np.arange(len(points))
    return off[rows, k], (before[k] + n[k] * share[rows, k]) / n.sum() % 1.0


@dataclass(frozen=True)
class Route:
    """A confirmed route as frames need it: the centre, and the polyline in metres; and what changes are measured by."""

    lat: float
    lon: float
    x: list[float]
    y: list[float]
    near_m: float
    length_m: float
    period_s: float
    fit: float
    short_m: float

    SCHEMA: ClassVar[str] = "route_lat double, route_lon double, route_x array<double>, route_y array<double>, route_near_m double, route_length_m double, route_period_s double, route_fit double, route_short_m double"

    @classmethod
    def of(cls, lat, lon, x, y, near_m, length_m, period_s, fit, short_m) -> Route | None:  # noqa: PLR0913
        """From the values of ``SCHEMA``; without a polyline there is no route."""
        return None if x is None else cls(float(lat), float(lon), [float(v) for v in x], [float(v) for v in y], float(near_m), float(length_m), float(period_s), float(fit), float(short_m))

    def local(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Metres from the centre, from which positions are projected, as surveyed."""
        east = np.radians(lon - self.lon) * EARTH_RADIUS_M * math.cos(math.radians(self.lat))
        return np.stack([east, np.radians(lat - self.lat) * EARTH_RADIUS_M], axis=1)

    def values(self) -> tuple:
        """The values of ``SCHEMA``."""
        return (self.lat, self.lon, self.x, self.y, self.near_m, self.length_m, self.period_s, self.fit, self.short_m)

    @cached_property
    def _line(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        poly = np.stack([self.x, self.y], axis=1)
        return poly, _segments(poly)

    def phases(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        points, out = self.local(lat, lon), np.empty(len(lat))
        for at in range(0, len(lat), 128):
            out[at : at + 128] = _projected(*self._line, points[at : at + 128])[1]
        return out

    def departs(self, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray, ratio: float) -> np.ndarray:
        """Whether samples lie beside the route, or their speed makes another period of it."""
        off = _projected(*self._line, self.local(lat, lon))[0] > self.near_m
        with np.errstate(invalid="ignore", divide="ignore"):
            period = self.length_m / speed
        return off | (np.isfinite(period) & (np.abs(period / self.period_s - 1.0) > ratio))


@dataclass
class RouteState:
    """What a stream carries from sample to sample; the history goes once a route is confirmed."""

    history: dict[str, list[float]] = field(default_factory=lambda: {f: [] for f in FIELDS})
    last_time: float = -math.inf
    last_look: float = -math.inf
    candidate: bool = False
    confirmed: bool = False
    route: Route | None = None
    #: Newest samples of a watched route (time, lat, lon, ve, vn, whether it departs), and when a rival came up.
    recent_samples: list[list] = field(default_factory=list)
    rival_look: float | None = None

    WATCH_SCHEMA: ClassVar[str] = "watch_time array<double>, watch_lat array<double>, watch_lon array<double>, watch_ve array<double>, watch_vn array<double>, watch_off array<boolean>, rival_look double"

    def route_values(self) -> tuple:
        """The values of ``Route.SCHEMA``."""
        return (None,) * 9 if self.route is None else self.route.values()

    def watch_values(self) -> tuple:
        """The values of ``WATCH_SCHEMA``."""
        return (*([r[k] for r in self.recent_samples] for k in range(6)), self.rival_look)

    def watch(self, time, lat, lon, ve, vn, off, look) -> None:  # noqa: PLR0913
        """Take up the values of ``WATCH_SCHEMA``."""
        self.recent_samples = [[float(a), float(b), float(c), float(d), float(e), None if f is None else bool(f)] for a, b, c, d, e, f in zip(time, lat, lon, ve, vn, off, strict=True)] if time is not None else []
        self.rival_look = None if look is None or math.isnan(look) else float(look)

    def forget(self) -> None:
        self.recent_samples, self.rival_look = [], None
        self.history, self.last_look, self.candidate, self.confirmed, self.route = {f: [] for f in FIELDS}, -math.inf, False, False, None

    def recent(self, most: int | None) -> dict[str, np.ndarray]:
        """The newest ``most`` usable samples, all of them for None; older ones are dropped now and then."""
        size = len(self.history["time"])
        if most is not None and size > most + most // 4:
            self.history = {k: v[-most:] for k, v in self.history.items()}
        return {k: np.array(v[-most:] if most else v) for k, v in self.history.items()}


def advance(state: RouteState, sample: tuple, detection: Detection = Detection(), timing: Timing = Timing(), grouping: Grouping = Grouping()) -> list[tuple[float, str, dict]]:
    """Take one sample (time, active, lat, lon, ve, vn, reliability); route changes that follow from it.

    Samples not after the last one are late and change nothing.  Expiry and inactivity forget the route.
    """
    time, active, lat, lon, ve, vn, reliability = sample
    if time <= state.last_time:
        return []
    if time - state.last_time >= grouping.hold_seconds:
        state.forget()
    state.last_time = time
    if active is False:
        state.forget()
        return []
    if lat is None or lon is None or (state.confirmed and not detection.follow_changes):
        return []
    if state.confirmed:
        return _followed(state, (time, lat, lon, ve, vn), detection, timing) if reliability is not None and reliability > 0 else []
    if reliability is not None and reliability > 0:
        for name, value in zip(FIELDS, (time, lat, lon, math.nan if ve is None else ve, math.nan if vn is None else vn), strict=True):
            state.history[name].append(value)
    return look(state, time, detection) if time - state.last_look >= timing.batch_seconds else []


def look(state: RouteState, time: float, detection: Detection) -> list[tuple[float, str, dict]]:
    """Look for a route in the history of a stream that has none, at the time of its last sample."""
    state.last_look = time
    # nothing is built for a look that is too short to tell anything, and a shape is looked for once
    times, most = state.history["time"], detection.history_points
    span = times[-1] - times[max(0, len(times) - most) if most else 0] + EPSILON if times else -math.inf
    least = detection.confirm_seconds if state.candidate else min(detection.candidate_seconds, detection.confirm_seconds)
    rows = state.recent(most) if span >= least or (most and len(times) > most + most // 4) else None
    found = detect(rows, least, detection) if rows is not None and span >= least else None
    out = []
    if found and not state.candidate and span >= detection.candidate_seconds:
        state.candidate = True
        out.append((time, "route_candidate", found))
    if found and span >= detection.confirm_seconds:
        state.candidate = state.confirmed = True
        state.route = found["route"]
        state.history = {f: [] for f in FIELDS}
        out.append((time, "route_confirmed", found))
    return out


def _followed(state: RouteState, sample: tuple, detection: Detection, timing: Timing) -> list[tuple[float, str, dict]]:
    """Hold a confirmed route against a rival: that the stream has left it.

    A sample departs if it lies beside the route or its speed makes another period of it.  At a look the route holds if
    in the last cycle about as many samples fit as when it was confirmed.  Where it does not, a rival comes up; if it
    lasts, the change is told as of its beginning, and what came since is the history of a new route; else it is
    cancelled.  The beginning is where departing samples less others, added up to the present, are the most.
    """
    time, lat, lon, ve, vn = sample
    route = state.route
    state.recent_samples.append([time, lat, lon, math.nan if ve is None else ve, math.nan if vn is None else vn, None])
    if time - state.last_look < timing.batch_seconds:
        return []
    state.last_look = time
    judged = len(state.recent_samples)
    while judged and state.recent_samples[judged - 1][5] is None:
        judged -= 1
    new = state.recent_samples[judged:]
    values = np.array([r[:5] for r in new], float)
    for row, off in zip(new, route.departs(values[:, 1], values[:, 2], np.hypot(values[:, 3], values[:, 4]), detection.change_ratio).tolist(), strict=True):
        row[5] = off
    if state.recent_samples[0][0] - (time - route.period_s) > timing.batch_seconds:
        return []  # no whole cycle yet
    window = [r[5] for r in state.recent_samples[bisect_right(state.recent_samples, time - route.period_s, key=itemgetter(0)) :]]
    out: list[tuple[float, str, dict]] = []
    told = {"period_s": route.period_s}
    if 1.0 - sum(window) / len(window) + EPSILON >= detection.least_fit * route.fit:
        if state.rival_look is not None:
            out.append((time, "route_change_cancelled", told))
        state.rival_look = None
    elif state.rival_look is None:
        state.rival_look = time
        out.append((time, "route_change_candidate", told))
    elif time - state.rival_look >= detection.change_seconds:
        weight = np.cumsum([1 if r[5] else -1 for r in reversed(state.recent_samples)])
        since = state.recent_samples[len(weight) - 1 - int(weight.argmax()) :]
        out.append((since[0][0], "route_changed", told))
        state.forget()
        state.last_look = time
        state.history = {f: [r[k] for r in since] for k, f in enumerate(FIELDS)}
        return out
    first = (time if state.rival_look is None else state.rival_look) - route.period_s
    state.recent_samples = state.recent_samples[bisect_right(state.recent_samples, first, key=itemgetter(0)) :][-(detection.history_points or 0) :]
    return out
