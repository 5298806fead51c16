"""Calm samples are taken by stretches: the same results and states as one sample after the other, in fewer steps."""

import numpy as np
import pyarrow as pa
import pytest
from test_sessions import circle

from wayring.config import Detection, Engine
from wayring.streaming import lifecycle, session
from wayring.streaming import route_steps as steps

START = 1_767_225_600


def _batches(most: int) -> list[pa.RecordBatch]:
    """Circles with gaps, silences, stops, repeated times, missing places, speeds and reliabilities, cut at will."""
    rng, rows = np.random.default_rng(11), []
    for v in range(12):
        for t, lat, lon, ve, vn in circle(700, period=80.0 + 5 * v, bend=450 if v % 3 == 0 else None):
            if (v % 4 == 1 and 150 <= t < 190) or (v % 6 == 5 and 200 <= t < 520):
                continue
            kind = rng.integers(60) if v % 2 else 59
            at = t - 1 if kind == 0 else t
            rows.append((1, v, int((START + at) * 1e6), START + at, (not (v % 5 == 4 and 380 <= t < 400)) if kind != 1 else None, None if kind == 2 else float("nan") if kind == 3 else lat, lon, None if kind == 4 else ve, vn, None if kind == 5 else 0.0 if kind == 6 else 1.0, v))
    whole = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), lifecycle._SAMPLES, strict=True)], schema=lifecycle._SAMPLES)
    return [whole.slice(at, most) for at in range(0, len(whole), most)]


def _run(batches, config, calm):
    tracks, found, out = {}, lifecycle.Gathered(config), []
    for batch in batches:
        rows, stirs = lifecycle.values_of(batch), lifecycle.stirring(batch, config) if calm else None
        for key, first, end in lifecycle.runs(batch):
            found.take(key, tracks.setdefault(key, lifecycle.Track()), rows, first, end, stirs)
        out += [row for part in found.batches(batch) for row in part.to_pylist()]
    return out, [repr(session.stored(t)) for t in tracks.values()]


@pytest.mark.parametrize("detection", [Detection(), Detection(follow_changes=True), Detection(history_points=90), Detection(confirm_seconds=30, candidate_seconds=30)])
@pytest.mark.parametrize("most", [10_000, 53])
def test_stretches_give_what_single_samples_give(detection, most):
    config, batches = Engine(detection=detection), _batches(most)
    got, want = _run(batches, config, True), _run(batches, config, False)
    assert got == want and {r["output"] for r in got[0]} == {"change", "frame"} and any(r["kind"] == "route_candidate" for r in got[0])


def test_calm_samples_take_no_step_each(monkeypatch):
    steps_taken = []
    advance = steps.advance
    monkeypatch.setattr(lifecycle, "advance", lambda *a: steps_taken.append(1) or advance(*a))
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*((1, 1, int((START + t) * 1e6), START + t, True, lat, lon, ve, vn, 1.0, 1) for t, lat, lon, ve, vn in circle(361)), strict=True), lifecycle._SAMPLES, strict=True)], schema=lifecycle._SAMPLES)
    config = Engine()
    for stirs in (lifecycle.stirring(batch, config), None):
        track, found = lifecycle.Track(), lifecycle.Gathered(config)
        steps_taken.clear()
        found.take((1, 1), track, lifecycle.values_of(batch), 0, len(batch), stirs)
        assert track.routes.confirmed and len(found.frames) == 361 and len(steps_taken) == (361 if stirs is None else 1)
