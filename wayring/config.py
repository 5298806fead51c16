"""Versioned settings whose values are part of the query semantics."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Band:
    """Errors up to ``full`` score 100, from ``zero`` on 0, in between linearly."""

    full: float
    zero: float

    def __post_init__(self) -> None:
        if self.full < 0 or self.zero <= self.full:
            raise ValueError("a band needs 0 <= full < zero")


def shares(weights: tuple[float, ...]) -> tuple[float, ...]:
    """Weights that add up to 1."""
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must not be negative and one must be positive")
    return tuple(w / sum(weights) for w in weights)


# The approved defaults.
@dataclass(frozen=True)
class Scoring:
    sync_weights: tuple[float, float, float] = (60.0, 20.0, 20.0)
    route_weights: tuple[float, float, float] = (15.0, 70.0, 15.0)
    total_weights: tuple[float, float] = (75.0, 25.0)
    si_position: Band = Band(10.0, 30.0)
    so_position: Band = Band(0.05, 0.25)
    period: Band = Band(0.05, 0.20)
    movement: Band = Band(0.10, 0.30)
    distance: Band = Band(0.05, 0.30)
    tangent: Band = Band(10.0, 60.0)
    curvature: Band = Band(0.10, 1.00)
    least_speed_fraction: float = 0.30
    least_reliability: float = 0.60
    wrong_direction_seconds: int = 60
    smoothing_seconds: int = 10
    good_from: float = 80.0
    low_below: float = 50.0
    alert_open_seconds: int = 10
    alert_recovery_score: float = 60.0
    alert_recovery_seconds: int = 20


@dataclass(frozen=True)
class Detection:
    si_axis_ratio: float = 1.5
    point_limit: int = 64
    confirm_seconds: int = 300
    candidate_seconds: int = 60
    least_fit: float = 0.70
    least_cycles: int = 1
    closure_axis_ratio: float = 0.20
    closure_heading_deg: float = 30.0
    closure_phase: float = 0.80
    smoothing_seconds: int = 3
    least_samples: int = 12
    # samples of a stream without a route that are kept and looked at; None keeps them all
    history_points: int | None = 3600
    # whether confirmed routes are watched for changes of so much, which have to hold so long
    follow_changes: bool = False
    change_ratio: float = 0.20
    change_seconds: int = 120


@dataclass(frozen=True)
class Grouping:
    confirm_seconds: int = 120
    hold_seconds: int = 300
    identity_fraction: float = 0.60
    si_center_ratio: float = 0.30
    si_period_ratio: float = 0.20
    so_period_ratio: float = 0.20
    finalize_seconds: int = 120
    run_seconds: int = 20
    exit_seconds: int = 300


@dataclass(frozen=True)
class Timing:
    grid_seconds: int = 1
    batch_seconds: int = 5
    no_data_seconds: int = 20


@dataclass(frozen=True)
class Join:
    """Temporal join: grid, tolerance on either side, reliabilities and the spellings of active."""

    grid_seconds: int = 1
    tolerance_seconds: int = 5
    original: float = 1.0
    approximated: float = 0.75
    on_values: tuple[str, ...] = ("true", "1", "on", "green", "active")
    off_values: tuple[str, ...] = ("false", "0", "off", "red", "inactive")

    def __post_init__(self) -> None:
        if self.grid_seconds <= 0 or self.tolerance_seconds <= 0:
            raise ValueError("grid and tolerance must be positive")
        if not (0 <= self.original <= 1 and 0 <= self.approximated <= 1):
            raise ValueError("reliabilities must lie in 0..1")


@dataclass(frozen=True)
class Engine:
    schema_version: int = 1
    scoring: Scoring = field(default_factory=Scoring)
    detection: Detection = field(default_factory=Detection)
    grouping: Grouping = field(default_factory=Grouping)
    timing: Timing = field(default_factory=Timing)
    join: Join = field(default_factory=Join)

    def to_json(self) -> str:
        """Canonical JSON: sorted keys, no spaces."""
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> "Engine":
        raw = json.loads(text)
        parts = {"scoring": Scoring, "detection": Detection, "grouping": Grouping, "timing": Timing, "join": Join}
        for name, kind in parts.items():
            if name in raw:
                raw[name] = kind(**{k: Band(**v) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in raw[name].items()})
        return cls(**raw)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()
