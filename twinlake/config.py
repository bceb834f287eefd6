"""Thresholds and weights of the matching rules."""

from __future__ import annotations

import json
from collections.abc import Collection
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Thresholds:
    """Limits of one sensitivity."""

    hash_accept: int
    hash_reject: int
    histogram_accept: float
    strong_histogram: float
    colour_led_hash: int
    histogram_floor: float
    shape_accept: float
    neighbour_accept: float
    video_hash_accept: int
    aspect_tolerance: float


# The rules' limits at each sensitivity.
EXACT = Thresholds(4, 10, 0.97, 0.993, 8, 0.95, 0.98, 0.985, 3, 0.06)
STRICT = Thresholds(12, 20, 0.90, 0.985, 14, 0.78, 0.94, 0.96, 8, 0.06)
SIMILAR = Thresholds(16, 26, 0.84, 0.985, 15, 0.68, 0.92, 0.96, 14, 0.30)
LEVELS = {"exact": EXACT, "strict": STRICT, "similar": SIMILAR}
#: Pairs that were not taken at one moment are never held to less than strict.
ANYTIME = {"exact": EXACT, "strict": STRICT, "similar": STRICT}

# Limits that hold at every sensitivity.
LUMA_TOLERANCE = 0.12
NEIGHBOUR_ASPECT = 0.06
SAME_MOMENT_S = 180
BURST_GAP_S = 10
DARK, BRIGHT = 0.03, 0.97
DEGENERATE_HISTOGRAM, DEGENERATE_CONFIDENCE = 0.98, 0.95
SHAPE_COPY = 0.995
NEIGHBOUR_LIMIT, NEIGHBOUR_FLOOR = 12, 0.96
MAX_GROUP = 60
SCREENSHOT_HASH, SCREENSHOT_HISTOGRAM = 6, 0.94
MODEL_CONFIDENCE, MOMENT_CONFIDENCE, DEFAULT_CONFIDENCE = 0.85, 0.80, 0.8
KEYFRAMES, DURATION_S, DURATION_SHARE = 5, 1.0, 0.05
UNCHANGED_S = 0.5
FACE_BUDGET, FACE_CONTENDERS, SHARPNESS_SPREAD = 400, 3, 0.15
NEAR_VERSION, STORE_VERSION = 1, 2

# Weights of the quality score.
WEIGHTS = {"sharpness": 3.0, "resolution": 2.5, "faces": 2.0, "exposure": 1.2, "bytes": 0.8}
BONUS = {"favourite": 5.0, "edited": 1.2, "live": 0.8, "hdr": 0.8, "screenshot": -1.5}

# Codes of the media kinds.
PHOTO, SCREENSHOT, LIVE, VIDEO = 0, 1, 2, 3
KIND_NAMES = ("photo", "screenshot", "livePhoto", "video")


def all_kinds(kinds: Collection[int]) -> bool:
    """Whether a scan of these kinds sees every asset."""
    return set(kinds) >= {PHOTO, SCREENSHOT, LIVE, VIDEO}


@dataclass(frozen=True)
class ScanSettings:
    """What a scan looks for; kept as JSON beside its results."""

    sensitivity: str = "strict"
    kinds: tuple[int, ...] = (PHOTO, SCREENSHOT, LIVE, VIDEO)
    folder: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.sensitivity not in LEVELS:
            raise ValueError(f"no such sensitivity: {self.sensitivity}")
        if not self.kinds:
            raise ValueError("at least one kind is needed")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ScanSettings:
        said = json.loads(text)
        return cls(**said | {"kinds": tuple(said["kinds"])})

    def stale(self, stored: str) -> bool:
        """Whether results made under stored settings no longer answer these."""
        return self != ScanSettings.from_json(stored)

    def all_kinds(self) -> bool:
        return all_kinds(self.kinds)
