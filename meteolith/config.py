"""Parameters of every layer, as frozen dataclasses; the values are the engine's documented defaults."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

VARIABLES = ("temp_c", "pressure_hpa", "rh_pct")
FAULT_CLASSES = ("none", "spike", "drop", "stuck", "drift", "step", "noise", "missing", "corrupt", "multivariate", "spatial", "genuine_extreme")
BENIGN = ("none", "genuine_extreme")


def per(t, p, h) -> dict:
    return dict(zip(VARIABLES, (t, p, h), strict=True))


@dataclass(frozen=True)
class Rules:
    low: dict = field(default_factory=lambda: per(-90.0, 500.0, 0.0))
    high: dict = field(default_factory=lambda: per(60.0, 1085.0, 100.0))
    rate: dict = field(default_factory=lambda: per(12.0, 12.0, 60.0))
    max_gap_h: float = 3.0
    min_gap_h: float = 0.25
    repeats: dict = field(default_factory=lambda: per(12, 24, 16))
    tolerance: dict = field(default_factory=lambda: per(0.05, 0.05, 0.5))
    saturated_rh: float = 97.0
    saturated_factor: float = 2.5
    sentinels: tuple = (999.0, -999.0, 9999.0, -9999.0, 99.9, -99.9, 32767.0)
    sentinel_tolerance: float = 1e-6
    interval_minutes: int | None = None


@dataclass(frozen=True)
class Model:
    window: int = 24
    hidden: int = 24
    learning_rate: float = 0.005
    batch: int = 32
    epochs: int = 60
    patience: int = 8
    clip: float = 5.0
    seed: int = 7
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8


@dataclass(frozen=True)
class Threshold:
    k: float = 4.0
    quantile: float = 0.995
    min_samples: int = 200
    min_bucket: int = 50
    steepness: float = 2.5


@dataclass(frozen=True)
class Multivariate:
    cut: float = 4.5
    min_samples: int = 100
    shrinkage: float = 0.05
    dew_tolerance: float = 1.0
    scale: float = 1.0


@dataclass(frozen=True)
class Spatial:
    neighbours: int = 6
    max_km: float = 250.0
    max_dz: float = 900.0
    least: int = 2
    lapse: float = 0.0065
    scale_km: float = 80.0
    scale_dz: float = 300.0
    min_spread: dict = field(default_factory=lambda: per(1.0, 0.8, 4.0))
    sigma: float = 3.5
    skew_minutes: int = 20
    scale: float = 1.0


@dataclass(frozen=True)
class Fusion:
    weights: dict = field(default_factory=lambda: {"rule": 1.0, "persistence": 0.85, "recon": 0.75, "multi": 0.65, "spatial": 0.80})
    hard_floor: float = 0.95
    damping: float = 0.35
    agree: float = 0.35
    coherence: float = 0.40
    bands: tuple = ((0.30, "NORMAL"), (0.60, "WATCH"), (0.80, "SUSPICIOUS"), (0.95, "HIGH"))
    top_band: str = "CRITICAL"
    decision: float = 0.50


@dataclass(frozen=True)
class Events:
    max_gap: int = 3
    min_points: int = 1


@dataclass(frozen=True)
class Health:
    window: int = 168
    weights: tuple = (40.0, 25.0, 20.0, 15.0)
    bands: tuple = ((40.0, "CRITICAL"), (60.0, "DEGRADING"), (80.0, "WARNING"))
    min_points: int = 48


@dataclass(frozen=True)
class Correction:
    weights: dict = field(default_factory=lambda: {"temporal": 0.4, "spatial": 0.4, "reconstruction": 0.2})
    max_run: int = 12
    min_confidence: float = 0.35


@dataclass(frozen=True)
class Injection:
    seed: int = 1337
    rate: float = 0.05
    min_spans: int = 6


@dataclass(frozen=True)
class Forest:
    trees: int = 40
    depth: int = 9
    min_split: int = 12
    min_leaf: int = 4
    seed: int = 11
    cuts: int = 64


@dataclass(frozen=True)
class Shapley:
    exact_up_to: int = 12
    permutations: int = 220
    background: int = 60
    least_background: int = 5
    seed: int = 5
    top: int = 5


@dataclass(frozen=True)
class Config:
    rules: Rules = field(default_factory=Rules)
    model: Model = field(default_factory=Model)
    threshold: Threshold = field(default_factory=Threshold)
    multivariate: Multivariate = field(default_factory=Multivariate)
    spatial: Spatial = field(default_factory=Spatial)
    fusion: Fusion = field(default_factory=Fusion)
    events: Events = field(default_factory=Events)
    health: Health = field(default_factory=Health)
    correction: Correction = field(default_factory=Correction)
    injection: Injection = field(default_factory=Injection)
    forest: Forest = field(default_factory=Forest)
    shapley: Shapley = field(default_factory=Shapley)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))


DEFAULT = Config()
