"""Typed settings with their ranges; a settings file is merged over the defaults and checked as a whole."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


def ranged(default: Any, low: float | None = None, high: float | None = None, open_low: bool = False) -> Any:
    """A number with its range; `open_low` leaves out the lower end. None, as a default, is allowed and unchecked."""
    return field(default=default, metadata={"low": low, "high": high, "open_low": open_low})


class Checked:
    """Checks each ranged field, and what `rules` says of several together."""

    def rules(self) -> list[tuple[bool, str]]:
        return []

    def __post_init__(self) -> None:
        name = type(self).__name__
        for f in fields(self):  # type: ignore[arg-type]
            value, m = getattr(self, f.name), f.metadata
            if not m or value is None:
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{name}.{f.name} must be a number")
            low, high = m["low"], m["high"]
            if low is not None and (value < low or (m["open_low"] and value == low)):
                raise ValueError(f"{name}.{f.name} must be {'above' if m['open_low'] else 'at least'} {low}")
            if high is not None and value > high:
                raise ValueError(f"{name}.{f.name} must be at most {high}")
        for ok, what in self.rules():
            if not ok:
                raise ValueError(f"{name}: {what}")


def _weights(values: Mapping[str, float], positive: bool) -> list[tuple[bool, str]]:
    return [(all(v >= 0 for v in values.values()), "weights must not be negative"), (not positive or sum(values.values()) > 0, "weights must have a positive sum")]


@dataclass(frozen=True)
class Retrieval(Checked):
    least: int = ranged(50, 1, 1000)
    default: int = ranged(100, 1, 1000)
    most: int = ranged(200, 1, 1000)
    per_video_event: int = ranged(12, 1, 64)
    margin_low: float = ranged(0.05, 0, 1)
    margin_high: float = ranged(0.20, 0, 1)
    generic_words: int = ranged(3, 1)

    def rules(self) -> list[tuple[bool, str]]:
        return [(self.least <= self.default <= self.most, "least <= default <= most"), (self.margin_low <= self.margin_high, "margin_low <= margin_high")]


@dataclass(frozen=True)
class Fusion(Checked):
    k: int = ranged(60, 0, open_low=True)
    weights: Mapping[str, float] = field(default_factory=dict)

    def rules(self) -> list[tuple[bool, str]]:
        return _weights(self.weights, positive=False)


@dataclass(frozen=True)
class Temporal(Checked):
    alignment: str = "dante"
    same_frame: bool = False
    videos: int = ranged(30, 1, 100)
    windows_per_video: int = ranged(5, 1, 20)
    windows: int = ranged(50, 1, 500)
    chains_per_video: int = ranged(5, 1, 20)
    beam: int = ranged(100, 1)
    default_gap_seconds: float | None = ranged(60.0, 0, open_low=True)
    seed_share: float = ranged(0.85, 0, 1, open_low=True)

    def rules(self) -> list[tuple[bool, str]]:
        return [(self.alignment in ("legacy", "legacy_beam", "dante"), "alignment is legacy, legacy_beam or dante"), (self.beam >= self.chains_per_video, "beam >= chains_per_video")]


@dataclass(frozen=True)
class Refinement(Checked):
    coarse_fps: float = ranged(3.0, 0, open_low=True)
    coarse_seconds: float = ranged(5.0, 0, open_low=True)
    fine_fps: float = ranged(12.0, 0, open_low=True)
    fine_seconds: float = ranged(1.0, 0, open_low=True)
    frames: int = ranged(120, 1)
    windows: int = ranged(10, 1, 50)
    shift_seconds: float = ranged(10.0, 0, open_low=True)
    candidates_per_event: int = ranged(12, 1, 64)


@dataclass(frozen=True)
class Reranking(Checked):
    # Weights of a chain's parts and of modalities.
    weights: Mapping[str, float] = field(default_factory=lambda: {"semantic": 0.35, "temporal": 0.25, "linkage": 0.15, "context": 0.15, "multimodal": 0.05, "coverage": 0.05})
    modality_weights: Mapping[str, float] = field(default_factory=lambda: {"clip": 1.0, "object": 2.0, "attribute": 2.0, "ocr": 3.0, "asr": 3.0})
    link_scale_seconds: float = ranged(60.0, 0, open_low=True)
    hard_gate: bool = False
    least_continuity: float = ranged(0.65, 0, 1)

    def rules(self) -> list[tuple[bool, str]]:
        return _weights(self.weights, positive=True) + _weights(self.modality_weights, positive=False)


@dataclass(frozen=True)
class Objective(Checked):
    semantic: float = ranged(1.0, 0)
    gap_penalty: float = ranged(0.25, 0)
    skip_penalty: float = ranged(0.15, 0)
    chains: int = ranged(5, 1, 20)


@dataclass(frozen=True)
class Review(Checked):
    top: int = ranged(3, 1)
    low_margin: float = ranged(0.05, 0, 1)
    low_linkage: float = ranged(0.40, 0, 1)


@dataclass(frozen=True)
class Settings(Checked):
    retrieval: Retrieval = field(default_factory=Retrieval)
    fusion: Fusion = field(default_factory=Fusion)
    temporal: Temporal = field(default_factory=Temporal)
    refinement: Refinement = field(default_factory=Refinement)
    reranking: Reranking = field(default_factory=Reranking)
    objective: Objective = field(default_factory=Objective)
    review: Review = field(default_factory=Review)


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """`over` on top of `base`: mappings meet key by key at every depth, anything else is replaced."""
    both = {k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}
    return {**base, **both}


def load(*layers: Mapping[str, Any]) -> Settings:
    """Settings from layers of nested mappings, later ones on top; unknown names are refused."""
    values: dict[str, Any] = {}
    for layer in layers:
        values = merged(values, layer)
    parts = {f.name: f.default_factory for f in fields(Settings)}  # type: ignore[misc]
    unknown = values.keys() - parts.keys()
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    made = {}
    for name, own in values.items():
        kind = parts[name]
        assert is_dataclass(kind)
        known = {f.name for f in fields(kind)}
        if own.keys() - known:
            raise ValueError(f"unknown settings in {name}: {', '.join(sorted(own.keys() - known))}")
        made[name] = kind(**own)
    return Settings(**made)
