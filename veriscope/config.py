"""Settings as an immutable record; layers laid over each other, ``None`` changing nothing."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    # fixed values of the published configuration
    fuzzy_threshold: float = 0.85
    bm25_threshold: float = 0.5
    semantic_threshold: float = 0.6
    semantic_percentile: float = 0.02
    percentile_floor: float = 0.65
    agreement_threshold: float = 0.45
    agreement_weights: tuple[float, float, float, float] = (0.30, 0.25, 0.20, 0.25)
    fuzzy_ramp: tuple[float, float] = (0.5, 1.0)
    bm25_ramp: tuple[float, float] = (0.0, 0.5)
    semantic_abs_ramp: tuple[float, float] = (0.5, 1.0)
    semantic_ratio_ramp: tuple[float, float] = (0.8, 1.0)
    voter_exact: float = 1.0
    voter_fuzzy: float = 0.55
    voter_bm25: float = 0.15
    voter_semantic_abs: float = 0.70
    voter_semantic_ratio: float = 0.90
    voter_semantic_mode: str = "or"
    bonus_two: float = 0.20
    bonus_three: float = 0.35
    entity_penalty: float = 0.15
    co_support_fuzzy: float = 0.4
    co_support_bm25: float = 0.1
    proximity: float = 0.05
    chunk_chars: int = 1500
    chunk_overlap: float = 0.25
    classifier_mode: str = "adaptive_gap"
    adaptive_least_claims: int = 4
    lexical_effort: str = "high"
    context_chars: int = 80
    top_k: int = 3

    def __post_init__(self) -> None:
        if self.voter_semantic_mode not in ("or", "and", "abs_only", "ratio_only"):
            raise SettingsError(f"voter_semantic_mode: {self.voter_semantic_mode}")
        if self.classifier_mode not in ("adaptive_gap", "absolute"):
            raise SettingsError(f"classifier_mode: {self.classifier_mode}")
        if self.lexical_effort not in ("low", "medium", "high"):
            raise SettingsError(f"lexical_effort: {self.lexical_effort}")

    def overlay(self, **changes: object) -> Settings:
        unknown = set(changes) - {f.name for f in dataclasses.fields(self)}
        if unknown:
            raise SettingsError(f"unknown settings: {sorted(unknown)}")
        return dataclasses.replace(self, **{k: v for k, v in changes.items() if v is not None})


def load(*paths: str, **changes: object) -> Settings:
    """Defaults, then JSON files from the weakest to the strongest, then explicit values."""
    out = Settings()
    for p in paths:
        with open(p, encoding="utf-8") as f:
            out = out.overlay(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items()})
    return out.overlay(**changes)
