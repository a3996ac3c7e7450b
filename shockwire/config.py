"""Thresholds and sizes of the analysis, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults follow the published model; stand-in data sets override what their noise needs."""

    shock_threshold: float = -0.02
    cluster_gap_days: int = 5
    control_exclusion_days: int = 90
    control_ratio: int = 3
    seed: str = "42"
    windows: tuple[int, ...] = (3, 7, 14, 21, 30, 45, 60)
    alpha: float = 0.05
    min_effect: float = 0.2
    min_cell: int = 5
    min_support: float = 0.1
    min_confidence: float = 0.5
    min_lift: float = 1.5
    warning_threshold: float = 18.52
    alert_levels: tuple[int, int, int] = (3, 5, 7)
    offsets: tuple[int, ...] = (30, 21, 14, 7, 0)
    lead_days: tuple[int, ...] = (0, 1, 3, 7, 14, 21, 30)
    tag_similarity: float = 0.5
    rolling_window: int = 12
    max_lag: int = 12
    commission: float = 0.00015


DEFAULT = Config()
