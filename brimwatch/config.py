"""Tunable thresholds. Defaults are the fixed values of the domain rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Forecasting and trigger rule
    history_days: int = 7
    interval_minutes: int = 5
    horizons_days: tuple[int, ...] = (1, 3, 7, 14)
    fill_pct: float = 90.0
    trigger_horizon_days: int = 7
    anomaly_trigger: float = 0.6
    min_feature_rows: int = 5
    min_forecast_rows: int = 24

    # Confidence routing. The label of the middle route is free text that
    # downstream systems key on, so it is a setting and not a literal.
    auto_threshold: float = 0.85
    chat_threshold: float = 0.75
    chat_route: str = "chat_approval"

    # Clean-up guards
    min_file_age_hours: float = 24.0
    max_gb_per_run: float = 80.0
    max_files_per_run: int = 200

    # Retention of raw telemetry
    retention_days: int = 30


DEFAULTS = Settings()


def parse_horizons(text: str) -> tuple[int, ...]:
    """Comma list of day counts, e.g. ``"1,3,7,14"`` (SC19)."""
    return tuple(int(part) for part in text.split(",") if part.strip())
