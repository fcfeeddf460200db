"""Registered queries, grouped by topic; each with its SQL where SQL can say it."""

from brimwatch.plans.registered import (  # noqa: F401
    aggregates,
    fleetviews,
    forecasts,
    maintenance,
    models,
    scans,
    streams,
    texts,
    triageviews,
)
from brimwatch.plans.registered.base import ENTRIES

__all__ = ["ENTRIES"]
