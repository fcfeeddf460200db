"""Trigger rule and status (TRG1, STA1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimwatch.config import DEFAULTS, Settings


def triggered(settings: Settings = DEFAULTS) -> Column:
    """TRG1. Any of three signals; a missing value never triggers."""
    signals = [
        F.col("forecast_7d_pct") >= settings.fill_pct,
        F.col("hours_to_90pct") <= settings.trigger_horizon_days * 24.0,
        F.col("anomaly_score") >= settings.anomaly_trigger,
    ]
    first, second, third = [F.coalesce(signal, F.lit(False)) for signal in signals]
    return first | second | third


def with_trigger(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return df.withColumn("triggered_agent", triggered(settings))


def status(settings: Settings = DEFAULTS) -> Column:
    """STA1. First matching state; ``critical`` is strictly above the fill limit."""
    return (
        F.when(F.col("anomaly_score").isNull(), "no_prediction")
        .when(F.col("anomaly_score") >= settings.anomaly_trigger, "anomalous")
        .when(F.col("triggered_agent"), "predictive")
        .when(F.col("in_use_pct") > settings.fill_pct, "critical")
        .otherwise("healthy")
    )
