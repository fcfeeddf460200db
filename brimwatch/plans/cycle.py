"""The scoring cycle: samples in, predictions out (CYC1, CYC2)."""

from __future__ import annotations

from datetime import datetime

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.config import DEFAULTS, Settings
from brimwatch.functions.scalar import short_id
from brimwatch.operators import anomaly
from brimwatch.operators.features import series_features, series_summary
from brimwatch.operators.fleet import cycle_stats
from brimwatch.operators.forecast import (
    FORECAST_COLUMNS,
    forecast_grid,
    read_horizons,
    seasonal_model,
    solve_trends,
    straight_line,
    trend_sums,
)
from brimwatch.operators.skew import by_length, series_context
from brimwatch.operators.trigger import with_trigger
from brimwatch.schemas import DAY, PREDICTIONS, SERIES_KEY
from brimwatch.session import cut_lineage
from brimwatch.sources.scans import trailing
from brimwatch.sources.sinks import insert_ignore


def score_series(
    rows: DataFrame,
    as_of: datetime,
    model: GBTClassificationModel | None,
    settings: Settings = DEFAULTS,
    forecaster: str = "piecewise",
    keys=SERIES_KEY,
) -> DataFrame:
    """Predictions from samples in series order, one per series.

    Features, period and forecast are aggregates of the same rows; scores are
    kept per (host, device), so every device gets its own. Without a model the
    anomaly score is 0.
    """
    keys = list(keys)

    def forecast(part: DataFrame, _: bool) -> DataFrame:
        base = series_summary(part, keys, settings)
        if forecaster == "piecewise":
            return solve_trends(base, trend_sums(part, keys, settings), keys, settings)
        model = seasonal_model(part, base.select(*keys, "step_minutes"), keys)
        return base.join(read_horizons(forecast_grid(model, keys, settings), keys, settings), keys)

    if forecaster not in ("piecewise", "seasonal"):
        raise ValueError(f"unknown forecaster {forecaster!r}")
    forecasts = by_length(rows, forecast)
    if model is None:
        scored = forecasts.withColumn("anomaly_score", F.lit(0.0))
    else:
        scored = anomaly.score(model, forecasts)
    stamped = scored.select(
        short_id("pred-", *[F.col(name) for name in keys], F.lit(as_of.isoformat())).alias(
            "prediction_id"
        ),
        F.lit(as_of).alias("ts"),
        *keys,
        *FORECAST_COLUMNS,
        "anomaly_score",
        F.lit(f"{forecaster}+gbt").alias("model_version"),
    )
    return with_trigger(stamped, settings).select(*[field.name for field in PREDICTIONS])


def score_fleet(
    telemetry: DataFrame,
    as_of: datetime,
    model: GBTClassificationModel | None,
    settings: Settings = DEFAULTS,
    forecaster: str = "piecewise",
    keys=SERIES_KEY,
) -> DataFrame:
    """CYC1 up to the write: one prediction per series of the trailing window."""
    rows = series_context(trailing(telemetry, as_of, settings.history_days), keys)
    return score_series(rows, as_of, model, settings, forecaster, keys)


def run_cycle(
    telemetry: DataFrame,
    as_of: datetime,
    model: GBTClassificationModel | None,
    path: str,
    settings: Settings = DEFAULTS,
    forecaster: str = "piecewise",
) -> dict:
    """CYC1, SNK4, AG15. Score, append and return the counts of this cycle.

    A cycle that runs again adds nothing: its prediction ids are stored already.

    The window in series order is kept for the time of the cycle, so the samples
    are read and shuffled once for all aggregates; lost blocks are recomputed.
    """
    spark = telemetry.sparkSession
    rows = series_context(
        trailing(telemetry, as_of, settings.history_days), SERIES_KEY
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Fixed, as the append reads them twice: for the days they touch and for the rows.
        insert_ignore(cut_lineage(score_series(rows, as_of, model, settings, forecaster)), path, ["prediction_id"])
    finally:
        rows.unpersist()
    stored = spark.read.parquet(path).where(F.col(DAY) == F.lit(as_of.date()))
    written = stored.where(F.col("ts") == F.lit(as_of))
    return cycle_stats(written).first().asDict()


def score_host(
    telemetry: DataFrame,
    host_id: str,
    as_of: datetime,
    model: GBTClassificationModel | None,
    settings: Settings = DEFAULTS,
    forecaster: str = "piecewise",
) -> DataFrame:
    """CYC2. The same plan for one host; no samples in the window is an error."""
    rows = telemetry.where(F.col("host_id") == host_id)
    if trailing(rows, as_of, settings.history_days).isEmpty():
        raise ValueError(f"no telemetry for host {host_id}")
    return score_fleet(rows, as_of, model, settings, forecaster)


def at_risk(telemetry: DataFrame, settings: Settings = DEFAULTS, keys=SERIES_KEY) -> DataFrame:
    """Series features, straight-line value in seven days, and the trigger on it."""
    features = series_features(telemetry, keys, settings)
    line = straight_line(telemetry, keys).select(*keys, F.col("line_pct").alias("forecast_7d_pct"))
    joined = features.join(line, list(keys)).withColumns(
        {"hours_to_90pct": F.lit(None).cast("double"), "anomaly_score": F.lit(None).cast("double")}
    )
    return with_trigger(joined, settings).drop("hours_to_90pct", "anomaly_score")
