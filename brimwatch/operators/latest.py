"""Latest row per key (LAT1-LAT3)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.operators.skew import lookup, same_keys, skew_join


def latest_per(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """LAT1. One row per key, the newest; equal timestamps fall to the largest tie-break.

    The newest time of every key is a hash aggregate of fixed-width values. It is
    joined back by hash, which leaves one row per key but for equal times; only
    those are put in order. Facts are never sorted, and not shuffled either
    unless there are too many keys to broadcast.
    """
    keys, kept = list(keys), [name for name in df.columns if name not in keys]
    newest = df.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.max(ts).alias("_newest"))
    newest = lookup(newest)
    near = df.join(newest, same_keys(df, newest, keys) & df[ts].eqNullSafe(newest["_newest"]), "left_semi")
    return near.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(ts, *tie_break)).alias("_row")).select(
        *keys, *[F.col("_row")[name].alias(name) for name in kept]
    ).select(*df.columns)


def latest_telemetry(telemetry: DataFrame) -> DataFrame:
    """LAT1 over telemetry; the device breaks ties.

    A sample's time is unique within its (host, device).
    """
    return latest_per(telemetry, ["host_id"], "ts", ["device"])


def latest_predictions(
    predictions: DataFrame, host_ids: Iterable[str] | DataFrame | None = None, by_device: bool = True
) -> DataFrame:
    """LAT2. Newest prediction per (host, device), optionally for some hosts only (PRJ4)."""
    if isinstance(host_ids, DataFrame):
        predictions = skew_join(
            predictions, host_ids.select("host_id"), ["host_id"], "left_semi", ["prediction_id"]
        )
    elif host_ids is not None:
        predictions = predictions.where(F.col("host_id").isin(list(host_ids)))
    keys = ["host_id", "device"] if by_device else ["host_id"]
    return latest_per(predictions, keys, "ts", ["prediction_id"])


def triggered_hosts(predictions: DataFrame) -> DataFrame:
    """LAT3. Hosts whose newest prediction is triggered; the filter follows the reduction."""
    newest = latest_predictions(
        predictions.select("host_id", "ts", "prediction_id", "triggered_agent"), by_device=False
    )
    return newest.where("triggered_agent").select("host_id")
