"""Missing samples: grid, last value carried forward, as-of join (GAP1, GAP2, JN9, SNK12)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.functions.scalar import round_exact
from brimwatch.operators.skew import carry_forward
from brimwatch.schemas import SERIES_KEY


def missing_slots(
    hosts: DataFrame, telemetry: DataFrame, as_of: datetime, step_minutes: int = 5
) -> DataFrame:
    """GAP1, JN5. Every slot from one step after a host's last sample up to ``as_of``.

    Hosts without a sample, or with nothing elapsed, give no rows. ``as_of`` is
    cut to the minute.
    """
    last = telemetry.groupBy("host_id").agg(F.max("ts").alias("last_ts"))
    now = F.date_trunc("minute", F.lit(as_of))
    step = F.make_dt_interval(mins=F.lit(step_minutes))
    begin = F.col("last_ts") + step
    return (
        hosts.select("host_id", "monitored_path")
        .join(last, "host_id")
        .where(begin <= now)
        .select(
            "host_id",
            F.col("monitored_path").alias("device"),
            F.explode(F.sequence(begin, now, step)).alias("ts"),
        )
    )


def regular_grid(
    telemetry: DataFrame, as_of: datetime, step_minutes: int, keys: Sequence[str] = SERIES_KEY
) -> DataFrame:
    """Slots of one step per series, from the first full step after its first sample."""
    step_us = step_minutes * 60_000_000
    spans = telemetry.groupBy(*keys).agg(F.unix_micros(F.min("ts")).alias("first_us"))
    begin = (F.ceil(F.col("first_us") / F.lit(step_us)) * F.lit(step_us)).cast("long")
    end = F.unix_micros(F.lit(as_of))
    return (
        spans.withColumn("begin", begin)
        .where(F.col("begin") <= end)
        .select(
            *keys, F.explode(F.sequence(F.col("begin"), end, F.lit(step_us).cast("long"))).alias("us")
        )
        .select(*keys, F.timestamp_micros("us").alias("ts"))
    )


def fill_forward(
    telemetry: DataFrame, as_of: datetime, step_minutes: int, keys: Sequence[str] = SERIES_KEY
) -> DataFrame:
    """GAP2. Last observed value at every slot of a regular grid.

    Samples and slots are put in one row stream and carried forward in time
    slices, so neither a join per slot nor a whole series in one task is needed.
    """
    keys = list(keys)
    samples = telemetry.select(
        *keys, "ts", F.lit(0).alias("is_slot"), F.col("in_use_pct").alias("in_use_pct")
    )
    slots = regular_grid(telemetry, as_of, step_minutes, keys).select(
        *keys, "ts", F.lit(1).alias("is_slot"), F.lit(None).cast("double").alias("in_use_pct")
    )
    filled = carry_forward(
        samples.unionByName(slots), keys, "ts", ["is_slot"], "in_use_pct", unique_ts=True
    )
    return filled.where("is_slot = 1").drop("is_slot")


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """JN9. For each left row the newest right row of its key at or before its time.

    Both sides flow through one ordered pass; no pair of rows is ever formed
    beyond the one that matches. Left rows without a match keep nulls.
    """
    payload = F.struct(*columns)
    newest = right.select(
        key,
        F.col(right_ts).alias("_at"),
        F.lit(0).alias("_side"),
        F.struct(*tie_break, F.lit(0).alias("_")).alias("_tie"),
        payload.alias("_match"),
        F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"),
    )
    asked = left.select(
        key,
        F.col(left_ts).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(newest.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(newest.schema["_match"].dataType).alias("_match"),
        F.struct(*left.columns).alias("_left"),
    )
    joined = carry_forward(
        newest.unionByName(asked), [key], "_at", ["_side", "_tie"], "_match", seconds=30 * 86400
    )
    matched = joined.where("_side = 1")
    return matched.select(
        *[F.col("_left")[name].alias(name) for name in left.columns],
        *[F.col("_match")[name].alias(name) for name in columns],
    )


def backfill(samples: DataFrame, as_of: datetime, minutes: int) -> DataFrame:
    """SNK12. The given sample of each host repeated once per minute up to ``as_of``."""
    now = F.date_trunc("minute", F.lit(as_of))
    first = now - F.make_dt_interval(mins=F.lit(minutes - 1))
    slots = F.sequence(first, now, F.make_dt_interval(mins=F.lit(1)))
    rest = [name for name in samples.columns if name != "ts"]
    return samples.select(*rest).withColumn("ts", F.explode(slots)).select("ts", *rest)


def directory_samples(files: DataFrame, hosts: DataFrame, as_of: datetime) -> DataFrame:
    """SNK11. File sizes summed to one sample per host, used below the disk size."""
    used = files.groupBy("host_id").agg(F.sum("size_bytes").alias("used"))
    total = (F.col("total_disk_gb") * F.lit(float(1024**3))).cast("long")
    sized = hosts.join(used, "host_id").select(
        "host_id",
        F.col("monitored_path").alias("device"),
        total.alias("total_bytes"),
        F.least(F.col("used"), total - 1).alias("used_bytes"),
    )
    return sized.select(
        F.date_trunc("second", F.lit(as_of)).alias("ts"),
        "host_id",
        "device",
        "total_bytes",
        "used_bytes",
        (F.col("total_bytes") - F.col("used_bytes")).alias("free_bytes"),
        round_exact(F.lit(100.0) * F.col("used_bytes") / F.col("total_bytes"), 3).alias("in_use_pct"),
    )
