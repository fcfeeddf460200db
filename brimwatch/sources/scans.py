"""Reads of the fleet tables (SRC1-SRC9)."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimwatch import schemas as D
from brimwatch.operators.skew import skew_join


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json_answers(spark: SparkSession, path: str) -> DataFrame:
    """Raw model answers as JSON lines."""
    return spark.read.schema("host_id string, prediction_id string, raw string").json(path)


def newer_than(df: DataFrame, cutoff: datetime, ts: str = "ts") -> DataFrame:
    """Rows from a time on. A literal bound reaches the scan; a table by day skips old folders."""
    rows = df.where(F.col(ts) >= F.lit(cutoff))
    return rows.where(F.col(D.DAY) >= F.lit(cutoff.date())) if D.DAY in df.columns else rows


def trailing(telemetry: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """SRC1. Samples of the trailing window."""
    return newer_than(telemetry, as_of - timedelta(days=days))


def host_series(
    telemetry: DataFrame, host_id: str, as_of: datetime, device: str | None = None, days: int = 7
) -> DataFrame:
    """SRC2. One host's series, without a device that of its earliest sample."""
    rows = trailing(telemetry.where(F.col("host_id") == host_id), as_of, days)
    rows = rows.where(F.col("device") == device) if device is not None else pinned_series(rows)
    return as_points(rows).orderBy("ds")


def pinned_series(telemetry: DataFrame) -> DataFrame:
    """SRC2 for every host: samples of the device that reported first.

    The device list is one row per host; it meets the samples on (host, device),
    and Spark broadcasts it where its size allows.
    """
    first = telemetry.groupBy("host_id").agg(
        F.min_by("device", F.struct("ts", "device")).alias("device")
    )
    return skew_join(telemetry, first, ["host_id", "device"], "left_semi", spread=["ts"])


def as_points(telemetry: DataFrame) -> DataFrame:
    """PRJ1. (host, device, ds, y) with ds as a zone-free UTC time."""
    return telemetry.select(
        "host_id", "device", F.col("ts").cast("timestamp_ntz").alias("ds"), F.col("in_use_pct").alias("y")
    )


def recent_of_all(telemetry: DataFrame, as_of: datetime, hours: int = 168) -> DataFrame:
    """SRC4 for every host."""
    rows = newer_than(telemetry, as_of - timedelta(hours=hours))
    return rows.select("host_id", "ts", "in_use_pct", "used_bytes", "free_bytes")


def recent_samples(telemetry: DataFrame, host_id: str, as_of: datetime, hours: int = 168) -> DataFrame:
    """SRC4."""
    return recent_of_all(telemetry.where(F.col("host_id") == host_id), as_of, hours).drop("host_id").orderBy("ts")


def _newest(df: DataFrame, ts: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), tie).limit(limit)


def prediction_history(predictions: DataFrame, host_id: str, limit: int = 50) -> DataFrame:
    """SRC5."""
    return _newest(predictions.where(F.col("host_id") == host_id), "ts", "prediction_id", limit)


def list_runs(runs: DataFrame, host_id: str | None = None, limit: int = 50) -> DataFrame:
    """SRC6."""
    rows = runs if host_id is None else runs.where(F.col("host_id") == host_id)
    return _newest(rows, "started_at", "run_id", limit)


def list_tickets(
    tickets: DataFrame, status: str | None = None, severity: str | None = None, limit: int = 200
) -> DataFrame:
    """SRC7. Only the given conditions apply."""
    given = {"status": status, "severity": severity}
    wanted = [F.col(name) == value for name, value in given.items() if value]
    rows = tickets.where(reduce(lambda a, b: a & b, wanted)) if wanted else tickets
    return _newest(rows, "created_at", "ticket_id", limit)


def host_metadata(hosts: DataFrame, host_id: str):
    """SRC9. The host's row; an unknown id is an error."""
    row = hosts.where(F.col("host_id") == host_id).select(*[f.name for f in D.HOSTS]).first()
    if row is None:
        raise ValueError(f"unknown host_id {host_id!r}")
    return row


def hosts_by_id(wanted: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC9 for many ids: (found rows, unknown ids)."""
    ids = wanted.select("host_id").distinct()
    return hosts.join(ids, "host_id", "left_semi"), ids.join(hosts.select("host_id"), "host_id", "left_anti")
