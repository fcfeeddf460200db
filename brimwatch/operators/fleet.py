"""Fleet views and roll-ups (FLT1, AG11-AG16, PRJ5-PRJ7, JN10, EXT1, EXT2)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.config import DEFAULTS, Settings
from brimwatch.functions.scalar import bytes_to_gb
from brimwatch.operators.latest import latest_predictions, latest_telemetry, triggered_hosts
from brimwatch.operators.skew import top_per_key
from brimwatch.operators.trigger import status

# Fixed value: id prefix of demonstration hosts.
DEMO_PREFIX = "demo-"


def host_inventory(hosts: DataFrame) -> DataFrame:
    """SRC3. Inventory with ``is_demo_host`` from the id prefix."""
    return hosts.withColumn("is_demo_host", F.startswith("host_id", F.lit(DEMO_PREFIX)))


def fleet_overview(
    hosts: DataFrame, telemetry: DataFrame, predictions: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """FLT1, JN1, JN2. Every host with its newest sample, newest prediction and status.

    Both facts shrink to one row per host before they meet the inventory.
    """
    samples = latest_telemetry(
        telemetry.select("host_id", "ts", "device", "in_use_pct", "used_bytes", "total_bytes")
    ).drop("device")
    newest = latest_predictions(
        predictions.select(
            "host_id", "ts", "prediction_id", "anomaly_score", "forecast_7d_pct",
            "hours_to_90pct", "triggered_agent",
        ),
        by_device=False,
    ).drop("ts", "prediction_id")
    joined = (
        host_inventory(hosts).join(samples, "host_id", "left").join(newest, "host_id", "left")
    )
    return joined.withColumn("status", status(settings))


def filter_fleet(
    fleet: DataFrame,
    roles: Sequence[str] = (),
    environments: Sequence[str] = (),
    statuses: Sequence[str] = (),
    demo_only: bool = False,
) -> DataFrame:
    """PRJ5. Conjunction of the given selections; an empty one selects everything."""
    for name, chosen in (("role", roles), ("environment", environments), ("status", statuses)):
        if chosen:
            fleet = fleet.where(F.col(name).isin(list(chosen)))
    return fleet.where("is_demo_host") if demo_only else fleet


# Column names of the displayed table.
TABLE_NAMES = {
    "in_use_pct": "in_use_%",
    "anomaly_score": "anomaly",
    "forecast_7d_pct": "forecast_7d_%",
    "hours_to_90pct": "h_to_90",
    "triggered_agent": "triggered",
    "is_demo_host": "is_demo",
}


def fleet_table(fleet: DataFrame) -> DataFrame:
    """PRJ6."""
    return fleet.select(
        "host_id", "hostname", "role", "environment", "os", "is_demo_host", "in_use_pct",
        "anomaly_score", "forecast_7d_pct", "hours_to_90pct", "triggered_agent", "status",
    ).withColumnsRenamed(TABLE_NAMES)


def scatter_input(fleet: DataFrame) -> DataFrame:
    """PRJ7. Hosts with both scores; marker size from the disk, missing 100, at least 50."""
    size = F.greatest(F.lit(50.0), F.coalesce("total_disk_gb", F.lit(100.0)))
    return fleet.dropna(subset=["anomaly_score", "forecast_7d_pct"]).select(
        "host_id", "anomaly_score", "forecast_7d_pct", "status", size.alias("marker_size")
    )


def fleet_kpis(fleet: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """AG12. One row of headline counts; missing values count as not reached."""
    return fleet.agg(
        F.count("*").alias("total"),
        F.count_if("triggered_agent").alias("triggered"),
        F.count_if(F.col("anomaly_score") >= settings.anomaly_trigger).alias("anomalous"),
        F.count_if(F.col("forecast_7d_pct") >= settings.fill_pct).alias("breach_in_7d"),
        F.count_if("is_demo_host").alias("demo_count"),
    )


def ticket_kpis(tickets: DataFrame) -> DataFrame:
    """AG13."""
    return tickets.agg(
        F.count_if(~F.col("status").isin("resolved", "closed")).alias("open_tickets"),
        F.count_if(F.col("severity").isin("P1", "P2")).alias("p1_p2"),
    )


def table_counts(
    hosts: DataFrame, predictions: DataFrame, runs: DataFrame, tickets: DataFrame
) -> DataFrame:
    """AG14, SET1. One row per table, and the hosts triggered by their newest prediction."""
    parts = {
        "hosts": hosts, "predictions": predictions, "agent_runs": runs, "tickets": tickets,
        "triggered": triggered_hosts(predictions),
    }
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def cycle_stats(predictions: DataFrame) -> DataFrame:
    """AG15. Outcome of one scoring cycle."""
    return predictions.agg(
        F.count_distinct("host_id", "device").alias("hosts"),
        F.count("*").alias("predictions"),
        F.count_if("triggered_agent").alias("triggered"),
        F.coalesce(F.max("anomaly_score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("mean_score"),
    )


def trigger_counts(predictions: DataFrame) -> DataFrame:
    """AG11."""
    return predictions.groupBy("triggered_agent").agg(F.count("*").alias("n"))


def label_histogram(labels: DataFrame) -> DataFrame:
    """AG16."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """PRJ3. Newest runs with freed space in GB."""
    return (
        runs.orderBy(F.col("started_at").desc(), "run_id")
        .limit(limit)
        .select(
            "started_at", "host_id", "decision", "verdict", "confidence_score", "files_deleted",
            bytes_to_gb(F.col("bytes_freed")).alias("bytes_freed_gb"),
        )
    )


def lineage(runs: DataFrame, tickets: DataFrame, predictions: DataFrame) -> DataFrame:
    """JN10. Each run with its ticket and its prediction, by id."""
    filed = tickets.select(
        F.col("agent_run_id").alias("run_id"),
        F.col("ticket_id").alias("filed_ticket_id"),
        F.col("severity"),
        F.col("status").alias("ticket_status"),
    )
    scored = predictions.select("prediction_id", "anomaly_score", "triggered_agent")
    return runs.join(filed, "run_id", "left").join(scored, "prediction_id", "left")


def run_context(hosts: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN3. (hosts with their newest prediction, hosts without any prediction)."""
    newest = latest_predictions(predictions, by_device=False)
    return (
        hosts.join(newest, "host_id"),
        hosts.join(newest.select("host_id"), "host_id", "left_anti"),
    )


def status_rollup(fleet: DataFrame) -> DataFrame:
    """EXT1. Status counts by environment and role with subtotals."""
    return fleet.rollup("environment", "role").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("hosts"),
        *[
            F.count_if(F.col("status") == name).alias(name)
            for name in ("no_prediction", "anomalous", "predictive", "critical", "healthy")
        ],
    )


def telemetry_rollup(
    telemetry: DataFrame, width: str = "1 hour", slide: str | None = None, keys=("host_id", "device")
) -> DataFrame:
    """EXT2. Samples per series, or per host, and time window."""
    return (
        telemetry.groupBy(*keys, F.window("ts", width, slide).alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.avg("in_use_pct").alias("mean_pct"),
            F.max("in_use_pct").alias("max_pct"),
        )
        .select(*keys, F.col("w.start").alias("window_start"), "n", "mean_pct", "max_pct")
    )


def newest_per_host(df: DataFrame, ts: str, tie: str, limit: int = 50) -> DataFrame:
    """SRC5, SRT1 for every host at once."""
    return top_per_key(df, ["host_id"], [F.col(ts).desc(), F.col(tie)], limit)
