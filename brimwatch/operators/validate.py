"""Row checks and referential checks (VAL1-VAL3)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimwatch import schemas as D
from brimwatch.operators.skew import skew_join, series_context


def _member(name: str, allowed) -> Column:
    return F.coalesce(F.col(name).isin(list(allowed)), F.lit(False))


def _within(name: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(name).between(low, high), F.lit(False))


def host_rules() -> dict[str, Column]:
    return {
        "host_id_missing": F.col("host_id").isNotNull(),
        "os_unknown": _member("os", D.OS),
        "environment_unknown": _member("environment", D.ENVIRONMENTS),
        "disk_missing": F.col("total_disk_gb").isNotNull(),
    }


def telemetry_rules() -> dict[str, Column]:
    return {
        "key_missing": F.col("host_id").isNotNull() & F.col("device").isNotNull() & F.col("ts").isNotNull(),
        "pct_range": _within("in_use_pct", 0.0, 100.0),
        "total_not_positive": F.coalesce(F.col("total_bytes") > 0, F.lit(False)),
        "bytes_do_not_add_up": F.coalesce(
            F.col("used_bytes") + F.col("free_bytes") == F.col("total_bytes"), F.lit(False)
        ),
    }


def prediction_rules() -> dict[str, Column]:
    return {
        "key_missing": F.col("prediction_id").isNotNull() & F.col("host_id").isNotNull(),
        "anomaly_range": _within("anomaly_score", 0.0, 1.0),
    }


def ticket_rules() -> dict[str, Column]:
    return {
        "status_unknown": _member("status", D.TICKET_STATUSES),
        "severity_unknown": _member("severity", D.SEVERITIES),
    }


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """VAL1. Adds ``violations``, the names of all failed rules, in one pass."""
    none = F.array().cast("array<string>")
    failed = [F.when(~passes, F.array(F.lit(name))).otherwise(none) for name, passes in rules.items()]
    return df.withColumn("violations", F.concat(*failed))


def split_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """VAL1. (good rows, quarantined rows with their violations)."""
    checked = check_rows(df, rules)
    good = checked.where(F.size("violations") == 0).drop("violations")
    return good, checked.where(F.size("violations") > 0)


def series_order(telemetry: DataFrame, keys=("host_id",)) -> DataFrame:
    """VAL2. Per host: samples and repeated timestamps, next to the row checks."""
    steps = series_context(telemetry, list(keys))
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("ts") == F.col("prev_ts")).alias("n_repeated_ts"),
    )


def series_invariants(telemetry: DataFrame) -> DataFrame:
    """VAL2. Violation counts per host."""
    checked = check_rows(telemetry, telemetry_rules())
    counts = [
        F.count_if(F.array_contains("violations", name)).alias(name) for name in telemetry_rules()
    ]
    return checked.groupBy("host_id").agg(F.count("*").alias("n_rows"), *counts)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """VAL3. Child rows whose parent is missing; rows without a reference are fine."""
    known = parent.select(F.col(parent_key).alias(child_key))
    referring = child.where(F.col(child_key).isNotNull())
    return skew_join(referring, known, [child_key], "left_anti")
