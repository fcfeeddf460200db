"""Declared schemas of the fleet tables and their value domains."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


HOSTS = _schema(
    host_id=T.StringType(), hostname=T.StringType(), os=T.StringType(),
    environment=T.StringType(), region=T.StringType(), role=T.StringType(),
    total_disk_gb=T.DoubleType(), monitored_path=T.StringType(), created_at=T.TimestampType(),
)

TELEMETRY = _schema(
    ts=T.TimestampType(), host_id=T.StringType(), device=T.StringType(),
    total_bytes=T.LongType(), used_bytes=T.LongType(), free_bytes=T.LongType(),
    in_use_pct=T.DoubleType(),
)

PREDICTIONS = _schema(
    prediction_id=T.StringType(), ts=T.TimestampType(), host_id=T.StringType(),
    device=T.StringType(), forecast_1d_pct=T.DoubleType(), forecast_3d_pct=T.DoubleType(),
    forecast_7d_pct=T.DoubleType(), forecast_14d_pct=T.DoubleType(),
    hours_to_90pct=T.DoubleType(), anomaly_score=T.DoubleType(),
    triggered_agent=T.BooleanType(), model_version=T.StringType(),
)

TOOL_CALL = _schema(
    tool=T.StringType(), args=T.MapType(T.StringType(), T.StringType()),
    output_summary=T.StringType(), error=T.StringType(),
)

RUNS = _schema(
    run_id=T.StringType(), started_at=T.TimestampType(), finished_at=T.TimestampType(),
    host_id=T.StringType(), prediction_id=T.StringType(), confidence_score=T.DoubleType(),
    decision=T.StringType(), verdict=T.StringType(), bytes_freed=T.LongType(),
    files_deleted=T.IntegerType(), ticket_id=T.StringType(), reasoning=T.StringType(),
    tool_calls=T.ArrayType(TOOL_CALL), doc_ids=T.ArrayType(T.StringType()), error=T.StringType(),
)

TICKETS = _schema(
    ticket_id=T.StringType(), created_at=T.TimestampType(), updated_at=T.TimestampType(),
    status=T.StringType(), severity=T.StringType(), short_description=T.StringType(),
    description=T.StringType(), host_id=T.StringType(), assignment_group=T.StringType(),
    agent_run_id=T.StringType(), metadata=T.MapType(T.StringType(), T.StringType()),
)

KNOWLEDGE = _schema(
    doc_id=T.StringType(), source=T.StringType(), title=T.StringType(), content=T.StringType(),
    metadata=T.MapType(T.StringType(), T.StringType()), embedding=T.ArrayType(T.FloatType()),
)

FILES = _schema(
    host_id=T.StringType(), path=T.StringType(), size_bytes=T.LongType(), mtime=T.TimestampType(),
)

# Allowed members of the enumerated columns.
OS = ("windows", "linux")
ENVIRONMENTS = ("prod", "staging", "dev")
RECOMMENDATIONS = ("clean", "escalate_anomaly", "no_action")
VERDICTS = ("cleaned", "no_action_needed", "escalated_anomaly")
TICKET_STATUSES = ("new", "assigned", "in_progress", "resolved", "closed")
SEVERITIES = ("P1", "P2", "P3", "P4")

SERIES_KEY = ("host_id", "device")

# Partition column of the stored facts: the calendar day of the row.
DAY = "run_date"
