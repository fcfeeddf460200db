from __future__ import annotations

from pyspark.sql import functions as F

from brimwatch.operators import cleanup, fleet, gaps
from brimwatch.operators.anomaly import with_labels
from brimwatch.plans.registered.base import r6, register, stamp
from brimwatch.plans.sqlviews import exact, r6 as q6, stamp as qstamp, with_views
from brimwatch.sources import sample as V


def overview(spark, d):
    return fleet.fleet_overview(V.hosts(spark, d), V.telemetry(spark, d), V.predictions(spark, d))


@register(
    "fleet_overview",
    with_views(
        "fleet",
        f"""SELECT host_id, hostname, os, environment, region, role, total_disk_gb, monitored_path, is_demo_host,
              {qstamp('ts')} AS ts, in_use_pct, used_bytes, total_bytes, {q6('anomaly_score')} AS anomaly_score,
              {q6('forecast_7d_pct')} AS forecast_7d_pct, hours_to_90pct, triggered_agent, status FROM fleet""",
    ),
)
def fleet_overview(spark, d):
    """FLT1, JN1, JN2, STA1."""
    return (
        overview(spark, d)
        .drop("created_at")
        .withColumns(
            {
                "ts": stamp("ts"),
                "anomaly_score": r6("anomaly_score"),
                "forecast_7d_pct": r6("forecast_7d_pct"),
            }
        )
    )


@register(
    "fleet_table",
    with_views(
        "fleet",
        f"""SELECT host_id, hostname, role, environment, os, is_demo_host AS is_demo, in_use_pct AS "in_use_%",
              {q6('anomaly_score')} AS anomaly, {q6('forecast_7d_pct')} AS "forecast_7d_%", hours_to_90pct AS h_to_90,
              triggered_agent AS triggered, status FROM fleet
            WHERE role IN ('web', 'db') AND environment IN ('prod', 'staging') AND status IN ('anomalous', 'predictive')""",
    ),
)
def fleet_table(spark, d):
    """PRJ5, PRJ6."""
    chosen = fleet.filter_fleet(
        overview(spark, d), ["web", "db"], ["prod", "staging"], ["anomalous", "predictive"]
    )
    return fleet.fleet_table(chosen).withColumns(
        {"anomaly": r6("anomaly"), "forecast_7d_%": r6("`forecast_7d_%`")}
    )


@register(
    "fleet_scatter",
    with_views(
        "fleet",
        f"""SELECT host_id, {q6('anomaly_score')} AS anomaly_score, {q6('forecast_7d_pct')} AS forecast_7d_pct, status,
              greatest(50.0::DOUBLE, coalesce(total_disk_gb, 100.0::DOUBLE)) AS marker_size
            FROM fleet WHERE anomaly_score IS NOT NULL AND forecast_7d_pct IS NOT NULL""",
    ),
)
def fleet_scatter(spark, d):
    """PRJ7."""
    return fleet.scatter_input(overview(spark, d)).withColumns(
        {"anomaly_score": r6("anomaly_score"), "forecast_7d_pct": r6("forecast_7d_pct")}
    )


@register(
    "fleet_recent_runs",
    with_views(
        "runs",
        f"""SELECT {qstamp('started_at')} AS started_at, host_id, decision, verdict, confidence_score, files_deleted,
              {exact('bytes_freed / 1073741824.0::DOUBLE', 2)} AS bytes_freed_gb
            FROM runs ORDER BY runs.started_at DESC, run_id LIMIT 10""",
    ),
)
def recent_runs(spark, d):
    """PRJ3, SRT1."""
    return fleet.recent_runs(V.runs(spark, d)).withColumn("started_at", stamp("started_at"))


@register(
    "join_run_context",
    with_views(
        "hosts latest_prediction",
        f"""SELECT h.host_id, h.role, h.environment, p.prediction_id, {q6('p.anomaly_score')} AS anomaly_score,
              p.prediction_id IS NOT NULL AS has_prediction
            FROM hosts h LEFT JOIN latest_prediction p ON h.host_id = p.host_id""",
    ),
)
def run_context(spark, d):
    """JN3: hosts with their newest prediction, and the report of those without."""
    found, missing = fleet.run_context(V.hosts(spark, d), V.predictions(spark, d))
    null = F.lit(None)
    return found.select(
        "host_id", "role", "environment", "prediction_id",
        r6("anomaly_score").alias("anomaly_score"), F.lit(True).alias("has_prediction"),
    ).unionByName(
        missing.select(
            "host_id", "role", "environment", null.cast("string").alias("prediction_id"),
            null.cast("double").alias("anomaly_score"), F.lit(False).alias("has_prediction"),
        )
    )


@register(
    "join_labels",
    with_views(
        "hosts series_labels",
        "SELECT h.host_id, CASE WHEN label = 'anomalous' THEN 1 ELSE 0 END AS y FROM hosts h LEFT JOIN series_labels USING (host_id)",
    ),
)
def labels(spark, d):
    """JN4: hosts without a label are class 0."""
    return with_labels(V.hosts(spark, d), V.series_labels(spark, d)).select("host_id", "y")


@register(
    "join_playbook_role",
    with_views("hosts", "SELECT host_id, role, CASE WHEN role IN ('web', 'app', 'db') THEN role ELSE 'app' END AS playbook FROM hosts"),
)
def playbook_role(spark, d):
    """JN6, CLN1."""
    return V.hosts(spark, d).select(
        "host_id", "role", cleanup.playbook_role(F.col("role")).alias("playbook")
    )


@register(
    "join_file_rules",
    with_views(
        "files hosts files_now",
        """SELECT host_id, path, rule_no FROM named JOIN rules USING (playbook)
           WHERE regexp_matches(name, pattern) AND days >= least_days""",
        """rules(playbook, rule_no, pattern, least_days) AS (VALUES
             ('web', 1, '^.*\\.log\\.[0-9].*$', 14), ('web', 2, '^.*\\.log\\.gz$', 21), ('web', 3, '^.*-archive-.*\\.log.*$', 14),
             ('app', 1, '^.*-archive-.*\\.log.*$', 30), ('app', 2, '^.*\\.log\\.gz$', 21), ('app', 3, '^.*\\.log\\.[0-9].*$', 14),
             ('app', 4, '^junk-.*\\.bin$', 1), ('db', 1, '^postgresql-.*\\.log$', 30), ('db', 2, '^postgresql-.*\\.log\\.gz$', 30),
             ('db', 3, '^junk-.*\\.bin$', 1)),
           named AS (
             SELECT f.host_id, f.path, split_part(f.path, '/', -1) AS name,
               CASE WHEN role IN ('web', 'app', 'db') THEN role ELSE 'app' END AS playbook,
               floor(greatest(0.0::DOUBLE, (epoch_us(now) - epoch_us(mtime)) / 8.64e10::DOUBLE)) AS days
             FROM files f JOIN hosts USING (host_id), files_now)""",
    ),
)
def file_rules(spark, d):
    """JN7."""
    return cleanup.rule_matches(
        V.files(spark, d), V.hosts(spark, d), V.files_as_of(spark, d)
    ).select("host_id", "path", "rule_no")


@register(
    "join_as_of",
    with_views(
        "runs predictions",
        f"""SELECT r.run_id, r.host_id, {qstamp('r.started_at')} AS started_at, p.prediction_id AS current_prediction_id,
              {q6('p.anomaly_score')} AS anomaly_score
            FROM shifted r ASOF LEFT JOIN newest p ON r.host_id = p.host_id AND r.started_at >= p.ts""",
        """shifted AS (SELECT run_id, host_id, started_at - INTERVAL 90 DAY AS started_at FROM runs),
           newest AS (SELECT host_id, ts, max(prediction_id) AS prediction_id, arg_max(anomaly_score, prediction_id) AS anomaly_score
                      FROM predictions GROUP BY host_id, ts)""",
    ),
)
def as_of(spark, d):
    """JN9: the prediction that was current 90 days before each run."""
    asked = V.runs(spark, d).select(
        "run_id", "host_id", (F.col("started_at") - F.expr("INTERVAL 90 DAYS")).alias("started_at")
    )
    scored = V.predictions(spark, d).select(
        "host_id", "ts", F.col("prediction_id").alias("current_prediction_id"), "anomaly_score"
    )
    rows = gaps.as_of_join(
        asked, scored, "host_id", "started_at", "ts",
        ["current_prediction_id", "anomaly_score"], ["current_prediction_id"],
    )
    return rows.withColumns({"started_at": stamp("started_at"), "anomaly_score": r6("anomaly_score")})


@register(
    "join_lineage",
    with_views(
        "runs tickets predictions",
        f"""SELECT r.run_id, r.host_id, r.decision, t.ticket_id AS filed_ticket_id, t.severity, t.status AS ticket_status,
              {q6('p.anomaly_score')} AS anomaly_score, p.triggered_agent
            FROM runs r LEFT JOIN tickets t ON t.agent_run_id = r.run_id LEFT JOIN predictions p USING (prediction_id)""",
    ),
)
def lineage(spark, d):
    """JN10."""
    rows = fleet.lineage(V.runs(spark, d), V.tickets(spark, d), V.predictions(spark, d))
    return rows.select(
        "run_id", "host_id", "decision", "filed_ticket_id", "severity", "ticket_status",
        r6("anomaly_score").alias("anomaly_score"), "triggered_agent",
    )
