from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brimwatch.functions.scalar import round_exact
from brimwatch.operators import gaps
from brimwatch.operators.fleet import telemetry_rollup
from brimwatch.operators.latest import latest_telemetry
from brimwatch.plans.registered.base import r9, register, stamp
from brimwatch.plans.sqlviews import exact, hid, r9 as q9, stamp as qstamp, with_views
from brimwatch.session import fresh_dir
from brimwatch.sources import sample as V
from brimwatch.sources import sinks
from brimwatch.sources.keyed import KeyedTable

CHANGED_AT = datetime(2024, 2, 1)


@register(
    "sink_insert_ignore",
    with_views(
        "telemetry",
        f"SELECT host_id, device, {qstamp('ts')} AS ts, in_use_pct FROM telemetry",
    ),
)
def insert_ignore(spark, d):
    """SNK1: the same samples twice, the second time with other values; the first stay."""
    path = fresh_dir(spark, "telemetry")
    rows = V.telemetry(spark, d)
    sinks.insert_ignore(rows, path)
    sinks.insert_ignore(rows.unionByName(rows).withColumn("in_use_pct", F.lit(0.0)), path)
    stored = spark.read.parquet(path)
    return stored.select("host_id", "device", stamp("ts").alias("ts"), "in_use_pct")


def host_updates(spark, d):
    """New attributes for hosts named by parts: some known, some new."""
    return V.read(spark, d, "part").select(
        V.host_id("p_partkey").alias("host_id"),
        F.concat(F.lit("renamed-"), F.col("p_partkey")).alias("hostname"),
        F.lit("linux").alias("os"),
        F.lit("dev").alias("environment"),
        F.lit("asia").alias("region"),
        F.lit("app").alias("role"),
        F.col("p_size").cast("double").alias("total_disk_gb"),
        F.lit("/data").alias("monitored_path"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


_UPDATES = f"""updates AS (SELECT {hid('p_partkey')} AS host_id, 'renamed-' || p_partkey AS hostname, 'linux' AS os, 'dev' AS environment,
  'asia' AS region, 'app' AS role, CAST(p_size AS DOUBLE) AS total_disk_gb, '/data' AS monitored_path FROM part)"""
_HOST_COLUMNS = ["host_id", "hostname", "os", "environment", "region", "role", "total_disk_gb", "monitored_path"]
_ATTRIBUTES = _HOST_COLUMNS[1:]


@register(
    "sink_upsert",
    with_views(
        "hosts",
        "SELECT coalesce(u.host_id, h.host_id) AS host_id, "
        + ", ".join(f"CASE WHEN u.host_id IS NULL THEN h.{c} ELSE u.{c} END AS {c}" for c in _ATTRIBUTES)
        + " FROM hosts h FULL JOIN updates u ON h.host_id = u.host_id",
        _UPDATES,
    ),
)
def upsert(spark, d):
    """SNK2: merged into the stored table, bucket by bucket."""
    return _upserted(spark, d, _ATTRIBUTES)


def _upserted(spark, d, columns):
    table = KeyedTable(spark, fresh_dir(spark, "hosts"), ["host_id"])
    table.merge(V.hosts(spark, d), lambda old, new: new)
    sinks.upsert_stored(table, host_updates(spark, d), columns)
    return table.read().select(*_HOST_COLUMNS)


_PARTIAL = ["hostname", "total_disk_gb", "monitored_path"]


@register(
    "sink_partial_upsert",
    with_views(
        "hosts",
        "SELECT coalesce(u.host_id, h.host_id) AS host_id, "
        + ", ".join(
            f"CASE WHEN u.host_id IS NOT NULL AND ({'true' if c in _PARTIAL else 'h.host_id IS NULL'}) THEN u.{c} ELSE h.{c} END AS {c}"
            for c in _ATTRIBUTES
        )
        + " FROM hosts h FULL JOIN updates u ON h.host_id = u.host_id",
        _UPDATES,
    ),
)
def partial_upsert(spark, d):
    """SNK3."""
    return _upserted(spark, d, _PARTIAL)


@register(
    "sink_append_predictions",
    with_views(
        "",
        f"""SELECT 'pred-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS prediction_id, {hid('user_id')} AS host_id,
              {qstamp('ts')} AS ts, {exact('least(1.0::DOUBLE, value / 100.0::DOUBLE)', 3)} AS anomaly_score,
              strftime(ts, '%Y-%m-%d') AS day FROM events""",
    ),
)
def append_predictions(spark, d):
    """SNK4: one prediction per sample, appended by two cycles into one table by day."""
    path = fresh_dir(spark, "predictions")
    rows = V.read(spark, d, "events").select(
        F.concat(F.lit("pred-"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("prediction_id"),
        V.host_id("user_id").alias("host_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        round_exact(F.least(F.lit(1.0), F.col("value") / 100.0), 3).alias("anomaly_score"),
    )
    middle = F.lit(V.as_of(spark, d) - timedelta(days=15))
    sinks.append_partitioned(rows.where(F.col("ts") < middle), path)
    sinks.append_partitioned(rows.where(F.col("ts") >= middle), path)
    return spark.read.parquet(path).select(
        "prediction_id", "host_id", stamp("ts").alias("ts"), "anomaly_score",
        F.date_format(sinks.DAY, "yyyy-MM-dd").alias("day"),
    )


@register(
    "sink_audit_runs",
    with_views(
        "runs",
        """SELECT run_id, '[{"tool":"list_files","args":{"host_id":"' || host_id || '"},"output_summary":"' || files_deleted || ' files"}]' AS tool_calls,
             prediction_id AS doc_ids FROM runs""",
    ),
)
def audit_runs(spark, d):
    """SNK5, SC12: nested columns stored, JSON only at the edge."""
    path = fresh_dir(spark, "runs")
    call = F.struct(
        F.lit("list_files").alias("tool"),
        F.create_map(F.lit("host_id"), F.col("host_id")).alias("args"),
        F.concat(F.col("files_deleted").cast("string"), F.lit(" files")).alias("output_summary"),
        F.lit(None).cast("string").alias("error"),
    )
    rows = V.runs(spark, d).withColumns(
        {"tool_calls": F.array(call), "doc_ids": F.array("prediction_id")}
    )
    sinks.append_runs(rows, path)
    stored = sinks.as_json(spark.read.parquet(path))
    return stored.select("run_id", "tool_calls", F.array_join("doc_ids", ",").alias("doc_ids"))


@register(
    "sink_link_tickets",
    with_views(
        "runs tickets",
        """SELECT r.run_id, r.decision, coalesce(t.ticket_id, r.ticket_id) AS ticket_id FROM runs r
           LEFT JOIN tickets t ON t.agent_run_id = r.run_id""",
    ),
)
def link_tickets(spark, d):
    """SNK6."""
    return sinks.link_tickets(V.runs(spark, d), V.tickets(spark, d)).select("run_id", "decision", "ticket_id")


_CHANGES = """changes AS (
  SELECT ticket_id, 'closed' AS status FROM tickets WHERE status = 'resolved'
  UNION ALL SELECT 'INC-0000-00-' || p_partkey, 'closed' FROM part)"""


@register(
    "sink_update_status",
    with_views(
        "tickets",
        f"""SELECT t.ticket_id, coalesce(c.status, t.status) AS status,
              {qstamp("CASE WHEN c.status IS NULL THEN t.updated_at ELSE TIMESTAMP '2024-02-01' END")} AS updated_at, true AS known
            FROM tickets t LEFT JOIN changes c USING (ticket_id)
            UNION ALL SELECT ticket_id, NULL, NULL, false FROM changes WHERE ticket_id NOT IN (SELECT ticket_id FROM tickets)""",
        _CHANGES,
    ),
)
def update_status(spark, d):
    """SNK7: resolved tickets close; ids that do not exist are reported."""
    rows = V.tickets(spark, d)
    changes = rows.where("status = 'resolved'").select("ticket_id", F.lit("closed").alias("status")).unionByName(
        V.read(spark, d, "part").select(
            F.concat(F.lit("INC-0000-00-"), F.col("p_partkey")).alias("ticket_id"), F.lit("closed").alias("status")
        )
    )
    table = KeyedTable(spark, fresh_dir(spark, "tickets"), ["ticket_id"])
    table.merge(rows, lambda old, new: new)
    unknown = sinks.update_stored_status(table, changes, CHANGED_AT)
    null = F.lit(None).cast("string")
    return table.read().select(
        "ticket_id", "status", stamp("updated_at").alias("updated_at"), F.lit(True).alias("known")
    ).unionByName(
        unknown.select("ticket_id", null.alias("status"), null.alias("updated_at"), F.lit(False).alias("known"))
    )


@register("sink_replace_corpus", with_views("corpus", "SELECT doc_id, source, title, content FROM corpus"))
def replace_corpus(spark, d):
    """SNK8: loading twice leaves one copy."""
    path = fresh_dir(spark, "corpus")
    for _ in range(2):
        sinks.replace_table(V.corpus(spark, d), path)
    return spark.read.parquet(path).select("doc_id", "source", "title", "content")


@register(
    "sink_delete",
    with_views(
        "telemetry hosts",
        f"""SELECT host_id, {qstamp('ts')} AS ts, in_use_pct FROM telemetry
            WHERE NOT starts_with(host_id, 'demo-') AND host_id NOT IN (SELECT host_id FROM hosts WHERE environment = 'dev')""",
    ),
)
def delete(spark, d):
    """SNK9: by prefix, and from the stored table by a table of ids."""
    table = KeyedTable(spark, fresh_dir(spark, "telemetry"), ["host_id"])
    table.merge(sinks.delete_prefix(V.telemetry(spark, d), "demo-"), lambda old, new: new)
    table.remove(V.hosts(spark, d).where("environment = 'dev'").select("host_id"))
    return table.read().select("host_id", stamp("ts").alias("ts"), "in_use_pct")


@register(
    "sink_retention",
    with_views("telemetry now", f"SELECT host_id, device, {qstamp('ts')} AS ts FROM telemetry, now WHERE ts >= as_of - INTERVAL 14 DAY"),
)
def retention(spark, d):
    """SNK10 with a limit of 14 days; the sample holds 30."""
    kept = sinks.retained(V.telemetry(spark, d), V.as_of(spark, d), 14)
    return sinks.rewrite(kept, "telemetry").select("host_id", "device", stamp("ts").alias("ts"))


@register(
    "sink_directory_samples",
    with_views(
        "files hosts",
        f"""SELECT host_id, device, total_bytes, used_bytes, total_bytes - used_bytes AS free_bytes,
              {exact('100.0::DOUBLE * used_bytes / total_bytes', 3)} AS in_use_pct
            FROM (SELECT host_id, monitored_path AS device, CAST(floor(total_disk_gb * 1073741824) AS BIGINT) AS total_bytes,
                    CAST(least(used, CAST(floor(total_disk_gb * 1073741824) AS BIGINT) - 1) AS BIGINT) AS used_bytes
                  FROM hosts JOIN (SELECT host_id, CAST(sum(size_bytes) AS BIGINT) AS used FROM files GROUP BY 1) USING (host_id))""",
    ),
)
def directory_samples(spark, d):
    """SNK11."""
    return gaps.directory_samples(V.files(spark, d), V.hosts(spark, d), V.files_as_of(spark, d)).drop("ts")


@register(
    "sink_backfill",
    with_views(
        "latest_sample now telemetry",
        f"""SELECT host_id, device, {qstamp('ts')} AS ts, in_use_pct FROM telemetry
            UNION ALL
            SELECT host_id, device, {qstamp('slot')}, in_use_pct FROM (
              SELECT host_id, device, in_use_pct, unnest(generate_series(
                date_trunc('minute', as_of) - INTERVAL 29 MINUTE, date_trunc('minute', as_of), INTERVAL 1 MINUTE)) AS slot
              FROM latest_sample, now)""",
    ),
)
def backfill(spark, d):
    """SNK12, SNK1: thirty one-minute samples per host next to the stored ones."""
    path = fresh_dir(spark, "telemetry")
    rows = V.telemetry(spark, d)
    sinks.insert_ignore(rows, path)
    sinks.insert_ignore(gaps.backfill(latest_telemetry(rows), V.as_of(spark, d), 30), path)
    return spark.read.parquet(path).select("host_id", "device", stamp("ts").alias("ts"), "in_use_pct")


@register(
    "agg_daily_rollup",
    with_views(
        "telemetry",
        f"""SELECT host_id, {qstamp("date_trunc('day', ts)")} AS day, count(*) AS n, {q9('avg(in_use_pct)')} AS mean_pct
            FROM telemetry GROUP BY host_id, date_trunc('day', ts)""",
    ),
)
def daily(spark, d):
    """EXT2 by day."""
    rows = telemetry_rollup(V.telemetry(spark, d), "1 day", keys=("host_id",))
    return rows.select("host_id", stamp("window_start").alias("day"), "n", r9("mean_pct").alias("mean_pct"))


