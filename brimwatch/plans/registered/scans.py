from __future__ import annotations

from pyspark.sql import functions as F

from brimwatch.functions.scalar import hours_between
from brimwatch.operators import context, fleet, validate
from brimwatch.operators.skew import series_context
from brimwatch.plans.registered.base import r6, register, stamp
from brimwatch.plans.sqlviews import hid, r6 as q6, stamp as qstamp, with_views
from brimwatch.sources import sample as V
from brimwatch.sources import scans


@register(
    "src_trailing_window",
    with_views(
        "telemetry now",
        f"SELECT host_id, device, {qstamp('ts')} AS ts, in_use_pct FROM telemetry, now "
        "WHERE ts >= as_of - INTERVAL 7 DAY",
    ),
)
def trailing_window(spark, d):
    """SRC1."""
    rows = scans.trailing(V.telemetry(spark, d), V.as_of(spark, d), 7)
    return rows.select("host_id", "device", stamp("ts").alias("ts"), "in_use_pct")


@register(
    "src_pinned_series",
    with_views(
        "telemetry",
        f"SELECT host_id, device, {qstamp('ts')} AS ds, in_use_pct AS y FROM telemetry "
        "WHERE (host_id, device) IN (SELECT (host_id, arg_min(device, ts)) FROM telemetry GROUP BY host_id)",
    ),
)
def pinned_series(spark, d):
    """SRC2, PRJ1 for every host."""
    points = scans.as_points(scans.pinned_series(V.telemetry(spark, d)))
    return points.withColumn("ds", stamp("ds"))


@register(
    "src_host_inventory",
    with_views(
        "hosts",
        "SELECT host_id, hostname, os, environment, region, role, total_disk_gb, monitored_path, "
        "starts_with(host_id, 'demo-') AS is_demo_host FROM hosts",
    ),
)
def host_inventory(spark, d):
    """SRC3."""
    return fleet.host_inventory(V.hosts(spark, d)).drop("created_at")


@register(
    "src_recent_samples",
    with_views(
        "telemetry now",
        f"SELECT host_id, {qstamp('ts')} AS ts, in_use_pct, used_bytes, free_bytes FROM telemetry, now "
        "WHERE ts >= as_of - INTERVAL 168 HOUR",
    ),
)
def recent_samples(spark, d):
    """SRC4 for every host."""
    rows = scans.recent_of_all(V.telemetry(spark, d), V.as_of(spark, d))
    return rows.select("host_id", stamp("ts").alias("ts"), "in_use_pct", "used_bytes", "free_bytes")


@register(
    "src_prediction_history",
    with_views(
        "predictions",
        f"SELECT host_id, prediction_id, {qstamp('ts')} AS ts, {q6('anomaly_score')} AS anomaly_score, "
        "row_number() OVER (PARTITION BY host_id ORDER BY ts DESC, prediction_id) AS rank FROM predictions "
        "QUALIFY rank <= 50",
    ),
)
def prediction_history(spark, d):
    """SRC5, SRT1: the 50 newest predictions of every host."""
    rows = V.predictions(spark, d).select("host_id", "prediction_id", "ts", "anomaly_score")
    return fleet.newest_per_host(rows, "ts", "prediction_id").select(
        "host_id", "prediction_id", stamp("ts").alias("ts"), r6("anomaly_score").alias("anomaly_score"), "rank"
    )


@register(
    "src_run_list",
    with_views(
        "runs",
        f"SELECT run_id, host_id, {qstamp('started_at')} AS started_at, decision, verdict, bytes_freed FROM runs "
        "ORDER BY runs.started_at DESC, run_id LIMIT 50",
    ),
)
def run_list(spark, d):
    """SRC6."""
    return scans.list_runs(V.runs(spark, d)).select(
        "run_id", "host_id", stamp("started_at").alias("started_at"), "decision", "verdict", "bytes_freed"
    )


@register(
    "src_ticket_list",
    with_views(
        "tickets",
        f"SELECT ticket_id, {qstamp('created_at')} AS created_at, status, severity, host_id FROM tickets "
        "WHERE status = 'in_progress' AND severity = 'P2' ORDER BY tickets.created_at DESC, ticket_id LIMIT 200",
    ),
)
def ticket_list(spark, d):
    """SRC7."""
    rows = scans.list_tickets(V.tickets(spark, d), status="in_progress", severity="P2")
    return rows.select("ticket_id", stamp("created_at").alias("created_at"), "status", "severity", "host_id")


_LISTED = """
  listed AS (
    SELECT f.*, greatest(0.0::DOUBLE, (epoch_us(now) - epoch_us(mtime)) / 8.64e10::DOUBLE) AS age_days,
      split_part(path, '/', -1) AS name,
      row_number() OVER (PARTITION BY host_id ORDER BY size_bytes DESC, path) AS rank
    FROM files f, files_now WHERE split_part(path, '/', -1) <> '_seed_baseline.bin' QUALIFY rank <= 50),
  flagged AS (
    SELECT *, ends_with(name, '.log') AND NOT contains(name, '.log.1') AND NOT contains(name, '.log.2')
      AND NOT contains(name, 'archive') AND NOT contains(name, '-old') AND age_days < 1 AS is_active_log FROM listed)"""


@register(
    "src_file_listing",
    with_views(
        "files files_now",
        f"SELECT host_id, rank, path, size_bytes, {q6('age_days')} AS age_days, is_active_log FROM flagged",
        _LISTED.strip(),
    ),
)
def file_listing(spark, d):
    """SRC8, SRT2, SC10: the 50 largest files of every host."""
    top = context.largest_files(V.files(spark, d), V.files_as_of(spark, d))
    return top.select("host_id", "rank", "path", "size_bytes", r6("age_days").alias("age_days"), "is_active_log")


@register(
    "src_hosts_by_id",
    with_views(
        "hosts",
        f"SELECT {hid('p_partkey')} AS host_id, {hid('p_partkey')} IN (SELECT host_id FROM hosts) AS known FROM part",
    ),
)
def hosts_by_id(spark, d):
    """SRC9: asked ids (one per part) that are, or are not, in the inventory."""
    asked = V.read(spark, d, "part").select(V.host_id("p_partkey").alias("host_id"))
    found, unknown = scans.hosts_by_id(asked, V.hosts(spark, d))
    return found.select("host_id", F.lit(True).alias("known")).unionByName(
        unknown.select("host_id", F.lit(False).alias("known"))
    )


@register(
    "win_series_steps",
    with_views(
        "host_telemetry",
        f"""SELECT host_id, {qstamp('ts')} AS ts, in_use_pct AS value,
          (epoch_us(ts) - epoch_us(min(ts) OVER w)) / 3.6e9::DOUBLE AS t_hours,
          {q6("in_use_pct - lag(in_use_pct) OVER (PARTITION BY host_id ORDER BY ts)")} AS step,
          row_number() OVER (PARTITION BY host_id ORDER BY ts) - 1 AS position,
          count(*) OVER w AS n_rows,
          epoch_us(ts) >= epoch_us(max(ts) OVER w) - 86400000000 AS recent
        FROM host_telemetry WINDOW w AS (PARTITION BY host_id)""",
    ),
)
def series_steps(spark, d):
    """WIN1, WIN2, WIN3."""
    rows = series_context(V.telemetry(spark, d, one_device=True), ["host_id", "device"])
    return rows.select(
        "host_id",
        stamp("ts").alias("ts"),
        "value",
        hours_between(F.col("ts"), F.col("first_ts")).alias("t_hours"),
        r6(F.col("value") - F.col("prev_value")).alias("step"),
        "position",
        "n_rows",
        (F.unix_micros("ts") >= F.unix_micros("last_ts") - 86_400_000_000).alias("recent"),
    )


@register(
    "val_host_rows",
    with_views(
        "hosts",
        """SELECT host_id, concat_ws(',', CASE WHEN host_id IS NULL THEN 'host_id_missing' END,
             CASE WHEN os NOT IN ('windows', 'linux') THEN 'os_unknown' END,
             CASE WHEN environment NOT IN ('prod', 'dev') THEN 'environment_unknown' END,
             CASE WHEN total_disk_gb IS NULL THEN 'disk_missing' END) AS violations
           FROM hosts""",
    ),
)
def host_rows(spark, d):
    """VAL1, with a narrower set of environments so that rows do fail."""
    rules = validate.host_rules() | {"environment_unknown": F.col("environment").isin("prod", "dev")}
    return validate.check_rows(V.hosts(spark, d), rules).select(
        "host_id", F.array_join("violations", ",").alias("violations")
    )


@register(
    "val_ticket_rows",
    with_views(
        "tickets",
        """SELECT ticket_id, status NOT IN ('new', 'in_progress', 'resolved') OR severity NOT IN ('P1', 'P2', 'P3', 'P4') AS quarantined,
             concat_ws(',', CASE WHEN status NOT IN ('new', 'in_progress', 'resolved') THEN 'status_unknown' END,
               CASE WHEN severity NOT IN ('P1', 'P2', 'P3', 'P4') THEN 'severity_unknown' END) AS violations FROM tickets""",
    ),
)
def ticket_rows(spark, d):
    """VAL1: good and quarantined rows, with a narrower set of states so that rows do fail."""
    rules = validate.ticket_rules() | {"status_unknown": F.col("status").isin("new", "in_progress", "resolved")}
    good, bad = validate.split_rows(V.tickets(spark, d), rules)
    return good.select("ticket_id", F.lit(False).alias("quarantined"), F.lit("").alias("violations")).unionByName(
        bad.select("ticket_id", F.lit(True).alias("quarantined"), F.array_join("violations", ",").alias("violations"))
    )


@register(
    "val_telemetry_invariants",
    with_views(
        "telemetry",
        """SELECT host_id, count(*) AS n_rows, 0::BIGINT AS key_missing,
             count(*) FILTER (WHERE in_use_pct NOT BETWEEN 0 AND 100) AS pct_range,
             count(*) FILTER (WHERE total_bytes <= 0) AS total_not_positive,
             count(*) FILTER (WHERE used_bytes + free_bytes <> total_bytes) AS bytes_do_not_add_up
           FROM telemetry GROUP BY host_id""",
    ),
)
def telemetry_invariants(spark, d):
    """VAL2."""
    return validate.series_invariants(V.telemetry(spark, d))


@register(
    "val_series_order",
    with_views(
        "telemetry",
        """SELECT host_id, count(*) AS n_samples, count(*) - count(DISTINCT ts) AS n_repeated_ts
           FROM telemetry GROUP BY host_id""",
    ),
)
def series_order(spark, d):
    """VAL2."""
    return validate.series_order(V.telemetry(spark, d))


@register(
    "val_orphan_samples",
    with_views(
        "telemetry",
        f"SELECT host_id, {qstamp('ts')} AS ts, in_use_pct FROM telemetry "
        f"WHERE host_id NOT IN (SELECT {hid('s_suppkey')} FROM supplier)",
    ),
)
def orphan_samples(spark, d):
    """VAL3: samples whose host is not in the inventory of file servers."""
    servers = V.read(spark, d, "supplier").select(V.host_id("s_suppkey").alias("host_id"))
    rows = validate.orphans(V.telemetry(spark, d), servers, "host_id", "host_id")
    return rows.select("host_id", stamp("ts").alias("ts"), "in_use_pct")
