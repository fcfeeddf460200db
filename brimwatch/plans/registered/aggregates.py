from __future__ import annotations

from pyspark.sql import functions as F

from brimwatch.config import DEFAULTS
from brimwatch.functions import redact as R
from brimwatch.operators import anomaly, cleanup, fleet, gaps, latest, tickets
from brimwatch.operators.features import FEATURES, sample_period, series_features
from brimwatch.plans.registered.base import r6, r9, register, stamp
from brimwatch.plans.sqlviews import q_redaction, r6 as q6, r9 as q9, stamp as qstamp, with_views
from brimwatch.sources import sample as V


def features_sql(source: str) -> str:
    """Named parts ending in ``features``: the twelve values by plain window functions."""
    zero = lambda value: f"CASE WHEN n >= 5 THEN {value} ELSE 0.0::DOUBLE END"
    return f"""
      placed AS (
        SELECT host_id, device, ts, in_use_pct AS y,
          (epoch_us(ts) - epoch_us(min(ts) OVER w)) / 3.6e9::DOUBLE AS t,
          (epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w)) / 3.6e9::DOUBLE AS t_last,
          lag(in_use_pct) OVER o AS prev_y,
          (epoch_us(lag(ts) OVER o) - epoch_us(min(ts) OVER w)) / 3.6e9::DOUBLE AS prev_t
        FROM {source} WINDOW w AS (PARTITION BY host_id, device), o AS (PARTITION BY host_id, device ORDER BY ts)),
      sums AS (
        SELECT host_id, device, count(*) AS n, count(*) FILTER (WHERE t >= t_last - 24) AS n_recent,
          avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max,
          CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE coalesce(regr_slope(y, t), 0.0::DOUBLE) END AS slope,
          regr_slope(y, t) FILTER (WHERE t >= t_last - 24) AS slope_recent,
          var_pop(y) AS vy, var_pop(t) AS vt,
          max(CASE WHEN prev_t >= t_last - 24 THEN abs(y - prev_y) END) AS jump,
          quantile_cont(y, 0.9) - quantile_cont(y, 0.1) AS tails, arg_max(y, ts) AS current
        FROM placed GROUP BY host_id, device),
      features AS (
        SELECT host_id, device, n, {zero('mean')} AS mean, {zero('std')} AS std, {zero('min')} AS min, {zero('max')} AS max,
          {zero('max - min')} AS range, {zero('slope')} AS slope_full,
          {zero('CASE WHEN n_recent >= 2 THEN coalesce(slope_recent, 0.0) ELSE slope END')} AS slope_recent_24h,
          {zero('CASE WHEN n_recent >= 2 THEN coalesce(slope_recent, 0.0) ELSE slope END - slope')} AS slope_acceleration,
          {zero('sqrt(greatest(0.0, vy - slope * slope * vt))')} AS residual_std,
          {zero('coalesce(jump, 0.0)')} AS max_abs_jump_24h, {zero('tails')} AS p90_minus_p10, {zero('current')} AS current_value
        FROM sums)"""


FEATURE_SQL = ", ".join(f"{(q9 if name == 'mean' else q6)(name)} AS {name}" for name in FEATURES)


def feature_columns():
    return [(r9 if name == "mean" else r6)(name).alias(name) for name in FEATURES]


def rounded_features(features):
    return features.select("host_id", "device", *feature_columns())


@register(
    "agg_features",
    with_views("host_telemetry", f"SELECT host_id, device, {FEATURE_SQL} FROM features", features_sql("host_telemetry").strip()),
)
def features(spark, d):
    """AG1-AG10, one series per host."""
    return rounded_features(series_features(V.telemetry(spark, d, one_device=True)))


@register(
    "agg_features_by_device",
    with_views("telemetry", f"SELECT host_id, device, {FEATURE_SQL} FROM features", features_sql("telemetry").strip()),
)
def features_by_device(spark, d):
    """AG1-AG10, several devices per host; short series are all zero."""
    return rounded_features(series_features(V.telemetry(spark, d)))


PERIOD_SQL = """
  steps AS (
    SELECT host_id, device, CAST(coalesce(greatest(1, round_even(quantile_cont(gap, 0.5) / 6.0e7::DOUBLE, 0)), 5) AS INTEGER) AS step_minutes
    FROM (SELECT host_id, device, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host_id, device ORDER BY ts)) AS gap FROM host_telemetry)
    GROUP BY host_id, device)"""


@register(
    "agg_sample_period",
    with_views("host_telemetry", "SELECT host_id, device, step_minutes FROM steps", PERIOD_SQL.strip()),
)
def period(spark, d):
    """AG17."""
    return sample_period(V.telemetry(spark, d, one_device=True))


@register("agg_trigger_counts", with_views("predictions", "SELECT triggered_agent, count(*) AS n FROM predictions GROUP BY 1"))
def trigger_counts(spark, d):
    """AG11."""
    return fleet.trigger_counts(V.predictions(spark, d))


@register(
    "agg_fleet_kpis",
    with_views(
        "fleet",
        """SELECT count(*) AS total, count(*) FILTER (WHERE triggered_agent) AS triggered,
             count(*) FILTER (WHERE anomaly_score >= 0.6::DOUBLE) AS anomalous,
             count(*) FILTER (WHERE forecast_7d_pct >= 90) AS breach_in_7d,
             count(*) FILTER (WHERE is_demo_host) AS demo_count FROM fleet""",
    ),
)
def fleet_kpis(spark, d):
    """AG12."""
    return fleet.fleet_kpis(
        fleet.fleet_overview(V.hosts(spark, d), V.telemetry(spark, d), V.predictions(spark, d))
    )


@register(
    "agg_ticket_kpis",
    with_views(
        "tickets",
        """SELECT count(*) FILTER (WHERE status NOT IN ('resolved', 'closed')) AS open_tickets,
             count(*) FILTER (WHERE severity IN ('P1', 'P2')) AS p1_p2 FROM tickets""",
    ),
)
def ticket_kpis(spark, d):
    """AG13."""
    return fleet.ticket_kpis(V.tickets(spark, d))


@register(
    "agg_table_counts",
    with_views(
        "hosts predictions runs tickets latest_prediction",
        """SELECT 'hosts' AS item, count(*) AS n FROM hosts UNION ALL SELECT 'predictions', count(*) FROM predictions
           UNION ALL SELECT 'agent_runs', count(*) FROM runs UNION ALL SELECT 'tickets', count(*) FROM tickets
           UNION ALL SELECT 'triggered', count(*) FROM latest_prediction WHERE triggered_agent""",
    ),
)
def table_counts(spark, d):
    """AG14, SET1, LAT3."""
    return fleet.table_counts(
        V.hosts(spark, d), V.predictions(spark, d), V.runs(spark, d), V.tickets(spark, d)
    )


@register(
    "agg_cycle_stats",
    with_views(
        "predictions",
        f"""SELECT count(DISTINCT (host_id, device)) AS hosts, count(*) AS predictions,
             count(*) FILTER (WHERE triggered_agent) AS triggered, {q6('max(anomaly_score)')} AS max_score,
             {q6('avg(anomaly_score)')} AS mean_score FROM predictions""",
    ),
)
def cycle_stats(spark, d):
    """AG15."""
    return fleet.cycle_stats(V.predictions(spark, d)).select(
        "hosts", "predictions", "triggered", r6("max_score").alias("max_score"), r6("mean_score").alias("mean_score")
    )


@register("agg_label_histogram", with_views("series_labels", "SELECT label, count(*) AS n FROM series_labels GROUP BY 1"))
def label_histogram(spark, d):
    """AG16."""
    return fleet.label_histogram(V.series_labels(spark, d))


@register(
    "agg_redaction_totals",
    with_views("planted", "SELECT category, hits FROM totals WHERE hits > 0", q_redaction("planted")),
)
def redaction_totals(spark, d):
    """AG18 over whole documents."""
    return R.redaction_totals(V.redaction_corpus(spark, d), columns=["text"])


@register(
    "agg_cleanup_totals",
    with_views(
        "cleanup_plan",
        """SELECT host_id, CAST(coalesce(sum(size_bytes) FILTER (WHERE action = 'delete'), 0) AS BIGINT) AS bytes_freed,
             CAST(count(*) FILTER (WHERE action = 'delete') AS INTEGER) AS files_deleted, count(*) AS n_candidates
           FROM cleanup_plan GROUP BY host_id""",
    ),
)
def cleanup_totals(spark, d):
    """AG19."""
    return cleanup.plan_totals(
        cleanup.cleanup_plan(V.files(spark, d), V.hosts(spark, d), V.files_as_of(spark, d))
    )


@register(
    "agg_class_weight",
    with_views(
        "host_telemetry series_labels",
        f"""SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
              {q6('CASE WHEN sum(y) > 0 THEN (count(*) - sum(y)) / CAST(sum(y) AS DOUBLE) ELSE 1.0::DOUBLE END')} AS weight
            FROM (SELECT host_id, device, max(CASE WHEN label = 'anomalous' THEN 1 ELSE 0 END) AS y
                  FROM host_telemetry LEFT JOIN series_labels USING (host_id) GROUP BY host_id, device)""",
    ),
)
def class_weight(spark, d):
    """AG21, ML1, JN4."""
    rows = anomaly.training_set(V.telemetry(spark, d, one_device=True), V.series_labels(spark, d))
    return anomaly.class_weight(rows).withColumn("weight", r6("weight"))


@register(
    "agg_last_ticket_number",
    with_views(
        "tickets",
        """SELECT substr(ticket_id, 1, 12) AS prefix, max(CAST(split_part(ticket_id, '-', 4) AS INTEGER)) AS last_number
           FROM tickets GROUP BY 1""",
    ),
)
def last_ticket_number(spark, d):
    """AG22, SC6."""
    return tickets.last_numbers(V.tickets(spark, d))


_STATUSES = ("no_prediction", "anomalous", "predictive", "critical", "healthy")


@register(
    "agg_status_rollup",
    with_views(
        "fleet",
        "SELECT environment, role, CAST(grouping(environment) * 2 + grouping(role) AS BIGINT) AS level, count(*) AS hosts, "
        + ", ".join(f"count(*) FILTER (WHERE status = '{name}') AS {name}" for name in _STATUSES)
        + " FROM fleet GROUP BY ROLLUP (environment, role)",
    ),
)
def status_rollup(spark, d):
    """EXT1."""
    return fleet.status_rollup(
        fleet.fleet_overview(V.hosts(spark, d), V.telemetry(spark, d), V.predictions(spark, d))
    )


@register(
    "agg_hourly_rollup",
    with_views(
        "telemetry",
        f"""SELECT host_id, device, {qstamp("date_trunc('hour', ts)")} AS window_start, count(*) AS n,
              {q9('avg(in_use_pct)')} AS mean_pct, {q6('max(in_use_pct)')} AS max_pct
            FROM telemetry GROUP BY host_id, device, date_trunc('hour', ts)""",
    ),
)
def hourly_rollup(spark, d):
    """EXT2."""
    return fleet.telemetry_rollup(V.telemetry(spark, d)).select(
        "host_id", "device", stamp("window_start").alias("window_start"), "n",
        r9("mean_pct").alias("mean_pct"), r6("max_pct").alias("max_pct"),
    )


@register(
    "latest_telemetry",
    with_views(
        "latest_sample",
        f"SELECT host_id, {qstamp('ts')} AS ts, device, in_use_pct, used_bytes, total_bytes FROM latest_sample",
    ),
)
def latest_telemetry(spark, d):
    """LAT1."""
    return latest.latest_telemetry(V.telemetry(spark, d)).select(
        "host_id", stamp("ts").alias("ts"), "device", "in_use_pct", "used_bytes", "total_bytes"
    )


@register(
    "latest_predictions",
    with_views(
        "predictions",
        f"""SELECT host_id, device, prediction_id, {qstamp('ts')} AS ts, triggered_agent FROM predictions
            WHERE host_id IN (SELECT host_id FROM predictions GROUP BY host_id HAVING count(*) > 5)
            QUALIFY row_number() OVER (PARTITION BY host_id, device ORDER BY predictions.ts DESC, prediction_id DESC) = 1""",
    ),
)
def latest_predictions(spark, d):
    """LAT2, PRJ4: for a table of wanted hosts, those with more than five predictions."""
    rows = V.predictions(spark, d)
    busy = rows.groupBy("host_id").agg(F.count("*").alias("n")).where("n > 5")
    return latest.latest_predictions(rows, busy).select(
        "host_id", "device", "prediction_id", stamp("ts").alias("ts"), "triggered_agent"
    )


@register("latest_triggered_hosts", with_views("latest_prediction", "SELECT host_id FROM latest_prediction WHERE triggered_agent"))
def triggered_hosts(spark, d):
    """LAT3."""
    return latest.triggered_hosts(V.predictions(spark, d))


@register(
    "gap_missing_slots",
    with_views(
        "hosts latest_sample now",
        f"""SELECT host_id, device, {qstamp('ts')} AS ts FROM (
              SELECT h.host_id, h.monitored_path AS device,
                unnest(generate_series(l.ts + INTERVAL 5 MINUTE, date_trunc('minute', as_of), INTERVAL 5 MINUTE)) AS ts
              FROM hosts h JOIN latest_sample l ON h.host_id = l.host_id, now)""",
    ),
)
def missing_slots(spark, d):
    """GAP1, JN5."""
    rows = gaps.missing_slots(
        V.hosts(spark, d), V.telemetry(spark, d), V.as_of(spark, d), DEFAULTS.interval_minutes
    )
    return rows.withColumn("ts", stamp("ts"))


@register(
    "gap_fill_forward",
    with_views(
        "host_telemetry now",
        f"""SELECT g.host_id, g.device, {qstamp('g.ts')} AS ts, t.in_use_pct FROM grid g
            ASOF JOIN host_telemetry t ON g.host_id = t.host_id AND g.device = t.device AND g.ts >= t.ts""",
        """grid AS (
             SELECT host_id, device, make_timestamp(us) AS ts FROM (
               SELECT host_id, device, unnest(generate_series(
                   CAST(ceil(epoch_us(min(ts)) / 3.6e9::DOUBLE) AS BIGINT) * 3600000000, epoch_us(any_value(as_of)), 3600000000)) AS us
               FROM host_telemetry, now GROUP BY host_id, device))""",
    ),
)
def fill_forward(spark, d):
    """GAP2 on an hourly grid."""
    rows = gaps.fill_forward(V.telemetry(spark, d, one_device=True), V.as_of(spark, d), 60)
    return rows.withColumn("ts", stamp("ts"))

