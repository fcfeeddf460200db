from __future__ import annotations

from pyspark.sql import functions as F

from brimwatch.config import Settings
from brimwatch.operators.forecast import FORECAST_COLUMNS
from brimwatch.plans.cycle import run_cycle, score_fleet, score_host
from brimwatch.plans.registered.base import r6, r9, register, stamp
from brimwatch.plans.registered.forecasts import FORECAST_SQL, SEASONAL_SQL
from brimwatch.plans.registered.texts import counts_sql, counts_text
from brimwatch.plans.sqlviews import q_redaction, r6 as q6, r9 as q9, stamp as qstamp, with_views
from brimwatch.session import fresh_dir
from brimwatch.sources import sample as V
from brimwatch.streaming import jobs


def samples(spark, d, one_device=False):
    return V.shape_events(V.stream(spark, d, "events"), one_device)


def drain(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register(
    "stream_ingest",
    with_views("telemetry", f"SELECT host_id, device, {qstamp('ts')} AS ts, in_use_pct FROM telemetry"),
)
def ingest(spark, d):
    """ST1, ST5: every sample sent twice, stored once."""
    table = fresh_dir(spark, "stream-telemetry")
    rows = samples(spark, d)
    drain(jobs.ingest(rows.unionByName(samples(spark, d)), table, fresh_dir(spark, "state")))
    return spark.read.parquet(table).select("host_id", "device", stamp("ts").alias("ts"), "in_use_pct")


@register(
    "stream_latest",
    with_views("latest_sample", f"SELECT host_id, {qstamp('ts')} AS ts, device, in_use_pct FROM latest_sample"),
)
def latest(spark, d):
    """ST2: equal to the batch answer."""
    table = fresh_dir(spark, "stream-latest")
    drain(jobs.latest(samples(spark, d), table, fresh_dir(spark, "state")))
    return jobs.read_latest(spark, table).select("host_id", stamp("ts").alias("ts"), "device", "in_use_pct")


def _windows(spark, d, width, slide=None):
    table = fresh_dir(spark, "stream-windows")
    drain(jobs.windows(samples(spark, d), table, fresh_dir(spark, "state"), width, slide))
    return jobs.read_windows(spark, table).select(
        "host_id", stamp("window_start").alias("window_start"), "n",
        r9("mean_pct").alias("mean_pct"), r6("max_pct").alias("max_pct"),
    )


@register(
    "stream_tumbling",
    with_views(
        "telemetry",
        f"""SELECT host_id, {qstamp("date_trunc('hour', ts)")} AS window_start, count(*) AS n,
              {q9('avg(in_use_pct)')} AS mean_pct, {q6('max(in_use_pct)')} AS max_pct
            FROM telemetry GROUP BY host_id, date_trunc('hour', ts)""",
    ),
)
def tumbling(spark, d):
    """EXT3."""
    return _windows(spark, d, "1 hour")


@register(
    "stream_sliding",
    with_views(
        "telemetry",
        f"""SELECT host_id, {qstamp('start')} AS window_start, count(*) AS n,
              {q9('avg(in_use_pct)')} AS mean_pct, {q6('max(in_use_pct)')} AS max_pct
            FROM (SELECT host_id, in_use_pct, unnest(generate_series(
                    date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS start FROM telemetry)
            GROUP BY host_id, start""",
    ),
)
def sliding(spark, d):
    """EXT3."""
    return _windows(spark, d, "24 hours", "1 hour")


@register(
    "stream_redact",
    with_views(
        "",
        f"SELECT doc_id, text, {counts_sql()} AS counts FROM redacted",
        q_redaction("documents"),
    ),
)
def redact(spark, d):
    """ST4 over whole documents."""
    table = fresh_dir(spark, "stream-texts")
    texts = V.stream(spark, d, "documents").select("doc_id", "text")
    drain(jobs.redacted(texts, ["text"], table, fresh_dir(spark, "state")))
    return spark.read.parquet(table).select("doc_id", "text", counts_text().alias("counts"))


@register(
    "stream_scored",
    with_views(
        "host_telemetry",
        f"""SELECT host_id, device, {FORECAST_SQL},
              coalesce(forecast_7d_pct >= 90, false) OR coalesce(hours_to_90pct <= 168, false) AS triggered_agent FROM forecasts""",
        SEASONAL_SQL,
    ),
)
def scored(spark, d):
    """ST3: hosts that reported are scored over the stored history."""
    table = fresh_dir(spark, "stream-scores")
    now = V.as_of(spark, d)

    def score(rows):
        return score_fleet(rows, now, None, Settings(history_days=30), "seasonal")

    drain(
        jobs.scored(
            samples(spark, d, True), score, lambda: V.telemetry(spark, d, one_device=True),
            table, fresh_dir(spark, "state"),
        )
    )
    return jobs.read_scores(spark, table).select(
        "host_id", "device", *[r6(name).alias(name) for name in FORECAST_COLUMNS], "triggered_agent"
    )


@register(
    "cycle_replay",
    with_views(
        "host_telemetry",
        f"""SELECT host_id, device, {FORECAST_SQL}, 0.0::DOUBLE AS anomaly_score,
              coalesce(forecast_7d_pct >= 90, false) OR coalesce(hours_to_90pct <= 168, false) AS triggered_agent FROM forecasts""",
        SEASONAL_SQL,
    ),
)
def replay(spark, d):
    """CYC1, SNK4: a cycle without a model, run twice at the same time; its predictions are stored once."""
    path = fresh_dir(spark, "predictions")
    for _ in range(2):
        run_cycle(
            V.telemetry(spark, d, one_device=True), V.as_of(spark, d), None, path, Settings(history_days=30), "seasonal"
        )
    return spark.read.parquet(path).select(
        "host_id", "device", *[r6(name).alias(name) for name in FORECAST_COLUMNS], "anomaly_score", "triggered_agent"
    )


@register(
    "cycle_one_host",
    with_views(
        "host_telemetry",
        f"""SELECT host_id, device, {FORECAST_SQL}, 0.0::DOUBLE AS anomaly_score,
              coalesce(forecast_7d_pct >= 90, false) OR coalesce(hours_to_90pct <= 168, false) AS triggered_agent
            FROM forecasts WHERE host_id = (SELECT min(host_id) FROM host_telemetry)""",
        SEASONAL_SQL,
    ),
)
def one_host(spark, d):
    """CYC2: the cycle on demand for one host, the first by name."""
    rows = V.telemetry(spark, d, one_device=True)
    name = rows.agg(F.min("host_id")).first()[0]
    scored = score_host(rows, name, V.as_of(spark, d), None, Settings(history_days=30), "seasonal")
    return scored.select(
        "host_id", "device", *[r6(name).alias(name) for name in FORECAST_COLUMNS], "anomaly_score", "triggered_agent"
    )


@register(
    "stream_late_rows",
    with_views(
        "telemetry",
        f"""SELECT host_id, device, {qstamp('ts')} AS ts, in_use_pct FROM telemetry
            UNION ALL SELECT host_id, device, {qstamp('ts - INTERVAL 40 DAY')}, in_use_pct FROM telemetry""",
    ),
)
def late_rows(spark, d):
    """ST1, ST5: after the samples, a second job over the table brings the same ones 40 days older, and the first again."""
    table = fresh_dir(spark, "stream-telemetry")
    rows = samples(spark, d)
    drain(jobs.ingest(rows, table, fresh_dir(spark, "state")))
    late = samples(spark, d).withColumn("ts", F.col("ts") - F.expr("INTERVAL 40 DAYS"))
    drain(jobs.ingest(late.unionByName(samples(spark, d)), table, fresh_dir(spark, "state")))
    return spark.read.parquet(table).select("host_id", "device", stamp("ts").alias("ts"), "in_use_pct")
