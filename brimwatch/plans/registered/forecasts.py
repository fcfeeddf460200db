from __future__ import annotations

from pyspark.sql import functions as F

from brimwatch.operators import forecast, trigger
from brimwatch.operators.features import FEATURES, period_of
from brimwatch.operators.skew import series_context
from brimwatch.plans.cycle import at_risk
from brimwatch.plans.registered.aggregates import PERIOD_SQL, feature_columns, features_sql
from brimwatch.plans.registered.base import r6, register, stamp
from brimwatch.plans.sqlviews import r6 as q6, r9 as q9, stamp as qstamp, with_views
from brimwatch.schemas import SERIES_KEY
from brimwatch.sources import sample as V

SEASONAL_SQL = f"""{PERIOD_SQL.strip()},
  timed AS (
    SELECT host_id, device, ts, in_use_pct AS y, min(ts) OVER w AS first_ts,
      (epoch_us(ts) - epoch_us(min(ts) OVER w)) / 3.6e9::DOUBLE AS t
    FROM host_telemetry WINDOW w AS (PARTITION BY host_id, device)),
  lines AS (
    SELECT host_id, device, count(*) AS n, coalesce(regr_slope(y, t), 0.0::DOUBLE) AS slope,
      avg(y) - coalesce(regr_slope(y, t), 0.0::DOUBLE) * avg(t) AS intercept, min(ts) AS first_ts, max(ts) AS last_ts
    FROM timed GROUP BY host_id, device),
  hourly AS (
    SELECT host_id, device, hour(ts) AS hour, avg(y - intercept - slope * t) AS residual
    FROM timed JOIN lines USING (host_id, device) GROUP BY ALL),
  points AS (
    SELECT host_id, device, first_ts, slope, intercept, k * step_minutes AS ahead,
      last_ts + to_minutes(CAST(k * step_minutes AS BIGINT)) AS ts
    FROM (SELECT *, unnest(generate_series(1, CAST(floor(20160 / step_minutes) AS BIGINT))) AS k
          FROM lines JOIN steps USING (host_id, device) WHERE n >= 24)),
  grid AS (
    SELECT p.host_id, p.device, p.ts, p.ahead, least(100.0::DOUBLE, greatest(0.0::DOUBLE,
      intercept + slope * ((epoch_us(p.ts) - epoch_us(first_ts)) / 3.6e9::DOUBLE) + coalesce(residual, 0.0::DOUBLE))) AS yhat
    FROM points p LEFT JOIN hourly h ON p.host_id = h.host_id AND p.device = h.device AND hour(p.ts) = h.hour),
  read AS (
    SELECT host_id, device,
      arg_min(yhat, ahead) FILTER (WHERE ahead >= 1440) AS forecast_1d_pct,
      arg_min(yhat, ahead) FILTER (WHERE ahead >= 4320) AS forecast_3d_pct,
      arg_min(yhat, ahead) FILTER (WHERE ahead >= 10080) AS forecast_7d_pct,
      arg_min(yhat, ahead) FILTER (WHERE ahead >= 20160) AS forecast_14d_pct,
      min(ahead) FILTER (WHERE yhat >= 90) / 60.0::DOUBLE AS hours_to_90pct
    FROM grid GROUP BY host_id, device),
  forecasts AS (SELECT lines.host_id, lines.device, read.* EXCLUDE (host_id, device)
                FROM lines LEFT JOIN read USING (host_id, device))"""

FORECAST_SQL = ", ".join(f"{q6(name)} AS {name}" for name in forecast.FORECAST_COLUMNS)


def _rounded(df):
    return df.select("host_id", "device", *[r6(name).alias(name) for name in forecast.FORECAST_COLUMNS])


@register("forecast_seasonal", with_views("host_telemetry", f"SELECT host_id, device, {FORECAST_SQL} FROM forecasts", SEASONAL_SQL))
def seasonal(spark, d):
    """FC1b, FC2-FC5."""
    return _rounded(forecast.seasonal_forecast(V.telemetry(spark, d, one_device=True)))


@register(
    "forecast_grid",
    with_views("host_telemetry", f"SELECT host_id, {qstamp('ts')} AS ts, {q6('yhat')} AS yhat FROM grid", SEASONAL_SQL),
)
def grid(spark, d):
    """FC2."""
    rows = series_context(V.telemetry(spark, d, one_device=True), SERIES_KEY)
    model = forecast.seasonal_model(rows, period_of(rows))
    points = forecast.forecast_grid(model).where(F.col("ahead_minutes").isNotNull())
    return points.select("host_id", stamp("ts").alias("ts"), r6("yhat").alias("yhat"))


@register("forecast_piecewise")
def piecewise(spark, d):
    """FC1, FC2-FC5."""
    return _rounded(forecast.piecewise_forecast(V.telemetry(spark, d, one_device=True)))


@register(
    "trigger_rule",
    with_views(
        "host_telemetry",
        f"""SELECT host_id, device, {FORECAST_SQL},
              coalesce(forecast_7d_pct >= 90, false) OR coalesce(hours_to_90pct <= 168, false) AS triggered_agent FROM forecasts""",
        SEASONAL_SQL,
    ),
)
def trigger_rule(spark, d):
    """TRG1 on seasonal forecasts."""
    rows = forecast.seasonal_forecast(V.telemetry(spark, d, one_device=True))
    scored = rows.withColumn("anomaly_score", F.lit(0.0))
    return trigger.with_trigger(scored).select(
        "host_id", "device",
        *[r6(name).alias(name) for name in forecast.FORECAST_COLUMNS], "triggered_agent",
    )


@register(
    "trigger_at_risk",
    with_views(
        "host_telemetry",
        "SELECT f.host_id, f.device, "
        + ", ".join(f"{(q9 if name == 'mean' else q6)(f'f.{name}')} AS {name}" for name in FEATURES)
        + f""", {q6('line')} AS forecast_7d_pct, line >= 90 AS triggered_agent
            FROM features f JOIN ahead USING (host_id, device)""",
        features_sql("host_telemetry").strip()
        + """, ahead AS (SELECT host_id, device, least(100.0::DOUBLE, greatest(0.0::DOUBLE,
               regr_intercept(y, t) + regr_slope(y, t) * (max(t) + 168))) AS line FROM placed GROUP BY host_id, device)""",
    ),
)
def at_risk_hosts(spark, d):
    """Which hosts pass the fill limit within seven days, with their features."""
    rows = at_risk(V.telemetry(spark, d, one_device=True))
    return rows.select(
        "host_id", "device", *feature_columns(),
        r6("forecast_7d_pct").alias("forecast_7d_pct"), "triggered_agent",
    )
