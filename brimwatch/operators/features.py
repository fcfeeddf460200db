"""Twelve features per (host, device) series (AG1-AG10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brimwatch.config import DEFAULTS, Settings
from brimwatch.functions.scalar import hours_between
from brimwatch.operators.percentiles import exact_percentiles
from brimwatch.operators.skew import by_length, series_context
from brimwatch.schemas import SERIES_KEY

# Feature names, in model input order.
FEATURES = (
    "mean", "std", "min", "max", "range",
    "slope_full", "slope_recent_24h", "slope_acceleration",
    "residual_std", "max_abs_jump_24h", "p90_minus_p10", "current_value",
)


def series_features(
    telemetry: DataFrame, keys=SERIES_KEY, settings: Settings = DEFAULTS
) -> DataFrame:
    """AG10. The twelve features of every series."""
    summary = series_summary(series_context(telemetry, keys), keys, settings)
    return summary.select(*keys, *FEATURES)


def series_summary(rows: DataFrame, keys=SERIES_KEY, settings: Settings = DEFAULTS) -> DataFrame:
    """AG1-AG10, AG17 of samples in their series order: features and ``step_minutes``.

    One pass of mergeable aggregates: samples were shuffled once, and partial
    states per key are combined. Short series rank their values and distances in
    the same pass, for exact percentiles; those of hot series are searched
    besides, over counts per distinct value.
    """
    return by_length(rows, lambda part, hot: _summary(part, list(keys), settings, hot))


def _summary(rows: DataFrame, keys: list[str], settings: Settings, hot: bool) -> DataFrame:
    t = hours_between(F.col("ts"), F.col("first_ts"))
    t_last = hours_between(F.col("last_ts"), F.col("first_ts"))
    y = F.col("value")
    rows = rows.select(
        *keys,
        "ts",
        "prev_ts",
        y.alias("y"),
        t.alias("t"),
        (t >= t_last - 24.0).alias("recent"),
        F.when(
            hours_between(F.col("prev_ts"), F.col("first_ts")) >= t_last - 24.0,
            F.abs(y - F.col("prev_value")),
        ).alias("jump"),
    )
    sums = [
        F.count("*").alias("n"),
        F.count_if("recent").alias("n_recent"),
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("std"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        F.regr_slope("y", "t").alias("fit"),
        F.regr_slope(F.when(F.col("recent"), F.col("y")), F.col("t")).alias("fit_recent"),
        F.var_pop("y").alias("var_y"),
        F.var_pop("t").alias("var_t"),
        F.max("jump").alias("jump"),
        F.max_by("y", "ts").alias("current"),
    ]
    ends = {"y_p10": ("y", 0.1), "y_p90": ("y", 0.9), "gap_p50": ("gap", 0.5)}
    rows = rows.withColumn("gap", _gap())
    if hot:
        totals = _with(rows.groupBy(*keys).agg(*sums), _percentiles(rows, keys, ends), keys)
    else:
        totals = _ranked(rows, keys, ends, sums)
    slope = F.coalesce(F.col("fit"), F.lit(0.0))
    recent = F.when(F.col("n_recent") >= 2, F.coalesce(F.col("fit_recent"), F.lit(0.0))).otherwise(
        slope
    )
    leftover = F.col("var_y") - slope * slope * F.col("var_t")
    values = {
        "mean": F.col("mean"),
        "std": F.col("std"),
        "min": F.col("min"),
        "max": F.col("max"),
        "range": F.col("max") - F.col("min"),
        "slope_full": slope,
        "slope_recent_24h": recent,
        "slope_acceleration": recent - slope,
        "residual_std": F.sqrt(F.greatest(F.lit(0.0), leftover)),
        "max_abs_jump_24h": F.coalesce(F.col("jump"), F.lit(0.0)),
        "p90_minus_p10": F.col("y_p90") - F.col("y_p10"),
        "current_value": F.col("current"),
    }
    enough = F.col("n") >= settings.min_feature_rows
    return totals.select(
        *keys,
        *[F.when(enough, values[name]).otherwise(0.0).alias(name) for name in FEATURES],
        _step_minutes().alias("step_minutes"),
    )


def _gap() -> Column:
    return F.unix_micros("ts") - F.unix_micros("prev_ts")


def _ranked(rows: DataFrame, keys, wanted: dict[str, tuple[str, float]], sums=()) -> DataFrame:
    """``sums`` and percentiles (as in ``_percentiles``) of short series, by their values in order."""
    whole = W.partitionBy(*keys)
    ends = []
    for column in sorted({column for column, _ in wanted.values()}):
        # -0.0 and 0.0 are one value; NaN does not count.
        number = F.col(column).cast("double") + F.lit(0.0)
        number = F.when(~F.isnan(number), number)
        rows = rows.withColumn(f"_v_{column}", number).withColumns(
            {
                f"_n_{column}": F.count(f"_v_{column}").over(whole),
                f"_at_{column}": F.row_number().over(whole.orderBy(F.col(f"_v_{column}").asc_nulls_last())) - 1,
            }
        )
    for name, (column, p) in wanted.items():
        at = F.lit(float(p)) * (F.col(f"_n_{column}") - 1)
        for end, f in (("low", F.floor), ("high", F.ceil)):
            met = F.col(f"_at_{column}") == f(at)
            ends.append(F.max(F.when(met, F.col(f"_v_{column}"))).alias(f"_{end}_{name}"))
        ends.append(F.max(at - F.floor(at)).alias(f"_part_{name}"))
    found = rows.groupBy(*keys).agg(*sums, *ends)
    between = {}
    for name in wanted:
        low, high, part = (F.col(f"_{end}_{name}") for end in ("low", "high", "part"))
        between[name] = F.when(low == high, low).otherwise((F.lit(1.0) - part) * low + part * high)
    return found.withColumns(between).drop(*(f"_{end}_{name}" for name in wanted for end in ("low", "high", "part")))


def _percentiles(rows: DataFrame, keys, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Percentiles of several columns by one search: name -> (column, fraction)."""
    columns = sorted({column for column, _ in wanted.values()})
    each = F.explode(
        F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("number")) for c in columns))
    ).alias("e")
    tall = rows.select(*keys, each).select(*keys, "e.of", "e.number")
    fractions = {f"p{i}": p for i, p in enumerate(sorted({p for _, p in wanted.values()}))}
    place = {p: name for name, p in fractions.items()}
    found = exact_percentiles(tall, [*keys, "of"], "number", fractions)
    return found.groupBy(*keys).agg(
        *(F.max(F.when(F.col("of") == c, F.col(place[p]))).alias(name) for name, (c, p) in wanted.items())
    )


def _with(totals: DataFrame, more: DataFrame, keys) -> DataFrame:
    """Left join of two tables of one row per series; null keys meet."""
    renamed = more.select(*(F.col(c).alias(f"_of_{c}" if c in keys else c) for c in more.columns))
    on = [totals[k].eqNullSafe(renamed[f"_of_{k}"]) for k in keys]
    return totals.join(renamed, on, "left").drop(*(f"_of_{k}" for k in keys))


def _step_minutes() -> Column:
    """AG17 from the median distance; 5 for a single sample."""
    minutes = F.greatest(F.lit(1), F.bround(F.col("gap_p50") / 6.0e7).cast("int"))
    return F.when(F.col("gap_p50").isNotNull(), minutes).otherwise(F.lit(5))


def sample_period(telemetry: DataFrame, keys=SERIES_KEY) -> DataFrame:
    """AG17. Median distance of consecutive samples in whole minutes, at least 1."""
    return period_of(series_context(telemetry, keys), keys)


def period_of(rows: DataFrame, keys=SERIES_KEY) -> DataFrame:
    """AG17 over rows that already carry ``prev_ts``."""
    return by_length(rows, lambda part, hot: _periods(part, list(keys), hot))


def _periods(rows: DataFrame, keys: list[str], hot: bool) -> DataFrame:
    rows, wanted = rows.withColumn("gap", _gap()), {"gap_p50": ("gap", 0.5)}
    if hot:
        found = _with(rows.select(*keys).distinct(), _percentiles(rows, keys, wanted), keys)
    else:
        found = _ranked(rows, keys, wanted)
    return found.select(*keys, _step_minutes().alias("step_minutes"))
