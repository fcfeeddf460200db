"""Fill-level forecasts per series (FC1-FC5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brimwatch.config import DEFAULTS, Settings
from brimwatch.functions.scalar import clip, hours_between, plus_minutes
from brimwatch.operators.features import period_of
from brimwatch.operators.skew import by_length, series_context
from brimwatch.schemas import SERIES_KEY

DAY_MINUTES = 1440
SUPPORTED_HORIZONS = (1, 3, 7, 14)

# Fixed values of the trend model.
N_KNOTS = 25
KNOT_RANGE = 0.8
KNOT_PRIOR = 0.1
SEASON_ORDER = 4
SEASON_PRIOR = 10.0
TREND_PRIOR = 5.0
NOISE_PRIOR = 0.5

# Series solved together; bounds the memory of one batch.
BATCH_SERIES = 256


def horizon_column(days: int) -> str:
    return f"forecast_{days}d_pct"


FORECAST_COLUMNS = [horizon_column(days) for days in SUPPORTED_HORIZONS] + ["hours_to_90pct"]


def seasonal_model(rows: DataFrame, steps: DataFrame, keys=SERIES_KEY) -> DataFrame:
    """FC1b. Straight line plus the mean residual of each hour of day, per series.

    Both parts follow from sums per (series, hour of day), so the samples are
    reduced before any shuffle on the series key and never joined back.
    ``rows`` are samples in series order, ``steps`` their period per series.
    """
    t = hours_between(F.col("ts"), F.col("first_ts"))
    y = F.col("value")
    hourly = (
        rows.select(*keys, "ts", "first_ts", y.alias("y"), t.alias("t"), F.hour("ts").alias("hour"))
        .groupBy(*keys, "hour")
        .agg(
            F.count("*").alias("n"),
            F.sum("t").alias("st"),
            F.sum("y").alias("sy"),
            F.sum(F.col("t") * F.col("t")).alias("stt"),
            F.sum(F.col("t") * F.col("y")).alias("sty"),
            F.min("first_ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )
    totals = hourly.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("st").alias("st"),
        F.sum("sy").alias("sy"),
        F.sum("stt").alias("stt"),
        F.sum("sty").alias("sty"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        # At most 24 entries.
        F.map_from_entries(
            F.collect_list(F.struct("hour", F.struct("n", "st", "sy").alias("sums")))
        ).alias("by_hour"),
    )
    spread = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    slope = F.when(
        spread > 0, (F.col("n") * F.col("sty") - F.col("st") * F.col("sy")) / spread
    ).otherwise(0.0)
    return (
        totals.withColumn("slope", slope)
        .withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("st")) / F.col("n"))
        .join(steps, list(keys))
        .select(*keys, "n", "first_ts", "last_ts", "slope", "intercept", "step_minutes", "by_hour")
    )


def _hour_residual(hour: Column) -> Column:
    sums = F.try_element_at(F.col("by_hour"), hour)
    mean = (
        sums["sy"] - F.col("slope") * sums["st"]
    ) / sums["n"] - F.col("intercept")
    return F.coalesce(mean, F.lit(0.0))


def forecast_grid(model: DataFrame, keys=SERIES_KEY, settings: Settings = DEFAULTS) -> DataFrame:
    """FC2. Future points at the series' own period up to the longest horizon.

    The number of periods is rounded down, so the last point may lie short of
    the horizon. Series below the row minimum keep one row without a point (FC5).
    """
    longest = max(settings.horizons_days) if settings.horizons_days else 7
    periods = F.floor(F.lit(longest * DAY_MINUTES) / F.col("step_minutes")).cast("int")
    points = F.when(
        (F.col("n") >= settings.min_forecast_rows) & (periods >= 1),
        F.sequence(F.lit(1), periods),
    )
    grid = model.withColumn("point", F.explode_outer(points)).withColumn(
        "ahead_minutes", F.col("point").cast("long") * F.col("step_minutes")
    )
    grid = grid.withColumn("ts", plus_minutes(F.col("last_ts"), F.col("ahead_minutes")))
    line = F.col("intercept") + F.col("slope") * hours_between(F.col("ts"), F.col("first_ts"))
    return grid.select(
        *keys,
        "ts",
        "ahead_minutes",
        clip(line + _hour_residual(F.hour("ts")), 0.0, 100.0).alias("yhat"),
    )


def read_horizons(grid: DataFrame, keys=SERIES_KEY, settings: Settings = DEFAULTS) -> DataFrame:
    """FC3, FC4. Value at the first point at or past each horizon; first point at the limit."""
    ahead = F.col("ahead_minutes")
    outputs = []
    for days in SUPPORTED_HORIZONS:
        reached = ahead >= days * DAY_MINUTES
        value = F.min_by(F.when(reached, F.col("yhat")), F.when(reached, ahead))
        wanted = value if days in settings.horizons_days else F.first(F.lit(None).cast("double"))
        outputs.append(wanted.alias(horizon_column(days)))
    crossing = F.min(F.when(F.col("yhat") >= settings.fill_pct, ahead)) / F.lit(60.0)
    return grid.groupBy(*keys).agg(*outputs, crossing.alias("hours_to_90pct"))


def seasonal_forecast(telemetry: DataFrame, keys=SERIES_KEY, settings: Settings = DEFAULTS) -> DataFrame:
    """FC1b with FC2-FC5: one row per series, all built-in expressions."""
    rows = series_context(telemetry, keys)
    model = seasonal_model(rows, period_of(rows, keys), keys)
    return read_horizons(forecast_grid(model, keys, settings), keys, settings)


def straight_line(telemetry: DataFrame, keys=SERIES_KEY, hours: float = 168.0) -> DataFrame:
    """Least-squares value a number of hours after the last sample, clipped to 0..100.

    One grouped aggregate; time is counted from the epoch, so the samples are
    read once and reduced before the shuffle.
    """
    rows = telemetry.select(
        *keys, "in_use_pct", (F.unix_micros("ts") / F.lit(3.6e9)).alias("_t")
    )
    fit = rows.groupBy(*keys).agg(
        F.regr_slope("in_use_pct", "_t").alias("slope"),
        F.regr_intercept("in_use_pct", "_t").alias("intercept"),
        F.max("_t").alias("t_last"),
        F.count("*").alias("n"),
    )
    value = F.col("intercept") + F.col("slope") * (F.col("t_last") + hours)
    return fit.select(*keys, "n", "slope", clip(value, 0.0, 100.0).alias("line_pct"))


# --- FC1: piecewise-linear trend with daily seasonality ---------------------


def _season_terms(day: Column) -> list[Column]:
    terms = []
    for order in range(1, SEASON_ORDER + 1):
        angle = day * F.lit(2.0 * np.pi * order)
        terms += [F.cos(angle), F.sin(angle)]
    return terms


_TERMS = ["one", "t"] + [f"f{i}" for i in range(2 * SEASON_ORDER)] + ["y"]
_PAIRS = [(i, j) for i in range(len(_TERMS)) for j in range(i, len(_TERMS))]


def _segment(position: Column, n_rows: Column) -> Column:
    """Number of trend knots at or before a row.

    Knots sit on evenly spaced row numbers within the first part of the series,
    so the row's own position decides without a look at other rows.
    """
    history = F.floor(n_rows * F.lit(KNOT_RANGE)).cast("int")
    knots = F.least(F.lit(N_KNOTS), history - 1)
    spacing = (history - 1) / knots
    guess = F.floor((position + 0.5) / spacing) + 1
    reached = lambda number: F.bround(number * spacing) <= position
    exact = (
        F.when(reached(guess), guess).when(reached(guess - 1), guess - 1).otherwise(guess - 2)
    )
    return F.least(exact.cast("int"), knots)


def trend_sums(rows: DataFrame, keys=SERIES_KEY, settings: Settings = DEFAULTS) -> DataFrame:
    """Product sums of every trend segment, one row per series with enough samples.

    They are all the least-squares fit needs: at most 26 segments per series,
    whatever the number of samples. Those of short series are summed where their
    samples are and never shuffled.
    """
    keys = list(keys)
    enough = rows.where(F.col("n_rows") >= settings.min_forecast_rows)
    span = hours_between(F.col("last_ts"), F.col("first_ts"))
    micros = F.unix_micros("ts")
    day = (micros % F.lit(86_400_000_000)) / F.lit(8.64e10)
    shaped = enough.select(
        *keys,
        "first_ts",
        "last_ts",
        "peak",
        _segment(F.col("position"), F.col("n_rows")).alias("segment"),
        F.lit(1.0).alias("one"),
        (hours_between(F.col("ts"), F.col("first_ts")) / span).alias("t"),
        *[term.alias(f"f{i}") for i, term in enumerate(_season_terms(day))],
        F.col("value").alias("y"),
    )
    segments = shaped.groupBy(*keys, "segment").agg(
        F.min("t").alias("starts_at"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max("peak").alias("peak"),
        F.array(*[F.sum(F.col(_TERMS[i]) * F.col(_TERMS[j])) for i, j in _PAIRS]).alias("products"),
    )
    series = segments.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("segment", "starts_at", "products"))).alias("_parts"),
        F.unix_micros(F.min("first_ts")).alias("first_us"),
        F.unix_micros(F.max("last_ts")).alias("last_us"),
        F.max("peak").alias("peak"),
    )
    return series.select(
        *keys,
        "first_us",
        "last_us",
        "peak",
        F.transform("_parts", lambda part: part["starts_at"]).alias("starts"),
        F.flatten(F.transform("_parts", lambda part: part["products"])).alias("products"),
    )


def _gram(products: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Inner products of the model's basis from the per-segment sums of many series.

    ``products`` is (series, segments, pairs), ``starts`` (series, knots). A knot
    acts on its own and all later segments, so suffix sums give its products.
    """
    size, n_knots = len(_TERMS), starts.shape[1]
    blocks = np.zeros(products.shape[:2] + (size, size))
    upper = tuple(np.array(_PAIRS).T)
    blocks[:, :, upper[0], upper[1]] = products
    blocks[:, :, upper[1], upper[0]] = products
    after = np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1]  # sums of this and later segments
    whole, later = after[:, 0], after[:, 1:]
    order = [1, 0] + list(range(2, size))  # t, one, season, y
    total = size + n_knots
    gram = np.zeros((len(products), total, total))
    plain = np.r_[0:2, 2 + n_knots : total]
    gram[:, plain[:, None], plain] = whole[:, order][:, :, order]
    # Knot against the plain terms.
    cross = later[:, :, 1, :] - starts[:, :, None] * later[:, :, 0, :]
    gram[:, 2 : 2 + n_knots, plain] = cross[:, :, order]
    gram[:, plain, 2 : 2 + n_knots] = cross[:, :, order].transpose(0, 2, 1)
    # Knot against knot, over the segments behind both.
    last = np.maximum.outer(np.arange(n_knots), np.arange(n_knots))
    first, second = starts[:, :, None], starts[:, None, :]
    gram[:, 2 : 2 + n_knots, 2 : 2 + n_knots] = (
        later[:, :, 1, 1][:, last]
        - (first + second) * later[:, :, 0, 1][:, last]
        + first * second * later[:, :, 0, 0][:, last]
    )
    return gram


FIT_GAP = "fit_gap"
#: Largest distance from the optimum, in units of the log posterior, of a fit that counts as converged.
GAP = 1e-8
_RIDGE_ROUNDS, _NOISE_ROUNDS, _SET_ROUNDS = 40, 60, 60


def _noise(theta: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Most probable noise variance for given parameters, in closed form."""
    inverse, n = 1.0 / NOISE_PRIOR**2, xx[:, 1, 1]
    fitted = np.einsum("si,sij,sj->s", theta, xx, theta)
    rest = np.maximum(0.0, yy - 2.0 * np.einsum("si,si->s", theta, xy) + fitted)
    return np.maximum(1e-9, 2.0 * rest / (n + np.sqrt(n * n + 4.0 * inverse * rest)))


def _gap(hessian: np.ndarray, slope: np.ndarray, theta: np.ndarray, knot: np.ndarray) -> np.ndarray:
    """How far the log posterior can still rise, at most.

    With a subgradient r of the negative log posterior and the Hessian H of its
    smooth part, it lies at most r H^-1 r / 2 above its minimum. The subgradient
    of the knots' prior is chosen as small as it can be.
    """
    reach = 1.0 / KNOT_PRIOR
    tight = np.sign(slope) * np.maximum(0.0, np.abs(slope) - reach)
    rest = np.where(knot, np.where(theta != 0, slope + reach * np.sign(theta), tight), slope)
    return 0.5 * np.einsum("si,si->s", rest, np.linalg.solve(hessian, rest[..., None])[..., 0])


def _optimum(
    xx: np.ndarray, xy: np.ndarray, noise: np.ndarray, theta: np.ndarray, ridge: np.ndarray, knot: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, gap) at fixed noise, by an active set of knots; many series at once.

    The knots that bend keep their signs, the others stay at nothing, and a
    linear system gives the rest. Knots that would change sign leave the set; if
    none does, the knot that violates optimality most comes in.
    """
    diagonal = np.arange(xx.shape[1])
    hessian = xx / noise[:, None, None]
    hessian[:, diagonal, diagonal] += ridge
    target, reach = xy / noise[:, None], 1.0 / KNOT_PRIOR
    sign = np.where(knot & (np.abs(theta) > 1e-6), np.sign(theta), 0.0)
    best, gap = theta.copy(), np.full(len(xx), np.inf)
    live = np.arange(len(xx))
    for _ in range(_SET_ROUNDS):
        held = ~knot[live] | (sign[live] != 0)
        system = np.where(held[:, :, None] & held[:, None, :], hessian[live], 0.0)
        system[:, diagonal, diagonal] = np.where(held, hessian[live][:, diagonal, diagonal], 1.0)
        aim = np.where(held, target[live] - reach * sign[live], 0.0)
        found = np.linalg.solve(system, aim[..., None])[..., 0]
        slope = np.einsum("sij,sj->si", hessian[live], found) - target[live]
        far = _gap(hessian[live], slope, found, knot[live])
        better = far < gap[live]
        best[live[better]], gap[live[better]] = found[better], far[better]
        flipped = knot[live] & (sign[live] != 0) & (sign[live] * found <= 0)
        excess = np.where(knot[live] & (sign[live] == 0), np.abs(slope) - reach, -np.inf)
        worst = excess.argmax(axis=1)
        enter = ~flipped.any(axis=1) & (excess.max(axis=1) > 1e-9 * reach)
        sign[live] = np.where(flipped, 0.0, sign[live])
        sign[live[enter], worst[enter]] = -np.sign(slope[enter, worst[enter]])
        live = live[(flipped.any(axis=1) | enter) & (gap[live] > GAP * 1e-3)]
        if live.size == 0:
            break
    return best, gap


def _fit(gram: np.ndarray, knots_used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most probable parameters of many series at once, and the gap to the optimum.

    Normal noise, a double-exponential prior on the knots. A few reweighted
    ridge solves find which knots bend; from there the exact optimum for a noise
    level and the most probable noise level follow in turn until the level stays.
    The gap is infinite where it does not. Returns [growth, offset, knots, season]
    per series.
    """
    total = gram.shape[1] - 1
    n_knots = knots_used.shape[1]
    xx, xy, yy = gram[:, :total, :total], gram[:, :total, total], gram[:, total, total]
    bends = slice(2, 2 + n_knots)
    ridge = np.zeros((len(gram), total))
    ridge[:, :2] = 1.0 / TREND_PRIOR**2
    ridge[:, 2 + n_knots :] = 1.0 / SEASON_PRIOR**2
    ridge[:, bends] = np.where(knots_used, 0.0, 1.0)
    knot = np.zeros((len(gram), total), dtype=bool)
    knot[:, bends] = knots_used
    noise = np.full(len(gram), 0.01)
    theta = np.zeros((len(gram), total))
    theta[:, bends] = KNOT_PRIOR
    diagonal = np.arange(total)
    live = np.arange(len(gram))
    for _ in range(_RIDGE_ROUNDS):
        size = np.maximum(np.abs(theta[live]), 1e-7)
        system = xx[live] / noise[live, None, None]
        system[:, diagonal, diagonal] += np.where(knot[live], 1.0 / (KNOT_PRIOR * size), ridge[live])
        updated = np.linalg.solve(system, (xy[live] / noise[live, None])[..., None])[..., 0]
        moved = np.max(np.abs(updated - theta[live]), axis=1)
        theta[live] = updated
        noise[live] = _noise(updated, xx[live], xy[live], yy[live])
        live = live[moved >= 1e-4]
        if live.size == 0:
            break
    gap = np.full(len(gram), np.inf)
    live = np.arange(len(gram))
    for _ in range(_NOISE_ROUNDS):
        theta[live], reached = _optimum(xx[live], xy[live], noise[live], theta[live], ridge[live], knot[live])
        level = _noise(theta[live], xx[live], xy[live], yy[live])
        still = np.abs(level - noise[live]) <= 1e-9 * noise[live]
        gap[live[still]] = reached[still]
        noise[live] = np.where(still, noise[live], level)
        live = live[~still]
        if live.size == 0:
            break
    return theta, gap


def _read_series(
    theta: np.ndarray, starts: np.ndarray, scale: float, first: int, last: int, step: int,
    settings: Settings,
) -> dict[str, float | None]:
    """FC2-FC4 of one fitted series; times in microseconds."""
    out: dict[str, float | None] = dict.fromkeys(FORECAST_COLUMNS)
    longest = max(settings.horizons_days) if settings.horizons_days else 7
    ahead = np.arange(1, longest * DAY_MINUTES // step + 1, dtype=np.int64) * step
    if ahead.size == 0:
        return out
    when = last + ahead * 60_000_000
    t = (when - first) / (last - first)
    # All knots lie in the past, so the trend ahead is one line.
    n_knots = len(starts)
    knots = theta[2 : 2 + n_knots]
    trend = (theta[0] + knots.sum()) * t + theta[1] - knots @ starts
    angle = 2.0 * np.pi * ((when % 86_400_000_000) / 8.64e10)[:, None] * np.arange(1, SEASON_ORDER + 1)
    season = theta[2 + n_knots :]
    daily = np.cos(angle) @ season[0::2] + np.sin(angle) @ season[1::2]
    yhat = np.clip((trend + daily) * scale, 0.0, 100.0)
    for days in settings.horizons_days:
        place = np.searchsorted(ahead, days * DAY_MINUTES)
        if days in SUPPORTED_HORIZONS and place < ahead.size:
            out[horizon_column(days)] = float(yhat[place])
    crossed = np.flatnonzero(yhat >= settings.fill_pct)
    if crossed.size:
        out["hours_to_90pct"] = float(ahead[crossed[0]]) / 60.0
    return out


def _solve_batch(pdf: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """Forecast columns of a batch of series, in its order, and the gap of each fit; null without sums."""
    values = pd.DataFrame(np.nan, index=range(len(pdf)), columns=[*FORECAST_COLUMNS, FIT_GAP])
    fitted = np.flatnonzero(pdf["starts"].notna().to_numpy())
    if fitted.size == 0:
        return values
    pdf = pdf.iloc[fitted]
    counts = np.array([len(starts) for starts in pdf["starts"]])
    products = np.zeros((len(pdf), N_KNOTS + 1, len(_PAIRS)))
    starts = np.ones((len(pdf), N_KNOTS))
    scale = pdf["peak"].to_numpy(dtype=float)
    scale = np.where(scale == 0.0, 1.0, scale)
    for row, (begin, flat) in enumerate(zip(pdf["starts"], pdf["products"])):
        products[row, : counts[row]] = np.asarray(flat, dtype=float).reshape(counts[row], -1)
        starts[row, : counts[row] - 1] = begin[1:]
    powers = np.array([(i == len(_TERMS) - 1) + (j == len(_TERMS) - 1) for i, j in _PAIRS])
    products /= scale[:, None, None] ** powers
    used = np.arange(N_KNOTS) < (counts - 1)[:, None]
    theta, gap = _fit(_gram(products, starts), used)
    theta[:, 2 : 2 + N_KNOTS] *= used
    times = zip(pdf["first_us"], pdf["last_us"], pdf["step_minutes"])
    solved = [
        _read_series(theta[row], starts[row], scale[row], int(first), int(last), int(step), settings)
        for row, (first, last, step) in enumerate(times)
    ]
    columns = pd.DataFrame(solved, columns=FORECAST_COLUMNS, dtype=float).to_numpy()
    values.iloc[fitted] = np.column_stack((columns, gap))
    return values


def solve_trends(
    base: DataFrame, sums: DataFrame, keys=SERIES_KEY, settings: Settings = DEFAULTS
) -> DataFrame:
    """FC1. ``base`` (one row per series, with step_minutes) plus its forecast columns.

    Spark reduced the samples to product sums; Python only solves a batch of
    small systems, many series at a time. Series without sums keep nulls (FC5).
    ``fit_gap`` bounds how far the fit is from the optimum, in units of the log
    posterior; ``converged`` tells whether that is at most ``GAP``.
    """
    keys = list(keys)
    kept = [name for name in base.columns if name != "step_minutes"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), BATCH_SERIES):
                part = batch.iloc[begin : begin + BATCH_SERIES].reset_index(drop=True)
                yield pd.concat([part[kept], _solve_batch(part, settings)], axis=1)

    fields = [T.StructField(name, base.schema[name].dataType) for name in kept]
    fields += [T.StructField(name, T.DoubleType()) for name in (*FORECAST_COLUMNS, FIT_GAP)]
    # The side without sums, a few numbers per series, is the one that is hashed; the sums are not sorted.
    solved = base.hint("shuffle_hash").join(sums, keys, "left").mapInPandas(solve, T.StructType(fields))
    gap = F.nanvl(F.col(FIT_GAP), F.lit(None).cast("double"))
    return solved.withColumn(FIT_GAP, gap).withColumn("converged", F.col(FIT_GAP) <= GAP)


def piecewise_forecast(telemetry: DataFrame, keys=SERIES_KEY, settings: Settings = DEFAULTS) -> DataFrame:
    """FC1 with FC2-FC5. Piecewise-linear trend, daily seasonality, point estimates."""
    rows = series_context(telemetry, keys)
    return by_length(
        rows, lambda part, _: solve_trends(period_of(part, keys), trend_sums(part, keys, settings), keys, settings)
    )
