from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwatch.config import Settings
from brimwatch.operators import forecast, trigger
from brimwatch.plans.cycle import score_fleet, score_host

N = 2016


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(1)
    i = np.arange(N)
    return {
        "stable": 50 + rng.normal(0, 0.3, N),
        "ramp": 40 + 0.01 * i + rng.normal(0, 0.2, N),
        "daily": 50 + 5 * np.sin(2 * np.pi * i / 288) + 0.002 * i + rng.normal(0, 0.3, N),
        "knee": np.where(i < 1612, 45, 45 + 30 * (i - 1612) / 404) + rng.normal(0, 0.3, N),
        "flat": np.full(N, 20.0),
        "zero": np.zeros(N),
        "short": np.full(23, 95.0),
    }


def test_piecewise_forecast(series, shapes):
    got = {r.host_id: r for r in forecast.piecewise_forecast(series(shapes)).collect()}
    assert set(got) == set(shapes)
    assert got["short"].forecast_1d_pct is None and got["short"].hours_to_90pct is None
    assert got["stable"].forecast_7d_pct == pytest.approx(50, abs=2)
    assert got["stable"].hours_to_90pct is None
    # 0.01 per five minutes from 60.15 at the last sample
    assert got["ramp"].forecast_1d_pct == pytest.approx(60.15 + 2.88, abs=0.7)
    assert got["ramp"].forecast_7d_pct == pytest.approx(60.15 + 20.16, abs=2.5)
    assert got["ramp"].forecast_14d_pct == 100.0
    assert got["ramp"].hours_to_90pct == pytest.approx(29.85 / 0.12, abs=30)
    assert got["daily"].forecast_1d_pct == pytest.approx(50 + 0.002 * (N + 287), abs=1.0)
    # The trend follows the late change of slope.
    assert got["knee"].forecast_3d_pct == 100.0 and got["knee"].hours_to_90pct < 48
    assert got["flat"].forecast_14d_pct == pytest.approx(20.0, abs=0.2)
    assert got["zero"].forecast_14d_pct == pytest.approx(0.0, abs=1e-6)


def test_segment_products_equal_a_direct_fit(series, shapes):
    """The reduced sums give the same normal equations as the full design matrix."""
    rows = forecast.series_context(series({"daily": shapes["daily"]}), ["host_id", "device"])
    row = forecast.trend_sums(rows).first()
    y = np.round(shapes["daily"], 3)
    t = np.arange(N) / (N - 1)
    history = int(np.floor(N * 0.8))
    places = np.linspace(0, history - 1, 26).round().astype(int)[1:]
    assert row.starts[1:] == pytest.approx(t[places])
    minutes = np.arange(N) * 5
    columns = [t, np.ones(N)] + [np.maximum(t - t[p], 0) for p in places]
    for k in range(1, 5):
        columns += [np.cos(2 * np.pi * k * minutes / 1440), np.sin(2 * np.pi * k * minutes / 1440)]
    design = np.stack(columns + [y], axis=1)
    products = np.array(row.products).reshape(1, 26, -1)
    gram = forecast._gram(products, np.array([row.starts[1:]]))[0]
    assert np.allclose(gram, design.T @ design, rtol=1e-8, atol=1e-6)


def test_horizon_quirk(series):
    """A step that does not divide the horizon leaves the last value empty."""
    values = {"a": 10 + 0.1 * np.arange(60)}
    exact = forecast.seasonal_forecast(series(values, minutes=30)).first()
    odd = forecast.seasonal_forecast(series(values, minutes=31)).first()
    assert exact.forecast_14d_pct is not None and odd.forecast_14d_pct is None
    assert odd.forecast_7d_pct is not None


def test_only_wanted_horizons(series):
    values = {"a": 10 + 0.1 * np.arange(60)}
    row = forecast.seasonal_forecast(series(values, minutes=30), settings=Settings(horizons_days=(1, 7))).first()
    assert row.forecast_1d_pct is not None and row.forecast_3d_pct is None and row.forecast_7d_pct is not None


def test_seasonal_equals_numpy(series, shapes):
    y = np.round(shapes["daily"], 3)
    row = forecast.seasonal_forecast(series({"a": y})).first()
    t = np.arange(N) * 5 / 60
    slope, intercept = np.polyfit(t, y, 1)
    hour = (np.arange(N) * 5 // 60) % 24
    residual = np.array([(y - slope * t - intercept)[hour == h].mean() for h in range(24)])
    ahead = t[-1] + 24.0
    want = intercept + slope * ahead + residual[int(((N - 1) * 5 + 1440) // 60) % 24]
    assert row.forecast_1d_pct == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "forecast_7d, hours, anomaly, want",
    [(90.0, None, 0.0, True), (89.9, None, 0.0, False), (None, 168.0, 0.0, True), (None, 168.1, 0.0, False),
     (None, None, 0.6, True), (None, None, 0.59, False), (None, None, None, False)],
)
def test_trigger_limits(spark, forecast_7d, hours, anomaly, want):
    df = spark.createDataFrame([(forecast_7d, hours, anomaly)], "forecast_7d_pct double, hours_to_90pct double, anomaly_score double")
    assert trigger.with_trigger(df).first().triggered_agent is want


def test_status_order(spark):
    rows = [(None, None, 95.0), (0.6, True, 10.0), (0.1, True, 95.0), (0.1, False, 90.1), (0.1, False, 90.0), (0.1, False, None)]
    df = spark.createDataFrame(rows, "anomaly_score double, triggered_agent boolean, in_use_pct double")
    got = [r.s for r in df.select(trigger.status().alias("s")).collect()]
    assert got == ["no_prediction", "anomalous", "predictive", "critical", "healthy", "healthy"]


def test_cycle_for_all_and_for_one(series, shapes):
    rows = series(shapes)
    now = rows.agg(F.max("ts")).first()[0]
    for name in ("piecewise", "seasonal"):
        every = {r.host_id: r for r in score_fleet(rows, now, None, forecaster=name).collect()}
        assert set(every) == set(shapes)
        assert every["ramp"].triggered_agent is False and every["knee"].forecast_7d_pct is not None
        one = score_host(rows, "ramp", now, None, forecaster=name).first()
        assert one.prediction_id == every["ramp"].prediction_id
        assert one.forecast_7d_pct == pytest.approx(every["ramp"].forecast_7d_pct)
    with pytest.raises(ValueError, match="no telemetry"):
        score_host(rows, "nobody", now, None)


def _objective(gram, theta, noise):
    """Negative log posterior at fixed noise, term by term."""
    total = len(theta)
    xx, xy, yy = gram[:total, :total], gram[:total, total], gram[total, total]
    knots = theta[2 : 2 + forecast.N_KNOTS]
    season = theta[2 + forecast.N_KNOTS :]
    rest = yy - 2 * theta @ xy + theta @ xx @ theta
    return (
        rest / (2 * noise) + np.abs(knots).sum() / forecast.KNOT_PRIOR
        + (theta[:2] @ theta[:2]) / (2 * forecast.TREND_PRIOR**2) + (season @ season) / (2 * forecast.SEASON_PRIOR**2)
    )


def test_the_gap_bounds_what_other_parameters_reach(series, shapes):
    rows = forecast.series_context(series(shapes), ["host_id", "device"])
    draw = np.random.default_rng(6)
    for row in forecast.trend_sums(rows).collect():
        scale = row.peak or 1.0
        powers = np.array([(i == len(forecast._TERMS) - 1) + (j == len(forecast._TERMS) - 1) for i, j in forecast._PAIRS])
        products = np.array(row.products).reshape(1, forecast.N_KNOTS + 1, -1) / scale**powers
        gram = forecast._gram(products, np.array([row.starts[1:]]))
        theta, gap = forecast._fit(gram, np.ones((1, forecast.N_KNOTS), dtype=bool))
        assert gap[0] <= forecast.GAP
        total = gram.shape[1] - 1
        noise = forecast._noise(theta, gram[:, :total, :total], gram[:, :total, total], gram[:, total, total])[0]
        best = _objective(gram[0], theta[0], noise)
        slack = gap[0] + 1e-9 * abs(best)
        # Other parameters, near and far, and the fit with each bend taken away.
        for step in (1e-6, 1e-4, 1e-2):
            for _ in range(30):
                assert _objective(gram[0], theta[0] + draw.normal(0, step, total), noise) >= best - slack
        for k in range(2, 2 + forecast.N_KNOTS):
            less = theta[0].copy()
            less[k] = 0.0
            assert _objective(gram[0], less, noise) >= best - slack


def test_sample_series_converge_and_others_are_marked(spark, series, shapes, data, monkeypatch):
    from brimwatch.sources import sample

    rows = forecast.piecewise_forecast(sample.telemetry(spark, data, one_device=True)).collect()
    fitted = [r for r in rows if r.fit_gap is not None]
    assert fitted and all(r.converged and r.fit_gap <= 1e-8 for r in fitted)
    assert all(r.converged is None and r.forecast_7d_pct is None for r in rows if r.fit_gap is None)
    monkeypatch.setattr(forecast, "_NOISE_ROUNDS", 0)
    gram = np.eye(len(forecast._TERMS) + forecast.N_KNOTS)[None] * 50.0
    assert np.isinf(forecast._fit(gram, np.ones((1, forecast.N_KNOTS), dtype=bool))[1][0])
