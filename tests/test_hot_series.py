"""Series that hold most rows within a short time, and percentiles without a map per series."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwatch.operators import features, forecast, gaps, skew
from brimwatch.operators.percentiles import exact_percentiles

T0 = datetime(2026, 2, 1)


@pytest.fixture(scope="module")
def burst(spark):
    """60,000 rows, nine tenths of them of one host within one hour."""
    hot = F.col("id") % 10 < 9
    second = F.when(hot, F.col("id") * 0.06).otherwise(F.col("id") * 60)
    return spark.range(0, 60_000, 1, 8).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 400)).alias("host_id"),
        F.lit("/").alias("device"),
        F.timestamp_micros(F.lit(int(T0.timestamp()) * 1_000_000) + (second * 1_000_000).cast("long")).alias("ts"),
        F.round(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 1000.0, 3).alias("in_use_pct"),
    )


@pytest.fixture()
def wide(spark):
    """Sixteen shuffle partitions that are not put together, and no broadcast of facts."""
    held = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def task_sizes(rows):
    """Rows per task of the stage that puts the rows in order (the columns keep its work in the plan)."""
    each = rows.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("n"), F.sum("position"), F.max("prev_ts"), F.max("prev_value")
    )
    return [r.n for r in each.collect()]


def test_no_task_has_twice_the_mean(spark, burst, wide):
    sizes = task_sizes(skew.series_context(burst, ["host_id", "device"], limit=300))
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 16
    # What has to be put in order together is small, too; a busy hour by itself is nine tenths of all.
    cut = skew.time_slices(burst, ["host_id"], "ts", 3600, limit=300).groupBy("host_id", skew.SLICE).count()
    assert cut.agg(F.max("count")).first()[0] <= 300


def test_short_slices_change_nothing(spark, burst):
    plain = skew.series_context(burst, ["host_id", "device"])
    cut = skew.series_context(burst, ["host_id", "device"], limit=100)
    assert plain.count() == 60_000 and plain.exceptAll(cut).count() == 0 == cut.exceptAll(plain).count()
    mine = [r.asDict() for r in cut.where("host_id = 'hot'").orderBy("position").collect()]
    assert [r["position"] for r in mine] == list(range(54_000))
    assert all(b["prev_ts"] == a["ts"] and b["prev_value"] == a["value"] for a, b in zip(mine, mine[1:], strict=False))


def test_rows_of_one_time_stay_together(spark):
    rows = [("a", T0, float(i)) for i in range(50)] + [("a", T0 + timedelta(microseconds=i), 0.5) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "host_id string, ts timestamp, in_use_pct double")
    got = skew.series_context(df, ["host_id"], limit=5).orderBy("position").collect()
    assert [r.position for r in got] == list(range(89)) and [r.ts for r in got] == sorted(r[1] for r in rows)


def test_carrying_over_many_short_slices(spark, burst):
    asked = burst.where("host_id = 'hot' AND in_use_pct < 1").select(
        "host_id", (F.col("ts") + F.expr("INTERVAL 7 MILLISECONDS")).alias("at")
    )
    right = burst.where("in_use_pct >= 50").select("host_id", "ts", "in_use_pct")
    old = skew.SLICE_ROWS
    plain = gaps.as_of_join(asked, right, "host_id", "at", "ts", ["ts", "in_use_pct"])
    want = sorted(map(str, plain.collect()))
    try:
        skew.SLICE_ROWS = 200
        cut = gaps.as_of_join(asked, right, "host_id", "at", "ts", ["ts", "in_use_pct"])
        assert sorted(map(str, cut.collect())) == want and len(want) > 300
    finally:
        skew.SLICE_ROWS = old


def test_percentiles_equal_numpy(spark):
    draw = np.random.default_rng(4)
    groups = {
        "wide": draw.standard_normal(4001) * 10.0 ** draw.integers(-12, 12, 4001),
        "outlier": np.append(draw.random(3000), 1e15),
        "same": np.full(70, 3.25),
        "one": np.array([-0.0]),
        "two": np.array([1.0, 2.0]),
        None: draw.integers(0, 9, 500).astype(float),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    rows += [("wide", None), ("wide", float("nan")), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    fractions = {"low": 0.0, "p10": 0.1, "half": 0.5, "p90": 0.9, "high": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", fractions, bins=16).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, p in fractions.items():
            assert got[k][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-300)


def test_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(F.lit("h").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(1_000_000)) / 1000.0).alias("v"))
    out = exact_percentiles(df, ["k"], "v", {"p10": 0.1, "p90": 0.9})
    row = out.first()
    assert (row.p10, row.p90) == (pytest.approx(99.9999), pytest.approx(899.9991))
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_features_keep_no_map_per_series(spark, burst):
    out = features.series_features(burst)
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.where("host_id = 'hot'").first()
    values = [r.in_use_pct for r in burst.where("host_id = 'hot'").select("in_use_pct").collect()]
    assert row.p90_minus_p10 == pytest.approx(np.percentile(values, 90) - np.percentile(values, 10), abs=1e-9)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_short_series_are_shuffled_once(spark, burst):
    short = burst.where("host_id <> 'hot'")
    assert exchanges(features.series_features(short)) == 1
    # Once for the period and once for the product sums, which are not shuffled themselves.
    assert exchanges(forecast.piecewise_forecast(short)) == 2


def test_short_and_hot_series_by_either_way(spark, burst, monkeypatch):
    rows = burst.where("host_id <> 'hot' OR in_use_pct < 20")

    def work():
        return [features.series_features(rows), forecast.piecewise_forecast(rows), forecast.seasonal_forecast(rows)]

    want = [{r.host_id: r.asDict() for r in df.collect()} for df in work()]
    monkeypatch.setattr(skew, "WHOLE_ROWS", 100)  # every series is a hot one
    for old, df in zip(want, work(), strict=True):
        got = {r.host_id: r.asDict() for r in df.collect()}
        assert set(got) == set(old) and len(old) == 41
        for host, row in got.items():
            for name, value in row.items():
                before = old[host][name]
                if isinstance(before, float) and name != "fit_gap":
                    before = pytest.approx(before, rel=1e-6, abs=1e-6)
                assert name == "fit_gap" or value == before, (host, name, value, before)


def test_samples_without_a_host_are_a_series(spark):
    rows = [(h, T0 + timedelta(minutes=i), float(i)) for h in (None, "a") for i in range(40)]
    df = spark.createDataFrame(rows, "host_id string, ts timestamp, in_use_pct double")
    for limit in (None, 10):  # by windows, by slices
        got = skew.series_context(df, ["host_id"], limit=limit).groupBy("host_id").agg(F.max("position").alias("p"))
        assert {r.host_id: r.p for r in got.collect()} == {None: 39, "a": 39}
