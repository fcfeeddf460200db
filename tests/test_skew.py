"""Order operations against plain Python, with one key holding most rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brimwatch.operators import cleanup, gaps, skew

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    out = []
    for key, n in (("hot", 900), ("a", 40), ("b", 3), ("one", 1)):
        minutes = sorted(random.sample(range(0, 60 * 24 * 20), n))
        out += [(key, T0 + timedelta(minutes=m), round(random.random() * 100, 3)) for m in minutes]
    random.shuffle(out)
    return out


def test_series_context(spark, rows):
    df = spark.createDataFrame(rows, "k string, ts timestamp, in_use_pct double")
    got = {(r.k, r.ts): r for r in skew.series_context(df, ["k"]).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for place, (_, ts, value) in enumerate(mine):
            row = got[(key, ts)]
            before = mine[place - 1] if place else (None, None, None)
            assert (row.position, row.value, row.prev_ts, row.prev_value) == (place, value, before[1], before[2])
            assert (row.first_ts, row.last_ts, row.n_rows) == (mine[0][1], mine[-1][1], len(mine))


def test_numbered_is_a_row_number(spark, rows):
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = skew.numbered(df, ["k"], ["v", "ts"]).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.k == key), key=lambda r: (r.v, r.ts))
        assert [r.number for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("salts", [None, 5])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, rows, how, salts):
    big = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    small = spark.createDataFrame([("hot", 1), ("b", 2), ("none", 3)], "k string, w int")
    got = skew.skew_join(big, small, ["k"], how, spread=["ts"], salts=salts)
    want = big.join(small, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_read_in_slices(spark):
    """Above the broadcast limit, also when an aggregate on the key follows."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {name: spark.conf.get(name, None) for name in low}
    for name, value in low.items():
        spark.conf.set(name, value)
    try:
        big = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        small = spark.range(500).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("w"))
        joined = skew.skew_join(big, small, ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v"), F.max("w").alias("w"))
        assert sum(r.n for r in joined.collect()) == 60000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_top_per_key_trims_before_the_shuffle(spark, rows):
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    top = skew.top_per_key(df, ["k"], [F.col("v").desc()], 3)
    for key in {r[0] for r in rows}:
        want = sorted((r[2] for r in rows if r[0] == key), reverse=True)[:3]
        assert sorted((r.v for r in top.collect() if r.k == key), reverse=True) == want
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    # The largest k in use is still trimmed in the map tasks.
    many = skew.top_per_key(df, ["k"], [F.col("v").desc()], cleanup.ROUND_FILES)
    assert "WindowGroupLimit" in many._jdf.queryExecution().executedPlan().toString()


def test_as_of_join_against_brute_force(spark, rows):
    random.seed(5)
    asked = [(n, k, T0 + timedelta(minutes=random.randrange(-60, 60 * 24 * 25))) for n in range(300)
             for k in [random.choice(["hot", "a", "b", "unseen"])]]
    left = spark.createDataFrame(asked, "n int, k string, at timestamp")
    right = spark.createDataFrame([(k, ts, f"p{i}") for i, (k, ts, _) in enumerate(rows)], "k string, ts timestamp, pid string")
    got = {r.n: r.pid for r in gaps.as_of_join(left, right, "k", "at", "ts", ["pid"], ["pid"]).collect()}
    assert len(got) == 300
    for n, key, at in asked:
        best = [(ts, f"p{i}") for i, (k, ts, _) in enumerate(rows) if k == key and ts <= at]
        assert got[n] == (max(best)[1] if best else None)


def test_fill_forward_against_brute_force(spark):
    samples = [("h", "/", T0 + timedelta(minutes=m), float(v)) for m, v in ((3, 10), (9, 11), (200, 12), (4000, 13))]
    df = spark.createDataFrame(samples, "host_id string, device string, ts timestamp, in_use_pct double")
    now = T0 + timedelta(minutes=4100)
    got = sorted((r.ts, r.in_use_pct) for r in gaps.fill_forward(df, now, 5).collect())
    want = []
    slot = T0 + timedelta(minutes=5)
    while slot <= now:
        want.append((slot, max(s for s in samples if s[2] <= slot)[3]))
        slot += timedelta(minutes=5)
    assert got == want


def test_missing_slots(spark):
    hosts = spark.createDataFrame([("a", "/x"), ("b", "/y"), ("new", "/z")], "host_id string, monitored_path string")
    seen = spark.createDataFrame(
        [("a", "/x", T0), ("a", "/x", T0 + timedelta(minutes=10)), ("b", "/y", T0 + timedelta(minutes=28))],
        "host_id string, device string, ts timestamp")
    got = gaps.missing_slots(hosts, seen, T0 + timedelta(minutes=30, seconds=40), 5).collect()
    assert sorted((r.host_id, (r.ts - T0).seconds // 60) for r in got) == [("a", m) for m in (15, 20, 25, 30)]


def test_backfill_and_directory_samples(spark):
    files = spark.createDataFrame([("a", "/x/1", 30), ("a", "/x/2", 12), ("b", "/y/1", 10**15)], "host_id string, path string, size_bytes long")
    hosts = spark.createDataFrame([("a", "/x", 1.0), ("b", "/y", 1.0), ("c", "/z", 1.0)], "host_id string, monitored_path string, total_disk_gb double")
    now = T0 + timedelta(seconds=90, microseconds=5)
    got = {r.host_id: r for r in gaps.directory_samples(files, hosts, now).collect()}
    assert set(got) == {"a", "b"} and got["a"].used_bytes == 42
    assert got["b"].used_bytes == 1024**3 - 1 and got["b"].free_bytes == 1 and got["b"].in_use_pct == 100.0
    filled = gaps.backfill(gaps.directory_samples(files, hosts, now), now, 3).collect()
    assert sorted((r.host_id, r.ts) for r in filled) == sorted(
        (h, T0 + timedelta(minutes=m)) for h in "ab" for m in (-1, 0, 1))
