"""Sinks, scans, validation and fleet views on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brimwatch.operators import fleet, latest, validate
from brimwatch.sources import scans, sinks

T0 = datetime(2026, 4, 1)
SAMPLE = "ts timestamp, host_id string, device string, total_bytes long, used_bytes long, free_bytes long, in_use_pct double"


def samples(spark, rows):
    return spark.createDataFrame(
        [(T0 + timedelta(minutes=m), h, d, 1000, int(p * 10), 1000 - int(p * 10), float(p)) for m, h, d, p in rows], SAMPLE)


def test_insert_ignore_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.insert_ignore(samples(spark, [(0, "a", "/", 1), (5, "a", "/", 2)]), path)
    sinks.insert_ignore(samples(spark, [(5, "a", "/", 9), (10, "a", "/", 3), (10, "a", "/", 3), (60 * 30, "a", "/", 4)]), path)
    sinks.insert_ignore(samples(spark, []), path)
    got = sorted((r.ts, r.in_use_pct) for r in spark.read.parquet(path).collect())
    assert got == [(T0, 1.0), (T0 + timedelta(minutes=5), 2.0), (T0 + timedelta(minutes=10), 3.0), (T0 + timedelta(hours=30), 4.0)]


def test_first_of_a_batch_and_last_update(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = samples(spark, [(0, "a", "/", p / 10) for p in range(1000)]).withColumn("seq", F.round(F.col("in_use_pct") * 10))
    sinks.insert_ignore(rows.repartition(8), path, order=["seq"])
    sinks.insert_ignore(rows.orderBy(F.desc("seq")), path)
    assert [r.in_use_pct for r in spark.read.parquet(path).collect()] == [0.0]
    plain = str(tmp_path / "p")
    sinks.insert_ignore(rows.drop("seq"), plain)
    assert [r.in_use_pct for r in spark.read.parquet(plain).collect()] == [0.0]
    old = spark.createDataFrame([("a", "x")], "host_id string, hostname string")
    new = spark.createDataFrame([("a", "u", 2), ("a", "w", 3), ("a", "v", 1), ("b", "z", 1)], "host_id string, hostname string, seq int")
    got = sinks.upsert(old, new.repartition(4), "host_id", order=["seq"])
    assert sorted(map(tuple, got.collect())) == [("a", "w"), ("b", "z")]


def test_repeated_changes_and_tickets(spark):
    tickets = spark.createDataFrame([("t1", "new", T0, T0, "r1"), ("t2", "new", T0, T0 + timedelta(hours=1), "r1")],
                                    "ticket_id string, status string, updated_at timestamp, created_at timestamp, agent_run_id string")
    changes = spark.createDataFrame([("t1", "closed", 2), ("t1", "resolved", 1), ("t9", "new", 1), ("t9", "new", 2)],
                                    "ticket_id string, status string, seq int")
    updated, unknown = sinks.update_status(tickets, changes, T0, order=["seq"])
    assert sorted((r.ticket_id, r.status) for r in updated.collect()) == [("t1", "closed"), ("t2", "new")]
    assert [r.ticket_id for r in unknown.collect()] == ["t9"]
    runs = spark.createDataFrame([("r1", None), ("r2", None)], "run_id string, ticket_id string")
    assert sorted(map(tuple, sinks.link_tickets(runs, tickets).collect())) == [("r1", "t2"), ("r2", None)]


def test_append_partitioned_prunes_by_day(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.append_partitioned(samples(spark, [(0, "a", "/", 1), (60 * 24, "a", "/", 2)]), path)
    stored = spark.read.parquet(path).where(F.col(sinks.DAY) == F.lit("2026-04-02").cast("date"))
    assert [r.in_use_pct for r in stored.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(run_date" in stored._jdf.queryExecution().executedPlan().toString()


def test_trailing_window_skips_old_days(spark, tmp_path):
    path = str(tmp_path / "p")
    days = [(60 * 24 * day, "a", "/", day) for day in range(10)]
    sinks.append_partitioned(samples(spark, days), path)
    window = scans.trailing(spark.read.parquet(path), T0 + timedelta(days=9), days=3)
    assert sorted(r.in_use_pct for r in window.collect()) == [6.0, 7.0, 8.0, 9.0]
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "run_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in plan
    assert sinks.retained(spark.read.parquet(path), T0 + timedelta(days=31), 30).count() == 9


def test_answers_from_json_lines(spark, tmp_path):
    path = tmp_path / "answers.json"
    path.write_text('{"host_id":"h","prediction_id":"p","raw":"{\\"recommendation\\":\\"clean\\"}"}\n')
    row = scans.read_json_answers(spark, str(path)).first()
    assert (row.host_id, row.prediction_id, row.raw) == ("h", "p", '{"recommendation":"clean"}')


def test_upserts(spark):
    old = spark.createDataFrame([("a", "x", "web"), ("b", "y", "db")], "host_id string, hostname string, role string")
    new = spark.createDataFrame([("b", "Y", None), ("c", "z", "app")], "host_id string, hostname string, role string")
    full = sorted(map(tuple, sinks.upsert(old, new, "host_id").collect()))
    assert full == [("a", "x", "web"), ("b", "Y", None), ("c", "z", "app")]
    part = sorted(map(tuple, sinks.upsert(old, new, "host_id", ["hostname"]).collect()))
    assert part == [("a", "x", "web"), ("b", "Y", "db"), ("c", "z", "app")]


def test_status_link_and_delete(spark):
    tickets = spark.createDataFrame([("t1", "new", T0, T0, "r1"), ("t2", "new", T0, T0, "r2")],
                                    "ticket_id string, status string, updated_at timestamp, created_at timestamp, agent_run_id string")
    changes = spark.createDataFrame([("t1", "closed"), ("t9", "closed")], "ticket_id string, status string")
    later = T0 + timedelta(days=1)
    updated, unknown = sinks.update_status(tickets, changes, later)
    assert {r.ticket_id: (r.status, r.updated_at) for r in updated.collect()} == {"t1": ("closed", later), "t2": ("new", T0)}
    assert [r.ticket_id for r in unknown.collect()] == ["t9"]
    runs = spark.createDataFrame([("r1", None), ("r3", "old")], "run_id string, ticket_id string")
    assert {r.run_id: r.ticket_id for r in sinks.link_tickets(runs, tickets).collect()} == {"r1": "t1", "r3": "old"}
    rows = samples(spark, [(0, "demo-a", "/", 1), (0, "host-b", "/", 1), (0, "host-c", "/", 1)])
    hosts = lambda df: sorted(r.host_id for r in df.collect())
    assert hosts(sinks.delete_hosts(rows, ["host-b"])) == ["demo-a", "host-c"]
    assert hosts(sinks.delete_prefix(rows, "demo-")) == ["host-b", "host-c"]
    assert hosts(sinks.delete_prefix(rows, "demo-", invert=True)) == ["demo-a"]
    assert hosts(sinks.truncate(rows)) == []
    assert hosts(sinks.retained(rows, T0 + timedelta(days=31))) == []


def test_scans(spark):
    rows = samples(spark, [(0, "a", "/y", 1), (5, "a", "/x", 2), (10, "a", "/y", 3), (20, "b", "/z", 4)])
    now = T0 + timedelta(minutes=20)
    assert [r.y for r in scans.host_series(rows, "a", now).collect()] == [1.0, 3.0]
    assert [r.y for r in scans.host_series(rows, "a", now, device="/x").collect()] == [2.0]
    assert sorted(r.in_use_pct for r in scans.pinned_series(rows).collect()) == [1.0, 3.0, 4.0]
    assert [r.in_use_pct for r in scans.recent_samples(rows, "a", T0 + timedelta(hours=168, minutes=5)).collect()] == [2.0, 3.0]
    hosts = spark.createDataFrame(
        [("a", "n", "linux", "prod", "eu", "web", 1.0, "/", T0)],
        "host_id string, hostname string, os string, environment string, region string, role string, total_disk_gb double, monitored_path string, created_at timestamp")
    assert scans.host_metadata(hosts, "a").hostname == "n"
    with pytest.raises(ValueError, match="unknown host_id 'zz'"):
        scans.host_metadata(hosts, "zz")


def test_ticket_filters(spark):
    rows = [(f"t{i}", ("new", "closed")[i % 2], ("P1", "P2", "P3")[i % 3], T0 + timedelta(minutes=i)) for i in range(12)]
    df = spark.createDataFrame(rows, "ticket_id string, status string, severity string, created_at timestamp")
    assert [r.ticket_id for r in scans.list_tickets(df, limit=2).collect()] == ["t11", "t10"]
    assert [r.ticket_id for r in scans.list_tickets(df, "new", "P1").collect()] == ["t6", "t0"]
    assert scans.list_tickets(df, severity="P2").count() == 4


def test_validation(spark):
    df = spark.createDataFrame(
        [(T0, "a", "/", 100, 40, 60, 40.0), (T0, "a", "/", 100, 40, 59, 140.0), (T0, "b", None, 0, 0, 0, None)], SAMPLE)
    good, bad = validate.split_rows(df, validate.telemetry_rules())
    assert good.count() == 1
    assert sorted(r.violations for r in bad.collect()) == [["key_missing", "pct_range", "total_not_positive"], ["pct_range", "bytes_do_not_add_up"]]
    tickets = spark.createDataFrame([("new", "P1"), ("open", "P9"), (None, "P2")], "status string, severity string")
    assert [r.violations for r in validate.check_rows(tickets, validate.ticket_rules()).collect()] == [[], ["status_unknown", "severity_unknown"], ["status_unknown"]]
    scores = spark.createDataFrame([("p", "h", 1.0), ("p", "h", 1.1), ("p", None, 0.5)], "prediction_id string, host_id string, anomaly_score double")
    assert [r.violations for r in validate.check_rows(scores, validate.prediction_rules()).collect()] == [[], ["anomaly_range"], ["key_missing"]]
    child = spark.createDataFrame([("1", "a"), ("2", "zz"), ("3", None)], "id string, host_id string")
    parent = spark.createDataFrame([("a",)], "host_id string")
    assert [r.id for r in validate.orphans(child, parent, "host_id", "host_id").collect()] == ["2"]


def test_latest_and_overview(spark):
    preds = spark.createDataFrame(
        [("p1", T0, "a", "/", 0.9, 50.0, None, True), ("p2", T0 + timedelta(hours=1), "a", "/", 0.1, None, None, False),
         ("p3", T0, "b", "/", 0.1, 95.0, 3.0, True), ("p4", T0, "b", "/x", 0.2, 95.0, 3.0, False)],
        "prediction_id string, ts timestamp, host_id string, device string, anomaly_score double, forecast_7d_pct double, hours_to_90pct double, triggered_agent boolean")
    assert sorted(r.prediction_id for r in latest.latest_predictions(preds).collect()) == ["p2", "p3", "p4"]
    assert sorted(r.prediction_id for r in latest.latest_predictions(preds, ["a"]).collect()) == ["p2"]
    # a was triggered before, but not by its newest prediction; b ties and p4 is the larger id
    assert latest.triggered_hosts(preds).count() == 0
    hosts = spark.createDataFrame(
        [("a", "web", "prod", 100.0), ("b", "db", "dev", 100.0), ("demo-c", "app", "dev", None)],
        "host_id string, role string, environment string, total_disk_gb double")
    rows = samples(spark, [(0, "a", "/", 95), (5, "a", "/", 91), (0, "demo-c", "/", 99)])
    view = fleet.fleet_overview(hosts, rows, preds)
    got = {r.host_id: (r.in_use_pct, r.status, r.is_demo_host) for r in view.collect()}
    assert got == {"a": (91.0, "critical", False), "b": (None, "healthy", False), "demo-c": (99.0, "no_prediction", True)}
    assert fleet.fleet_kpis(view).first().asDict() == {"total": 3, "triggered": 0, "anomalous": 0, "breach_in_7d": 1, "demo_count": 1}
    assert fleet.filter_fleet(view).count() == 3
    assert fleet.filter_fleet(view, environments=["dev"], demo_only=True).count() == 1
    assert [r.marker_size for r in fleet.scatter_input(view).collect()] == [100.0]


def test_latest_rows_without_sorting_facts(spark, tmp_path):
    """Ties, nulls among keys and times, and plans that sort nothing but the rows of equal times."""
    rows = [(k, f"d{i % 3}", T0 + timedelta(minutes=i % 50), i, f"s{i}") for i in range(900) for k in ("hot",)]
    rows += [("a", "d", None, 1, "x"), ("a", "e", None, 2, "y"), (None, "d", T0, 3, "z"), (None, "d", T0 + timedelta(hours=1), 4, "w")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "host_id string, device string, ts timestamp, n int, s string").write.parquet(path)
    df = spark.read.parquet(path)
    newest = latest.latest_per(df, ["host_id"], "ts", ["device", "n"])
    got = {r.host_id: (r.device, r.n, r.s) for r in newest.collect()}
    best = max((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[1], r[3]))
    assert got == {"hot": (best[1], best[3], best[4]), "a": ("e", 2, "y"), None: ("d", 4, "w")}
    plan = newest._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("FileScan")[0]
    assert "BroadcastHashJoin" in scan and "SortMergeJoin" not in plan


def test_one_per_key_puts_only_repeats_in_order(spark):
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 0, "z"), (None, 5, "p"), (None, 4, "q"), ("c", 9, None)]
    df = spark.createDataFrame(rows, "k string, n int, s string").coalesce(1)
    first = {r.k: (r.n, r.s) for r in sinks.one_per_key(df, ["k"]).collect()}
    assert first == {"a": (1, "x"), "b": (2, "y"), None: (5, "p"), "c": (9, None)}
    last = {r.k: r.n for r in sinks.one_per_key(df, ["k"], ["n"], last=True).collect()}
    assert last == {"a": 1, "b": 2, None: 5, "c": 9}
    plain = sinks.one_per_key(df.where("k IN ('b', 'c')"), ["k"])
    assert plain.count() == 2 and "Sort" not in plain._jdf.queryExecution().executedPlan().toString()
