"""Streams over several files against the batch answers."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brimwatch.operators import fleet, latest
from brimwatch.sources import sample
from brimwatch.streaming import jobs

T0 = datetime(2026, 4, 1)
SCHEMA = "ts timestamp, host_id string, device string, in_use_pct double, used_bytes long, total_bytes long"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    random.seed(4)
    rows = [(T0 + timedelta(minutes=7 * i), random.choice(["hot", "hot", "a", "b"]), "/", round(random.random() * 100, 3), i, 10**6) for i in range(600)]
    rows += random.sample(rows, 100)  # repeated deliveries
    folder = str(tmp_path_factory.mktemp("in"))
    for part in range(4):
        spark.createDataFrame(rows[part::4], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(rows, SCHEMA)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_ingest_is_idempotent(spark, source, tmp_path):
    folder, rows = source
    table = str(tmp_path / "t")
    finish(jobs.ingest(stream(spark, folder), table, str(tmp_path / "c1")))
    # A second job without the state of the first replays everything.
    finish(jobs.ingest(stream(spark, folder), table, str(tmp_path / "c2")))
    got = spark.read.parquet(table)
    assert got.count() == 600 and got.select("host_id", "ts").distinct().count() == 600
    assert rows.count() == 700


def test_late_rows_are_kept(spark, tmp_path):
    folder, table, windows = (str(tmp_path / name) for name in ("in", "t", "w"))
    for days in (0, -40, -400, 0):  # one file and batch each, the last one a repeat
        rows = [(T0 + timedelta(days=days), "a", "/", 50.0, 1, 2)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    finish(jobs.ingest(stream(spark, folder), table, str(tmp_path / "c1")))
    got = sorted(r.ts for r in spark.read.parquet(table).collect())
    assert got == [T0 - timedelta(days=400), T0 - timedelta(days=40), T0]
    finish(jobs.windows(stream(spark, folder), windows, str(tmp_path / "c2")))
    shares = {r.window_start: (r.n, r.mean_pct) for r in jobs.read_windows(spark, windows).collect()}
    assert shares == {T0 - timedelta(days=400): (1, 50.0), T0 - timedelta(days=40): (1, 50.0), T0: (2, 50.0)}


def test_latest_equals_batch(spark, source, tmp_path):
    folder, rows = source
    table = str(tmp_path / "t")
    finish(jobs.latest(stream(spark, folder), table, str(tmp_path / "c")))
    got = {r.host_id: (r.ts, r.in_use_pct) for r in jobs.read_latest(spark, table).collect()}
    assert got == {r.host_id: (r.ts, r.in_use_pct) for r in latest.latest_telemetry(rows).collect()}


def test_windows_equal_batch(spark, source, tmp_path):
    folder, rows = source
    table = str(tmp_path / "t")
    finish(jobs.windows(stream(spark, folder), table, str(tmp_path / "c"), "2 hours", "1 hour"))
    key = lambda r: (r.host_id, r.window_start)
    got = {key(r): (r.n, round(r.max_pct, 6)) for r in jobs.read_windows(spark, table).collect()}
    batch = fleet.telemetry_rollup(rows.withColumn("device", F.lit("/")), "2 hours", "1 hour")
    assert got == {key(r): (r.n, round(r.max_pct, 6)) for r in batch.collect()}


@pytest.mark.parametrize("width, slide", [("24 hours", "1 hour"), ("90 minutes", "1 hour"), ("1 hour", "1 hour")])
def test_sliding_windows_store_a_sample_once(spark, source, tmp_path, width, slide):
    folder, rows = source
    odd = [(T0 - timedelta(days=20000), "old", "/", None, 1, 2), (T0, "none", "/", None, 1, 2), (T0, None, "/", 5.0, 1, 2)]
    extra = str(tmp_path / "in")
    rows = rows.unionByName(spark.createDataFrame(odd, SCHEMA))
    rows.repartition(3).write.parquet(extra)
    table = str(tmp_path / "t")
    finish(jobs.windows(stream(spark, extra), table, str(tmp_path / "c"), width, slide))
    place = lambda x: None if x is None else round(x * 0.7310585786, 6)  # noqa: E731 - off the halves
    shape = lambda df: sorted([(str(r.host_id), r.window_start, r.n, place(r.mean_pct), place(r.max_pct)) for r in df.collect()], key=str)
    batch = fleet.telemetry_rollup(rows, width, slide, keys=("host_id",))
    assert shape(jobs.read_windows(spark, table)) == shape(batch)
    if width != "90 minutes":
        hours = rows.select("host_id", F.date_trunc("hour", "ts")).distinct().count()
        assert jobs._windows_table(spark, table).read().count() == hours


def test_redaction(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "mail a@b.io"), (2, "clean")], "k int, text string").write.parquet(folder)
    texts = spark.readStream.schema("k int, text string").parquet(folder)
    finish(jobs.redacted(texts, ["text"], str(tmp_path / "t"), str(tmp_path / "c")))
    assert {r.k: r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1: "mail [REDACTED:EMAIL]", 2: "clean"}


def test_scoring_follows_the_batches(spark, source, tmp_path):
    folder, rows = source
    counted = lambda df: df.groupBy("host_id").agg(F.count("*").alias("n"))
    finish(jobs.scored(stream(spark, folder), counted, lambda: rows, str(tmp_path / "t"), str(tmp_path / "c")))
    got = jobs.read_scores(spark, str(tmp_path / "t")).select("host_id", "n")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in counted(rows).collect()}


def test_sample_streams_read_files_and_folders(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    rows = spark.createDataFrame([(i, f"mail a{i}@b.io", i % 2) for i in range(10)], "doc_id long, text string, part int")
    rows.repartition(3).write.partitionBy("part").parquet(f"{many}/documents.parquet")
    rows.coalesce(1).write.parquet(f"{one}/written")
    (file,) = (tmp_path / "one" / "written").glob("part-*.parquet")
    (tmp_path / "one" / "documents.parquet").write_bytes(file.read_bytes())
    for name, folder in (("one", one), ("many", many)):
        table = str(tmp_path / f"{name}-redacted")
        texts = sample.stream(spark, folder, "documents")
        finish(jobs.redacted(texts, ["text"], table, str(tmp_path / f"{name}-state")))
        got = {(r.doc_id, r.text, r.part) for r in spark.read.parquet(table).collect()}
        assert got == {(i, "mail [REDACTED:EMAIL]", i % 2) for i in range(10)}
