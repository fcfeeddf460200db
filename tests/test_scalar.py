from __future__ import annotations

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from brimwatch.config import parse_horizons
from brimwatch.functions import scalar as S


def test_rounding_equals_python(spark):
    random.seed(1)
    values = [0.075, 20.0115, 0.0005, 0.125, 0.375, 2.5, 0.8445, 0.0, -0.125, 100000.0005]
    values += [round(random.random() * 10 ** random.randint(-3, 5), random.randint(1, 6)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(
        "x",
        *[S.round_exact(F.col("x"), k).alias(f"r{k}") for k in (1, 2, 3)],
        *[S.fixed(F.col("x"), k).alias(f"f{k}") for k in (1, 2, 3)],
    ).collect()
    for row in rows:
        for k in (1, 2, 3):
            assert row[f"r{k}"] == round(row.x, k)
            assert row[f"f{k}"] == f"{row.x:.{k}f}"


def test_null_stays_null(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x")
    row = df.select(
        S.clip(F.col("x"), 0, 1).alias("a"), S.fixed(F.col("x"), 1).alias("b"), S.round_exact(F.col("x")).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == (None, None, None)


@pytest.mark.parametrize("glob", ["*.log.[0-9]*", "*.log.gz", "*-archive-*.log*", "junk-*.bin", "a?c", "x[!y]z"])
def test_glob_equals_shell_matching(glob):
    names = ["a.log.1", "a.log", "b.log.gz", "x-archive-1.log", "x-archive-1.log.gz", "junk-1.bin",
             "junk-.bin.x", "abc", "ac", "xyz", "xaz", "a.log.10", "Alog.1"]
    for name in names:
        assert bool(re.match(S.glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob), name


def test_paths_and_live_logs(spark):
    rows = spark.createDataFrame(
        [("/var/log/a.log", 0.5), ("/var/log/a.log", 2.0), ("/var/log/a.log.1", 0.1), ("/var/logs/a.log", 0.1),
         ("/var/log", 0.0), ("/var/log/x-old.log", 0.1)], "path string, age double")
    got = rows.select(
        S.is_under(F.col("path"), F.lit("/var/log/")).alias("under"),
        S.is_active_log(F.col("path"), F.col("age")).alias("live"),
    ).collect()
    assert [r.under for r in got] == [True, True, True, False, True, True]
    assert [r.live for r in got] == [True, False, False, True, False, False]


def test_bytes_from_pct_uses_the_unrounded_value(spark):
    row = spark.sql("SELECT 100.0D AS gb, 33.33349D AS pct").select(*S.bytes_from_pct(F.col("gb"), F.col("pct"))).first()
    total = 100 * 1024**3
    assert (row.total_bytes, row.used_bytes) == (total, int(total * (33.33349 / 100.0)))
    assert row.free_bytes == total - row.used_bytes and row.in_use_pct == 33.333


def test_ids_and_horizons(spark):
    row = spark.sql("SELECT timestamp'2026-04-01 10:00:00' AS ts").select(
        S.numbered_id(S.month_prefix(F.col("ts")), F.lit(7)).alias("a"),
        S.numbered_id(S.month_prefix(F.col("ts")), F.lit(12345)).alias("b"),
        S.short_id("run-", F.lit("x"), F.lit("y")).alias("c"),
    ).first()
    assert row.a == "INC-2026-04-0007" and row.b == "INC-2026-04-12345"
    assert re.fullmatch(r"run-[0-9a-f]{12}", row.c)
    assert parse_horizons("1, 3,7,,14") == (1, 3, 7, 14)
