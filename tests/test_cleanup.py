from __future__ import annotations

import fnmatch
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brimwatch.config import Settings
from brimwatch.operators import cleanup

NOW = datetime(2026, 5, 1)
GIB = 1024**3
HOSTS = [("w", "/var/log", "web"), ("a", "/var/log/", "app"), ("d", "/pg", "db"), ("x", "/var/log", "cache"), ("big", "/var/log", "app")]


def brute(files, settings):
    """One host after the other, one file after the other."""
    out = {}
    for host, root, role in HOSTS:
        rules = cleanup.PLAYBOOKS.get(role, cleanup.PLAYBOOKS["app"])
        mine = []
        for _, path, size, mtime in (f for f in files if f[0] == host):
            age = max(0.0, (NOW - mtime).total_seconds() / 86400)
            for number, rule in enumerate(rules, 1):
                if fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], rule.glob) and int(age) >= max(1, int(rule.min_age_days)):
                    mine.append((mtime, number, path, size, age))
                    break
        freed = taken = 0
        for mtime, number, path, size, age in sorted(mine):
            top = root.rstrip("/")
            if not (path == top or path.startswith(top + "/")):
                action = "skip_outside"
            elif age * 24 < settings.min_file_age_hours:
                action = "skip_age"
            elif (freed + size) / GIB > settings.max_gb_per_run:
                action = "skip_bytes_cap"
            elif taken >= settings.max_files_per_run:
                action = "skip_file_cap"
            else:
                action = "delete"
                freed, taken = freed + size, taken + 1
            out[(host, path)] = (number, action)
    return out


def inventory(seed, n_small, n_big, size_of):
    random.seed(seed)
    names = ["access.log.1", "app-archive-1.log", "x.log.gz", "junk-1.bin", "postgresql-1.log", "postgresql-2.log.gz", "live.log", "data.db"]
    files = []
    for host, root, _ in HOSTS:
        for i in range(n_big if host == "big" else n_small):
            base = "/elsewhere" if i % 17 == 0 else root.rstrip("/")
            files.append((host, f"{base}/{i}/{random.choice(names)}", size_of(), NOW - timedelta(hours=random.randrange(0, 24 * 90))))
    return files


CASES = {
    "both caps": (Settings(), 60, 900, lambda: random.choice([10, 3 * GIB, GIB // 2, 79 * GIB])),
    "file cap": (Settings(max_files_per_run=7), 60, 300, lambda: random.randrange(1, GIB)),
    "byte cap": (Settings(max_gb_per_run=2.0), 60, 600, lambda: random.randrange(1, 3 * GIB)),
    "long minimum age": (Settings(min_file_age_hours=24 * 40), 60, 100, lambda: GIB // 4),
    "shrinking files": (Settings(max_gb_per_run=1.0), 10, 300, None),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block", [200, 5])
def test_plan_equals_brute_force(spark, monkeypatch, name, block):
    """Also with tiny blocks, so that hosts need many rounds."""
    settings, n_small, n_big, size_of = CASES[name]
    if block == 5:
        n_small, n_big = 15, 60
    monkeypatch.setattr(cleanup, "ROUND_FILES", block)
    if size_of is None:
        left = iter(range(10**6, 0, -1))
        size_of = lambda: next(left) * 900
    files = inventory(7, n_small, n_big, size_of)
    df = spark.createDataFrame(files, "host_id string, path string, size_bytes long, mtime timestamp")
    hosts = spark.createDataFrame(HOSTS, "host_id string, monitored_path string, role string")
    got = {(r.host_id, r.path): (r.rule_no, r.action) for r in cleanup.cleanup_plan(df, hosts, NOW, settings).collect()}
    want = brute(files, settings)
    assert got == want
    assert any(action == "delete" for _, action in want.values())


def test_totals_and_rule_pairs(spark):
    files = inventory(9, 40, 40, lambda: 100)
    df = spark.createDataFrame(files, "host_id string, path string, size_bytes long, mtime timestamp")
    hosts = spark.createDataFrame(HOSTS, "host_id string, monitored_path string, role string")
    plan = cleanup.cleanup_plan(df, hosts, NOW)
    totals = {r.host_id: r for r in cleanup.plan_totals(plan).collect()}
    for host, row in totals.items():
        assert row.bytes_freed == 100 * row.files_deleted
    pairs = cleanup.rule_matches(df, hosts, NOW)
    first = pairs.groupBy("host_id", "path").agg(F.min("rule_no").alias("rule_no"))
    assert {tuple(r) for r in first.collect()} == {(r.host_id, r.path, r.rule_no) for r in plan.collect()}


def test_unmatched_files_are_not_shuffled(spark):
    """Files that match no rule of any host are dropped below the join, and the walk's end is joined where it matters only."""
    files = [("web", f"/var/log/live{i}.db", 10, NOW - timedelta(days=99)) for i in range(50)]
    files += [("web", f"/var/log/a.log.{i}", 10, NOW - timedelta(days=99)) for i in range(3)]
    df = spark.createDataFrame(files, "host_id string, path string, size_bytes long, mtime timestamp")
    hosts = spark.createDataFrame([("web", "/var/log", "web")], "host_id string, monitored_path string, role string")
    plan = cleanup.candidates(df, hosts, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("Join"):] and "RLIKE" in plan[plan.index("Join"):]
    settings = Settings(max_files_per_run=2)
    got = {r.path: r.action for r in cleanup.cleanup_plan(df, hosts, NOW, settings).collect()}
    assert sorted(got.values()) == ["delete", "delete", "skip_file_cap"]
