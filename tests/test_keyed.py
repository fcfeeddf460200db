"""Tables changed by key: only touched buckets are written, repeats add nothing, files do not pile up."""

from __future__ import annotations

from datetime import datetime

import pytest

from brimwatch.sources import sinks
from brimwatch.sources.keyed import KeyedTable
from brimwatch.streaming import jobs

SCHEMA = "host_id string, v int, note string"


@pytest.fixture()
def table(spark, tmp_path):
    out = KeyedTable(spark, str(tmp_path / "t"), ["host_id"], buckets=16)
    rows = [(f"h{i}", i, None) for i in range(400)]
    out.merge(spark.createDataFrame(rows, SCHEMA), lambda old, new: new)
    return out


def content(table):
    return {r.host_id: (r.v, r.note) for r in table.read().collect()}


def test_three_keys_rewrite_three_buckets(spark, table):
    before = set(table.files())
    changes = spark.createDataFrame([("h3", -3, "x"), ("h50", -50, "y"), ("h399", 1, "z")], SCHEMA)
    sinks.upsert_stored(table, changes, ["note"])
    after = set(table.files())
    assert len(before) == len(after) == 16 and 13 <= len(before & after) < 16
    want = {f"h{i}": (i, None) for i in range(400)} | {"h3": (3, "x"), "h50": (50, "y"), "h399": (399, "z")}
    assert content(table) == want


def test_new_keys_and_removed_ones(spark, table):
    sinks.upsert_stored(table, spark.createDataFrame([("new", 7, "n"), ("h1", 8, None)], SCHEMA))
    table.remove(spark.createDataFrame([(f"h{i}",) for i in range(2, 400)], "host_id string"))
    assert content(table) == {"h0": (0, None), "h1": (8, None), "new": (7, "n")}
    table.remove(table.read().select("host_id"))
    assert content(table) == {} and table.files() == []
    sinks.upsert_stored(table, spark.createDataFrame([("again", 1, "a")], SCHEMA))
    assert content(table) == {"again": (1, "a")}


def test_repeated_numbers_are_skipped(spark, table):
    more = spark.createDataFrame([("h1", 1, "one")], SCHEMA)
    grow = lambda old, new: old.unionByName(new)
    assert [table.merge(more, grow, "s", n) for n in (0, 0, 1, 0)] == [True, False, True, False]
    assert table.merge(more, grow, "other", 0) and table.read().count() == 403
    nothing = more.where("false")
    assert table.merge(nothing, grow, "s", 2) and not table.merge(more, grow, "s", 2) and table.read().count() == 403


def test_a_commit_without_manifest_is_not_seen(spark, table, monkeypatch):
    before = content(table)

    def stop(state):
        raise OSError("lost")

    monkeypatch.setattr(table, "_commit", stop)
    with pytest.raises(OSError, match="lost"):
        sinks.upsert_stored(table, spark.createDataFrame([("h1", 99, "x")], SCHEMA))
    monkeypatch.undo()
    assert content(table) == before
    sinks.upsert_stored(table, spark.createDataFrame([("h2", 99, "x")], SCHEMA))
    assert content(table) == before | {"h2": (99, "x")}


def test_status_changes(spark, tmp_path):
    tickets = KeyedTable(spark, str(tmp_path / "t"), ["ticket_id"], buckets=8)
    old, now = datetime(2026, 1, 1), datetime(2026, 1, 2)
    rows = [(f"t{i}", "open", old) for i in range(60)]
    tickets.merge(spark.createDataFrame(rows, "ticket_id string, status string, updated_at timestamp"), lambda a, b: b)
    before = set(tickets.files())
    changes = spark.createDataFrame([("t5", "closed"), ("none", "closed")], "ticket_id string, status string")
    assert [r.ticket_id for r in sinks.update_stored_status(tickets, changes, now).collect()] == ["none"]
    got = {r.ticket_id: (r.status, r.updated_at) for r in tickets.read().collect()}
    assert got.pop("t5") == ("closed", now) and set(got.values()) == {("open", old)} and len(got) == 59
    assert len(before - set(tickets.files())) == 1


def test_files_stay_the_same_over_ten_batches(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "w")
    schema = "ts timestamp, host_id string, device string, in_use_pct double, used_bytes long, total_bytes long"
    for i in range(10):
        rows = [(datetime(2026, 4, 1, h), f"h{k}", "/", float(i), 1, 2) for h in range(4) for k in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = jobs.windows(stream(), table, str(tmp_path / "c"))
    query.awaitTermination()
    assert query.exception() is None
    stored = list((tmp_path / "w").rglob("*.parquet"))
    assert len(stored) <= 2 * 64 and len(list((tmp_path / "w" / "manifest").iterdir())) == 2
    assert {r.n for r in jobs.read_windows(spark, table).collect()} == {10}
    # The last batch comes again, as after a crash between its work and its checkpoint.
    held = jobs._windows_table(spark, table)
    assert held._state()["numbers"] == {str(tmp_path / "c"): 9}
    assert not held.merge(held.read(), jobs._added, str(tmp_path / "c"), 9)
