"""A triage stored as one outcome, and answers that are followed once."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brimwatch import schemas as D
from brimwatch.config import DEFAULTS
from brimwatch.functions import redact as R
from brimwatch.plans import outcome
from brimwatch.plans.triage import Triage

NOW = datetime(2026, 3, 5)


def runs_of(spark, cases):
    """(name, recommendation, decision, ticket) to run rows."""
    kinds = {"clean": "no_action_needed", "escalate_anomaly": "escalated_anomaly", "no_action": "no_action_needed"}
    rows = [
        (f"run-{n}", NOW, NOW, f"h{n}", f"p{n}", 0.8, route, kinds[advice], 0, 0, ticket, "why", [], [], None)
        for n, advice, route, ticket in cases
    ]
    advice = F.create_map(*(F.lit(x) for n, a, _, _ in cases for x in (f"run-{n}", a)))
    runs = spark.createDataFrame(rows, D.RUNS)
    return runs.withColumn("recommendation", advice[F.col("run_id")]).withColumn("redactions", F.create_map(F.lit("EMAIL"), F.lit(2).cast("long")))


def triage_of(spark, cases):
    tickets = [
        (t, NOW, NOW, "new", "P3", "s", "d", f"h{n}", "g", f"run-{n}", {}) for n, _, _, t in cases if t is not None
    ]
    plan = [(f"h{n}", f"/f{n}", 5, "delete", f"run-{n}") for n, *_ in cases]
    plans = spark.createDataFrame(plan, "host_id string, path string, size_bytes long, action string, run_id string")
    runs = runs_of(spark, cases)
    return Triage(runs, plans, runs, spark.createDataFrame(tickets, D.TICKETS))


WAIT = DEFAULTS.chat_route
CASES = [
    (1, "clean", WAIT, None), (2, "escalate_anomaly", WAIT, None), (3, "clean", WAIT, None), (4, "clean", WAIT, None),
    (5, "no_action", "ticket_only", "INC-2026-03-0007"),
]


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "triage")
    assert outcome.store(triage_of(spark, CASES), path, "one")
    return path


def names(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_repeats_add_nothing_and_new_runs_come_in(spark, stored):
    assert not outcome.store(triage_of(spark, CASES), stored, "one")
    more = [*CASES, (6, "no_action", "ticket_only", "INC-2026-03-0008")]
    assert outcome.store(triage_of(spark, more), stored, "two")
    assert names(outcome.read(spark, stored, "runs"), "run_id") == [f"run-{n}" for n in range(1, 7)]
    assert names(outcome.read(spark, stored, "tickets"), "agent_run_id") == ["run-5", "run-6"]
    assert names(outcome.read(spark, stored, "plans"), "path") == [f"/f{n}" for n in range(1, 7)]


def test_without_its_marker_a_commit_is_not_seen(spark, stored):
    triage_of(spark, [(9, "clean", WAIT, None)]).runs.write.parquet(f"{stored}/runs/commit=lost")
    assert outcome.commits(spark, stored) == ["one"] and outcome.read(spark, stored, "runs").count() == 5
    assert outcome.read(spark, f"{stored}-none", "runs") is None


def test_answers_are_followed_once(spark, stored):
    hosts = spark.createDataFrame(
        [(f"h{n}", "n", "linux", "prod", "eu", "app", 100.0, "/data", NOW) for n in range(1, 6)], D.HOSTS
    )
    predictions = spark.createDataFrame(
        [(f"p{n}", NOW, f"h{n}", "/data", 1.0, 2.0, 3.0, 4.0, None, 0.5, True, "m") for n in range(1, 6)], D.PREDICTIONS
    )
    old = NOW - timedelta(days=90)
    files = spark.createDataFrame(
        [(h, p, 10, old) for h in ("h1", "h3") for p in ("/data/a.log.gz", "/data/live.log")], D.FILES
    )
    answers = spark.createDataFrame(
        [("run-1", True), ("run-2", True), ("run-3", False), ("run-5", True), ("run-x", True)], "run_id string, approved boolean"
    )
    later = NOW + timedelta(hours=1)
    act = lambda name: outcome.act_on_approvals(spark, stored, answers, hosts, predictions, files, later, name)
    assert act("answers-1") and not act("answers-1") and act("answers-2")
    assert {r.run_id: r.outcome for r in outcome.read(spark, stored, "approvals").collect()} == {
        "run-1": "cleanup", "run-2": "ticket_p2", "run-3": "ticket_p3"
    }
    made = {r.agent_run_id: (r.severity, r.ticket_id) for r in outcome.read(spark, stored, "tickets").collect()}
    assert made["run-2"][0] == "P2" and made["run-3"][0] == "P3" and set(made) == {"run-2", "run-3", "run-5"}
    assert sorted(t for _, t in made.values()) == ["INC-2026-03-0007", "INC-2026-03-0008", "INC-2026-03-0009"]
    plans = outcome.read(spark, stored, "plans").where("rule_no IS NOT NULL")
    assert [(r.run_id, r.path, r.action) for r in plans.collect()] == [("run-1", "/data/a.log.gz", "delete")]


def test_counts_of_two_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"c": 1}), (None, None)], "x map<string,int>, y map<string,long>")
    assert [r[0] for r in df.select(R.added_counts(F.col("x"), F.col("y"))).collect()] == [{"a": 1, "b": 5}, {"c": 1}, {}]
