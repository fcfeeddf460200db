"""What triage leaves behind, stored as one outcome: runs, tickets and plans under one commit (SNK5, SNK6, TKT3, TKT4).

A commit writes its part of every table below ``commit=<name>`` and a marker
last; readers take the parts of marked commits only, so nobody sees runs without
their tickets. A commit that is repeated under its name does nothing, and runs
that are stored already are left out with their tickets and plans. One writer at
a time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimwatch.config import DEFAULTS, Settings
from brimwatch.operators import cleanup, tickets
from brimwatch.operators.skew import lookup
from brimwatch.plans.triage import Triage
from brimwatch.session import cut_lineage

def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete commits."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    done = lambda s: system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(s.getPath().getName() for s in system.listStatus(place) if done(s))


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Rows of one table in all complete commits; none if no commit has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f"{path}/{name}/commit={c}" for c in commits(spark, path)]
    parts = [p for p in parts if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    return spark.read.option("mergeSchema", "true").parquet(*parts) if parts else None


def _store(spark: SparkSession, path: str, commit: str, tables: dict[str, DataFrame]) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/commit={commit}")
    marker = spark.createDataFrame([(commit,)], "name string").coalesce(1)
    marker.write.mode("overwrite").text(f"{path}/commits/{commit}")


def store(triage: Triage, path: str, commit: str) -> bool:
    """SNK5, SNK6. One commit of a triage; tells whether it was made, that is, no repeat."""
    spark = triage.runs.sparkSession
    if commit in commits(spark, path):
        return False
    runs, known = triage.runs, read(spark, path, "runs")
    if known is not None:
        runs = runs.join(known.select("run_id"), "run_id", "left_anti").select(*runs.columns)
    runs = cut_lineage(runs)
    names = lookup(runs.select("run_id"))
    filed = triage.tickets.join(names, triage.tickets.agent_run_id == names.run_id, "left_semi")
    plans = triage.plan.join(names, "run_id", "left_semi").select(*triage.plan.columns)
    _store(spark, path, commit, {"runs": runs, "tickets": filed, "plans": plans})
    return True


def act_on_approvals(
    spark: SparkSession,
    path: str,
    answers: DataFrame,
    hosts: DataFrame,
    predictions: DataFrame,
    files: DataFrame,
    as_of: datetime,
    commit: str,
    settings: Settings = DEFAULTS,
) -> bool:
    """TKT4. Follow the answers (run_id, approved) to stored runs that wait for one.

    An approved clean-up gets its plan; other approved runs get a P2 ticket and
    denied ones a P3 ticket. An answer counts once: runs answered in an earlier
    commit stay as they are. Tells whether the commit was made, that is, no repeat.
    """
    runs = read(spark, path, "runs")
    if runs is None or commit in commits(spark, path):
        return False
    earlier, filed = read(spark, path, "approvals"), read(spark, path, "tickets")
    if earlier is not None:
        runs = runs.join(earlier.select("run_id"), "run_id", "left_anti")
    asked = answers.groupBy("run_id").agg(F.bool_and("approved").alias("approved"))
    can = runs.select("run_id", (F.col("recommendation") == "clean").alias("can_clean"))
    outcomes = tickets.resolve_approvals(runs, asked.join(can, "run_id"), settings)
    outcomes = cut_lineage(outcomes.where("outcome <> 'pending'"))
    acting = runs.join(outcomes.where("outcome = 'cleanup'").select("run_id"), "run_id", "left_semi")
    plan = cleanup.cleanup_plan(files, hosts.join(acting.select("host_id"), "host_id", "left_semi"), as_of, settings)
    plan = plan.join(acting.select("host_id", "run_id"), "host_id")
    values = predictions.drop("ts", "host_id", "device", "model_version", "triggered_agent")
    owners = hosts.select("host_id", "role", "environment", "monitored_path")
    audit = runs.join(values, "prediction_id", "left").join(owners, "host_id", "left")
    audit = audit.withColumn("finished_at", F.lit(as_of))
    made = tickets.approved_tickets(audit, outcomes, filed)
    _store(spark, path, commit, {"tickets": made, "plans": plan, "approvals": outcomes})
    return True
