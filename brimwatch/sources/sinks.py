"""Writes and table maintenance (SNK1-SNK10).

Tables are parquet folders. Maintenance operators return the new state of a
table as a DataFrame; ``rewrite`` puts it into a fresh folder of the shared
location, so a failed job never leaves a half-written table behind.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brimwatch.operators.skew import lookup, same_keys
from brimwatch.schemas import DAY
from brimwatch.session import cut_lineage, fresh_dir
from brimwatch.sources.keyed import KeyedTable
from brimwatch.sources.scans import newer_than

TELEMETRY_KEY = ("host_id", "device", "ts")


def with_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(DAY, F.to_date(ts))


def append_partitioned(df: DataFrame, path: str, ts: str = "ts") -> None:
    """SNK4. Append, one folder per day; output files are balanced at run time."""
    with_day(df, ts).hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def read_partitioned(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table, or an empty one before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return with_day(like).limit(0)


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str] = (), last: bool = False) -> DataFrame:
    """The first, or last, row of every key by the columns ``order``.

    Ties, and frames without such columns, go by the order in which the rows are
    read, which is that of arrival only where one task reads them; name columns
    where it matters. Keys are counted by a hash aggregate; only rows of
    repeated keys are put in order. The result is fixed: a retried task sees the
    same rows.
    """
    key = list(key)
    rest = [name for name in df.columns if name not in key]
    if not rest:
        return df.distinct()
    fixed = cut_lineage(df.withColumn("_arrival", F.monotonically_increasing_id()))
    repeated = fixed.groupBy(*(F.col(k).alias(f"_of_{k}") for k in key)).agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = lookup(repeated.drop("_n"))
    if repeated.isEmpty():
        return fixed.select(*df.columns)
    on = same_keys(fixed, repeated, key)
    pick = F.max_by if last else F.min_by
    best = pick(F.struct(*rest), F.struct(*order, "_arrival")).alias("_row")
    chosen = fixed.join(repeated, on, "left_semi").groupBy(*key).agg(best).select(*key, "_row.*")
    once = fixed.join(repeated, on, "left_anti")
    return once.select(*df.columns).unionByName(chosen.select(*df.columns))


def insert_ignore(
    batch: DataFrame, path: str, key: Sequence[str] = TELEMETRY_KEY, order: Sequence[str] = ()
) -> None:
    """SNK1. Idempotent append by day: the first write of a key wins, also within the batch.

    ``order`` names columns that tell the first row of a key, else it is the first one read.
    Only the stored days the batch touches are read for the comparison.
    """
    key = list(key)
    spark = batch.sparkSession
    staged = with_day(one_per_key(batch, key, order))
    days = [row[0] for row in staged.select(DAY).distinct().collect()]  # calendar days only
    if not days:
        return
    stored = read_partitioned(spark, path, batch).where(F.col(DAY).isin(days))
    fresh = staged.join(stored.select(*key), key, "left_anti")
    fresh.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def upsert(
    target: DataFrame, updates: DataFrame, key: str, columns: Sequence[str] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """SNK2, SNK3. Last write wins on all, or only on the given, columns.

    New keys come in whole; on existing keys the other columns keep their value.
    Of several updates of a key the last by ``order`` counts, as in ``one_per_key``.
    """
    updates = one_per_key(updates, [key], order, last=True)
    overwrite = set(columns if columns is not None else [c for c in target.columns if c != key])
    new = updates.withColumn("_new", F.lit(True)).alias("u")
    joined = target.withColumn("_old", F.lit(True)).alias("t").join(
        new, F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer"
    )
    out = [F.coalesce(F.col(f"u.{key}"), F.col(f"t.{key}")).alias(key)]
    for name in target.columns:
        if name == key:
            continue
        if name not in updates.columns:
            out.append(F.col(f"t.{name}").alias(name))
            continue
        take_new = F.col("u._new") if name in overwrite else F.col("u._new") & F.col("t._old").isNull()
        out.append(F.when(take_new, F.col(f"u.{name}")).otherwise(F.col(f"t.{name}")).alias(name))
    return joined.select(*out).select(*target.columns)


def upsert_stored(
    table: KeyedTable, updates: DataFrame, columns: Sequence[str] | None = None, order: Sequence[str] = ()
) -> None:
    """SNK2, SNK3 on a stored table: ``upsert`` of the buckets that the updates fall in."""
    (key,) = table.key
    table.merge(updates, lambda old, new: upsert(old, new, key, columns, order))


def update_stored_status(
    table: KeyedTable, changes: DataFrame, as_of: datetime, order: Sequence[str] = ()
) -> DataFrame:
    """SNK7 on a stored table: ``update_status`` of the buckets that the changes fall in. Returns unknown ticket ids."""
    unknown = cut_lineage(
        changes.select("ticket_id").distinct().join(table.read().select("ticket_id"), "ticket_id", "left_anti")
    )
    known = changes.join(unknown, "ticket_id", "left_anti")
    table.merge(known, lambda old, new: update_status(old, new, as_of, order)[0])
    return unknown


def link_tickets(runs: DataFrame, tickets: DataFrame) -> DataFrame:
    """SNK6. Runs with the id of the newest ticket filed for them."""
    filed = tickets.groupBy(F.col("agent_run_id").alias("run_id")).agg(
        F.max_by("ticket_id", F.struct("created_at", "ticket_id")).alias("_filed")
    )
    return (
        runs.join(filed, "run_id", "left")
        .withColumn("ticket_id", F.coalesce("_filed", "ticket_id"))
        .select(*runs.columns)
    )


def update_status(
    tickets: DataFrame, changes: DataFrame, as_of: datetime, order: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """SNK7. (tickets with new status and update time, unknown ticket ids).

    Of several changes of a ticket the last by ``order`` counts, as in ``one_per_key``.
    """
    changes = one_per_key(changes, ["ticket_id"], order, last=True)
    wanted = changes.select("ticket_id", F.col("status").alias("_status"))
    touched = F.col("_status").isNotNull()
    updated = (
        tickets.join(wanted, "ticket_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("updated_at", F.when(touched, F.lit(as_of)).otherwise(F.col("updated_at")))
        .select(*tickets.columns)
    )
    unknown = changes.select("ticket_id").join(tickets.select("ticket_id"), "ticket_id", "left_anti")
    return updated, unknown


def replace_table(df: DataFrame, path: str) -> None:
    """SNK8. Full replacement; running it twice leaves the same table."""
    df.write.mode("overwrite").parquet(path)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """SNK9. Rows that stay; a condition that is unknown for a row keeps it."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_hosts(df: DataFrame, host_ids: Sequence[str]) -> DataFrame:
    return delete_where(df, F.col("host_id").isin(list(host_ids)))


def delete_prefix(df: DataFrame, prefix: str, invert: bool = False) -> DataFrame:
    matches = F.startswith("host_id", F.lit(prefix))
    return delete_where(df, ~matches if invert else matches)


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def retained(telemetry: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """SNK10. Samples young enough to keep. Of a table by day the old folders are not read."""
    return newer_than(telemetry, as_of - timedelta(days=days))


def rewrite(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a new folder in the shared location and read it back."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """SNK5. Audit rows; tool calls and document ids stay nested columns."""
    runs.write.mode("append").parquet(path)


def as_json(runs: DataFrame) -> DataFrame:
    """SC12. Nested columns as JSON text, for consumers without nested types."""
    return runs.withColumn("tool_calls", F.to_json("tool_calls"))
