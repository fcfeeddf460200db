"""Every registered query on the smallest sample, next to its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return connection


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    # The optional training-data queries have tests of their own.
    without = {n for n in set(contract.queries()) - set(contract.oracle_sql()) - set(contract.QUERIES)}
    assert without == {"forecast_piecewise", "anomaly_train", "anomaly_score", "cycle_fleet"}


def test_entry(spark, data):
    rows = contract.entry(spark)
    assert rows.count() > 0 and "triggered_agent" in rows.columns


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equal_to_sql(spark, data, con, name):
    df = contract.queries()[name](spark, data)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [item[0] for item in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = cells(columns, cursor.fetchall())
    assert cells(df.columns, [tuple(row) for row in df.collect()]) == want


def test_triage(spark, data):
    rows = contract.queries()["triage_runs"](spark, data).collect()
    assert rows and len({row.run_id for row in rows}) == len(rows)
    for row in rows:
        assert row.decision in ("auto_remediate", "chat_approval", "ticket_only")
        ticket = row.verdict == "escalated_anomaly" or row.decision == "ticket_only"
        assert (row.ticket_id is not None) == ticket
        assert (row.files_deleted > 0) == (row.verdict == "cleaned")
