"""Registry of queries and small output helpers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brimwatch.session import configure

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)

        ENTRIES[name] = Entry(run, sql)
        return function

    return wrap


def r6(value: Column | str) -> Column:
    """Comparable double: six decimals, no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def r9(value: Column | str) -> Column:
    """Nine decimals, for means of values with three: keeps clear of rounding ties."""
    return F.round(value, 9) + F.lit(0.0)


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
