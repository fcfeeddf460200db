"""Tables that are changed by key: a change rewrites only the buckets its keys fall in.

A table is a folder of parquet files in buckets by a hash of the key, and a
manifest that names the folder of every bucket. A commit writes the touched
buckets anew below ``data/commit=n`` and then the manifest ``n``; readers follow
the newest manifest that is complete, so a failed job leaves the table as it
was. What only manifests before the last but one name is deleted, so the number
of files does not grow with the number of commits. One writer at a time.

A commit may name its source and a number that rises within the source, as
micro-batches do: a number that was committed before is skipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brimwatch.session import cut_lineage

BUCKET = "_bucket"
BUCKETS = 64

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """A parquet table in buckets of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets

    # ------------------------------------------------------------- reading

    def read(self) -> DataFrame:
        """All rows of the newest commit."""
        state = self._state()
        if state is None:
            raise FileNotFoundError(f"no commit in {self.path}")
        return self._rows(state, state["folders"])

    def files(self) -> list[str]:
        """Data files of the newest commit."""
        state = self._state()
        return sorted(self.read().inputFiles()) if state and state["folders"] else []

    # ------------------------------------------------------------ changing

    def merge(
        self, changes: DataFrame, combine: Combine, source: str | None = None, number: int | None = None
    ) -> bool:
        """Put ``combine(stored rows, changes)`` in the place of the stored rows of all touched buckets.

        ``combine`` gets whole buckets and must keep rows of keys without a
        change. A table without a commit has no stored rows. Tells whether the
        commit was made, that is, not skipped as a repeat.
        """
        state = self._state() or {"version": -1, "folders": {}, "numbers": {}, "schema": None}
        if source is not None and state["numbers"].get(source, -1) >= number:
            return False
        # Fixed before its buckets are looked up, so a retried task sees the same rows.
        changes = cut_lineage(changes.withColumn(BUCKET, self._bucket()))
        touched = [str(r[0]) for r in changes.select(BUCKET).distinct().collect()]  # at most one row per bucket
        held = {b: state["folders"][b] for b in touched if b in state["folders"]}
        if state["schema"]:
            stored = self._rows(state, held)
        else:
            stored = changes.drop(BUCKET).limit(0)
        version = state["version"] + 1
        folder = f"{self.path}/data/commit={version}"
        if touched:
            rows = combine(stored, changes.drop(BUCKET))
            state["schema"] = rows.schema.jsonValue()
            rows = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)
            rows.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
            written = [n.split("=")[1] for n in self._names(folder) if n.startswith(f"{BUCKET}=")]
            state["folders"] = {b: c for b, c in state["folders"].items() if b not in touched}
            state["folders"] |= dict.fromkeys(written, version)
        if source is not None:
            state["numbers"][source] = number
        state["version"] = version
        self._commit(state)
        return True

    def remove(self, keys: DataFrame) -> None:
        """Delete the rows of some keys."""
        gone = keys.select(*self.key).distinct()
        if self._state() is not None:
            self.merge(gone, lambda stored, changes: stored.join(changes, self.key, "left_anti").select(*stored.columns))

    # -------------------------------------------------------------- inside

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, folders: dict[str, int]) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/commit={c}/{BUCKET}={b}" for b, c in sorted(folders.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where, system = self._hadoop(path)
        return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []

    def _delete(self, path: str) -> None:
        where, system = self._hadoop(path)
        system.delete(where, True)

    def _versions(self) -> list[int]:
        found = sorted((int(n) for n in self._names(f"{self.path}/manifest") if n.isdigit()), reverse=True)
        return [v for v in found if "_SUCCESS" in self._names(f"{self.path}/manifest/{v}")]

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}", wholetext=True).first()[0])

    def _state(self) -> dict | None:
        found = self._versions()
        return self._manifest(found[0]) if found else None

    def _commit(self, state: dict) -> None:
        old = self._versions()
        text = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        text.write.mode("overwrite").text(f"{self.path}/manifest/{state['version']}")
        if len(old) < 2:
            return
        # Readers may still follow the manifest before this one.
        last, before = self._manifest(old[0])["folders"], self._manifest(old[1])["folders"]
        for bucket, commit in before.items():
            if last.get(bucket) != commit and state["folders"].get(bucket) != commit:
                self._delete(f"{self.path}/data/commit={commit}/{BUCKET}={bucket}")
        for version in old[1:]:
            self._delete(f"{self.path}/manifest/{version}")
