"""Helpers shared by the operators: staged tables, Arrow batches, hashes of words."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brimwatch.session import fresh_dir

#: Bytes of text that a task turns into arrays at a time, and of those the bytes whose words are cut at a time.
SLICE_BYTES = 2 << 20
WORD_BYTES = 1 << 19
#: Largest side, in rows of at most a few dozen bytes, that is broadcast by request.
BROADCAST_ROWS = 1 << 20


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again; survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "staged_path", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a staged, narrow table of at most ``rows`` rows; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_or_null(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, each cast to its type."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece have at most ``limit`` bytes, or it is one row."""
    if not batch.num_rows:
        return
    sizes = batch.column(column)
    lengths = np.array(
        pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False), dtype=np.int64
    )
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


#: What modules remember in a worker beyond a task, as functions that forget it.
REMEMBERED: list[Callable[[], None]] = []


def start_afresh() -> None:
    """Forget what earlier operators remembered in this worker."""
    for forget in REMEMBERED:
        forget()
    give_back()


_libc = ctypes.util.find_library("c")
_trim = getattr(ctypes.CDLL(_libc), "malloc_trim", None) if _libc else None


def give_back() -> None:
    """Return freed memory to the system: workers live on and share the machine with later stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def groups(
    batches: Iterable[pa.RecordBatch], key: str, size: str | None = None, limit: int = 8 * SLICE_BYTES
) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; several groups share a table.

    A table is given out as soon as it holds a whole group and some bulk, so
    memory follows the largest group and not the partition.
    """
    held: list[pa.RecordBatch] = []
    bulk = 0
    for batch in batches:
        for piece in slices(batch, size, limit) if size else [batch]:
            if not piece.num_rows:
                continue
            held.append(piece)
            bulk += piece.nbytes
            if bulk < limit:
                continue
            whole = pa.Table.from_batches(held)
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield whole.slice(0, cut)
                held, bulk = whole.slice(cut).combine_chunks().to_batches(), 0
                bulk = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)
        held.clear()
    give_back()


def by_key(df: DataFrame, key: str, function: Callable, schema: str, *order: str) -> DataFrame:
    """Run ``function`` over the sorted rows of each partition dealt out by ``key``.

    For keys with a bounded number of rows each.
    """
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(function, schema)


def running(
    df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, name: str = "before"
) -> DataFrame:
    """Add the sum of ``weight`` (default: the number) of the earlier rows of the same key.

    Exact for a key of any size: rows are range partitioned on (keys, order), that
    layout is fixed in a staged table, and one offset per partition makes up for
    the rows before it. Rows equal in keys and order are interchangeable.
    """
    part = F.spark_partition_id().alias("_part")
    fixed = stage(df.repartitionByRange(*keys, *order).select("*", part), "ordered")
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    sizes = fixed.groupBy(*keys, "_part").agg(F.sum(amount).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        fixed.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(offsets, [*keys, "_part"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_inside", "_offset")
    )


# --------------------------------------------------------------------- hashes

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _letters() -> np.ndarray:
    """A random number per byte, the same for A-Z and a-z."""
    lower = np.arange(256)
    lower[65:91] += 32
    return seeds(256, 7919)[lower]


_LETTER = _letters()
_powers: dict[str, np.ndarray] = {}
REMEMBERED.append(_powers.clear)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, WORD_BYTES + 1)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            line = np.full(size, factor, dtype=np.uint64)
            line[0] = 1
            _powers[name] = np.cumprod(line)
    return _powers["up"], _powers["down"]


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Cut a buffer at white space into parts of about ``WORD_BYTES``."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + WORD_BYTES)
        while stop < len(data) and not _SPACE[data[stop - 1]]:
            stop += 1
        yield start, data[start:stop]
        start = stop


def words(texts: list[str | None], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the words of texts: (hashes, offsets), words of text i at offsets[i]:offsets[i+1].

    A word is a run of anything but the six ASCII white-space characters; A-Z
    count as a-z. For each of ``prefixes`` there is one more array with the
    hashes of the words' first so many bytes.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    places: list[np.ndarray] = []
    found: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    for base, data in _pieces(b"\n".join(parts) + b"\n" if parts else b""):
        raw = np.frombuffer(data, dtype=np.uint8)
        inside = ~_SPACE[raw]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power_tables(len(raw))
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[raw] * up[: len(raw)], out=total[1:])
        for out, most in zip(found, (len(raw), *prefixes), strict=True):
            stop = np.minimum(last, first + most)
            out.append(mix((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64)))
        places.append(first + base)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    offsets = np.concatenate(([0], np.searchsorted(join(places, np.int64), ends))).astype(np.int64)
    whole, *short = (join(x, np.uint64) for x in found)
    return whole, offsets, *short


_PLACE = seeds(64, 104729)


def shingles(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text.

    A text with fewer words has one shingle, the whole sequence; without words none.
    """
    hashes, offsets = words(texts)
    rolled = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for i in range(n):
        rolled += hashes[i : len(rolled) + i] * (_PLACE[i] | np.uint64(1))
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            whole = (hashes[a:b] * (_PLACE[: b - a] | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)
