"""Training-order materialisation of token sequences (operator 4).

Token ids are cut into sequences of one length. A keyed Feistel network, walked
until it lands inside the number of sequences, maps every sequence to a slot of
its own, so the training order is a shuffle that needs no sort key and can be
computed at any place. Sequences are range partitioned by slot and written as
shards of fixed-stride records: slot s is record ``s % per_shard`` of shard
``s // per_shard``, and a reader continues from any slot by one seek.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brimwatch.llm.common import mix, seeds, stage
from brimwatch.llm.tokens import encoded, public_path
from brimwatch.session import fresh_dir

#: Words of a record before its ids: sequence number (two words) and ids in use.
HEADER = 3


@dataclass(frozen=True)
class Order:
    length: int = 2048
    per_shard: int = 4096
    key: int = 20_240_601
    rounds: int = 6
    end: int = 2
    #: Bytes per id on disk; two hold vocabularies below 65,536.
    id_bytes: int = 2

    @property
    def record(self) -> int:
        """Bytes of a record: header, ids, and a closing word of zeros."""
        return 4 * HEADER + self.length * self.id_bytes + 4

    @property
    def kind(self) -> str:
        return f"<u{self.id_bytes}"


def feistel(values: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 chosen by ``key``, or its inverse.

    The network permutes the next larger square power of two; a value that falls
    outside is sent through again until it is inside.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = seeds(rounds, key % (1 << 32) + 1)
    out = np.asarray(values, dtype=np.uint64).copy()
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & low
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (mix(right ^ k) & low)
        out[open_] = (left << np.uint64(half)) | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def _cut(path: str, order: Order, id_kind: str):
    """Rows (doc_id, text, part) to the sequences of their task: packed ids and the documents in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=4)
        names = ["part", "local", "used", "doc_ids", "doc_starts", "ids"]
        tail = np.zeros(0, np.uint32)
        tail_docs: list = []
        tail_starts = np.zeros(0, np.int64)
        part, local, kind = 0, 0, None

        def out(ids, docs, starts, last):
            """Whole sequences of ``ids``; docs[i] begins or goes on at starts[i]."""
            nonlocal local
            n = -(-len(ids) // order.length) if last else len(ids) // order.length
            used, doc_ids, doc_starts, packed = [], [], [], []
            for i in range(n):
                a, b = i * order.length, min(len(ids), (i + 1) * order.length)
                lo = int(np.searchsorted(starts, a, side="right")) - 1
                hi = int(np.searchsorted(starts, b, side="left"))
                used.append(b - a)
                doc_ids.append(docs[lo:hi])
                doc_starts.append(np.maximum(starts[lo:hi] - a, 0).tolist())
                packed.append(pack.compress(ids[a:b].astype(order.kind).tobytes()))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()),
                    pa.array(range(local, local + n), pa.int64()),
                    pa.array(used, pa.int32()),
                    pa.array(doc_ids, pa.list_(kind)),
                    pa.array(doc_starts, pa.list_(pa.int32())),
                    pa.array(packed, pa.binary()),
                ],
                names=names,
            )
            local += n
            return batch, n * order.length

        for piece, ids, offsets in encoded(batches, path, order.end):
            kind = piece.schema.field("doc_id").type
            if not piece.num_rows:
                continue
            part = piece.column("part")[0].as_py()
            docs = tail_docs + piece.column("doc_id").to_pylist()
            starts = np.concatenate((tail_starts, offsets[:-1] + len(tail)))
            ids = np.concatenate((tail, ids))
            batch, done = out(ids, docs, starts, last=False)
            if batch.num_rows:
                yield batch
            lo = max(0, int(np.searchsorted(starts, done, side="right")) - 1)
            tail, tail_docs = ids[done:], docs[lo:] if len(ids) > done else []
            tail_starts = np.maximum(starts[lo:] - done, 0) if len(ids) > done else np.zeros(0, np.int64)
        if len(tail):
            yield out(tail, tail_docs, tail_starts, last=True)[0]

    schema = (
        f"part int, local long, used int, doc_ids array<{id_kind}>, doc_starts array<int>, ids binary"
    )
    return run, schema


def _records(order: Order):
    """Rows (shard, slot, sequence, used, ids), sorted by slot, to (shard, record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            records = []
            for sequence, used, ids in zip(
                batch.column("sequence_id").to_pylist(), batch.column("used").to_pylist(), batch.column("ids"),
                strict=True,
            ):
                head = np.array([sequence & 0xFFFFFFFF, sequence >> 32, used], dtype="<u4").tobytes()
                body = unpack.decompress(ids.as_buffer(), max_output_size=order.length * order.id_bytes)
                # The writer adds the closing word.
                records.append(head + body.ljust(order.length * order.id_bytes, b"\0"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array(records, pa.binary())], names=["shard", "record"]
            )

    return run


def write_shards(docs: DataFrame, out: str, path: str | None = None, order: Order = Order()) -> DataFrame:
    """Write the shards below ``out``; returns the index, one row per sequence.

    A sequence has ``order.length`` ids of documents in the order of the input,
    each followed by the end id; the last one of a task is filled up with zeros.
    Its number counts the sequences of the cut table, which is staged and is what
    the shards are made of. The index has sequence_id, slot, shard, byte_offset,
    n_tokens, doc_ids and doc_starts. A null or empty text has the end id alone;
    an empty table gives no shards. Other columns are not read.
    """
    path = path or public_path()
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    run, schema = _cut(path, order, id_kind)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    cut = stage(source.mapInArrow(run, schema), "cut")
    # One row per task of the cut, then the number of sequences before each.
    sizes = cut.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stage(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    total = cut.count()

    def slot_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("sequence_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(feistel(numbers, total, order.key, order.rounds))],
                names=[*batch.schema.names, "slot"],
            )

    def placed(columns: str, types: str) -> DataFrame:
        numbered = cut.join(F.broadcast(offsets), "part")  # a row per task
        numbered = numbered.select((F.col("local") + F.col("before")).alias("sequence_id"), *columns.split())
        with_slot = numbered.mapInArrow(slot_of, f"sequence_id long, {types}, slot long")
        return with_slot.withColumn("shard", F.floor(F.col("slot") / F.lit(order.per_shard)).cast("long"))

    bodies = placed("used ids", "used int, ids binary")
    ranged = bodies.repartitionByRange("shard").sortWithinPartitions("slot")
    records = ranged.mapInArrow(_records(order), "shard long, record binary")
    (
        records.select("shard", F.col("record").cast("string").alias("value"))
        .write.partitionBy("shard")
        .option("lineSep", "\0\0\0\0")
        .text(out)
    )
    index = placed("used doc_ids doc_starts", f"used int, doc_ids array<{id_kind}>, doc_starts array<int>")
    return index.select(
        "sequence_id",
        "slot",
        "shard",
        (F.pmod("slot", F.lit(order.per_shard)) * order.record).alias("byte_offset"),
        F.col("used").cast("long").alias("n_tokens"),
        "doc_ids",
        "doc_starts",
    )


def read_shards(spark: SparkSession, out: str, order: Order = Order()) -> DataFrame:
    """What the shards hold: slot, sequence_id, n_tokens, ids_crc32 of the ids in use, ids as stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                first = int(path.split("shard=")[1].split("/")[0]) * order.per_shard
                n, rest = divmod(len(data), order.record)
                if rest:
                    raise ValueError(f"{path} has a broken record")
                heads = np.ndarray((n, HEADER), "<u4", data, strides=(order.record, 4)).astype(np.int64)
                bodies = [
                    data.slice(i * order.record + 4 * HEADER, int(heads[i, 2]) * order.id_bytes) for i in range(n)
                ]
                crc = [zlib.crc32(np.frombuffer(b, order.kind).astype("<u4").tobytes()) for b in bodies]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(first, first + n)),
                        pa.array(heads[:, 0] | heads[:, 1] << 32),
                        pa.array(heads[:, 2]),
                        pa.array(crc, pa.int64()),
                        pa.array([b.to_pybytes() for b in bodies], pa.binary()),
                    ],
                    names=["slot", "sequence_id", "n_tokens", "ids_crc32", "ids"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out)
    return files.select("path", "content").mapInArrow(
        run, "slot long, sequence_id long, n_tokens long, ids_crc32 long, ids binary"
    )


def materialise(docs: DataFrame, path: str | None = None, order: Order = Order()) -> DataFrame:
    """Write the shards to the shared folder and return their index with the checksums read back.

    Columns: sequence_id, slot, shard, byte_offset, n_tokens, ids_crc32 (unsigned, little-endian
    unsigned 32-bit ids), doc_ids, doc_starts (where in the sequence each document begins or goes on).
    """
    spark = docs.sparkSession
    out = fresh_dir(spark, "shards")
    index = write_shards(docs, out, path, order)
    if not index.limit(1).count():
        return index.withColumn("ids_crc32", F.lit(0).cast("long"))
    stored = read_shards(spark, out, order).select("slot", "sequence_id", "ids_crc32")
    return index.join(stored, ["slot", "sequence_id"]).select(
        "sequence_id", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids", "doc_starts"
    )
