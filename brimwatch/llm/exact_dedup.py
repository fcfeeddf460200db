"""Exact deduplication with counting quotient filters (operator 2).

A text's 64-bit fingerprint is split into a quotient (its top bits, the home
slot) and a remainder. Every task builds one filter of its rows; a filter is
cut into blocks of neighbouring quotients, and the blocks of all tasks are
merged by walking their sorted remainders, which adds up counters and loses
nothing. Fingerprints with a count above one go on to byte verification, where
the texts themselves are the grouping key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import slices, stage, unstage

#: Deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
#: Expected fingerprints of a block after merging.
BLOCK_ROWS = 1 << 17
#: log2 of the bits of the mark table that spares most unique texts the second shuffle (1 MiB).
MARK_BITS = 23


@dataclass
class QuotientFilter:
    """One block of a counting quotient filter.

    ``occupied`` has a bit per quotient of the block, ``run_ends`` a bit per
    remainder (the last one of its quotient's run); ``remainders`` are sorted
    within a run and ``counts`` go with them.
    """

    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray, n: int) -> QuotientFilter:
        """From any number of (quotient, remainder, count); equal pairs are added up."""
        order = np.lexsort((remainders, quotients))
        q, r, c = quotients[order], remainders[order], counts[order]
        first = np.ones(len(q), dtype=bool)
        first[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
        places = np.flatnonzero(first)
        total = np.add.reduceat(c, places) if len(places) else c
        q, r = q[places], r[places]
        occupied = np.zeros(n, dtype=bool)
        occupied[q] = True
        ends = np.ones(len(q), dtype=bool)
        ends[:-1] = q[1:] != q[:-1]
        return cls(occupied, ends, r, total)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(quotients, remainders, counts), sorted: the i-th run belongs to the i-th occupied quotient."""
        run = np.concatenate(([0], np.cumsum(self.run_ends)[:-1])).astype(np.int64)
        homes = np.flatnonzero(self.occupied)
        return homes[run[: len(self.remainders)]], self.remainders, self.counts

    def pack(self) -> bytes:
        head = np.array([len(self.occupied), len(self.remainders)], dtype="<u4").tobytes()
        return b"".join(
            (
                head,
                np.packbits(self.occupied).tobytes(),
                np.packbits(self.run_ends).tobytes(),
                self.remainders.astype("<u8").tobytes(),
                self.counts.astype("<u4").tobytes() if len(self.counts) == 0 or self.counts.max() < 1 << 32 else b"",
                b"" if len(self.counts) == 0 or self.counts.max() < 1 << 32 else self.counts.astype("<u8").tobytes(),
            )
        )

    @classmethod
    def unpack(cls, data: bytes) -> QuotientFilter:
        n, m = (int(x) for x in np.frombuffer(data, "<u4", 2))
        at = 8
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        ends = np.unpackbits(np.frombuffer(data, np.uint8, (m + 7) // 8, at), count=m).astype(bool)
        at += (m + 7) // 8
        remainders = np.frombuffer(data, "<u8", m, at).astype(np.uint64)
        at += 8 * m
        kind = "<u4" if len(data) - at == 4 * m else "<u8"
        return cls(occupied, ends, remainders, np.frombuffer(data, kind, m, at).astype(np.uint64))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        parts = [f.entries() for f in filters]
        return cls.build(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(filters[0].occupied))


@dataclass(frozen=True)
class Layout:
    """How a fingerprint is cut: block bits, then slot bits inside a block, then the remainder."""

    block_bits: int
    slot_bits: int

    @classmethod
    def of(cls, rows: int, block_rows: int = BLOCK_ROWS) -> Layout:
        slots = max(4, min(16, math.ceil(math.log2(max(16, min(rows, block_rows))))))
        return cls(max(0, min(30, math.ceil(math.log2(max(1, rows / block_rows))))), slots)

    def cut(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest = 64 - self.block_bits
        blocks = (prints >> np.uint64(rest)).astype(np.int64) if self.block_bits else np.zeros(len(prints), np.int64)
        low = prints & np.uint64((1 << rest) - 1) if self.block_bits else prints
        shift = np.uint64(rest - self.slot_bits)
        return blocks, (low >> shift).astype(np.int64), low & ((np.uint64(1) << shift) - np.uint64(1))

    def join(self, block: int, quotients: np.ndarray, remainders: np.ndarray) -> np.ndarray:
        rest = 64 - self.block_bits
        top = np.uint64((block << rest) & ((1 << 64) - 1))
        return top | (quotients.astype(np.uint64) << np.uint64(rest - self.slot_bits)) | remainders


def normal(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, WHITE)


THIN = "print long, sha string, points long, block int, filter binary"


def _scan(id_type: str, layout: Layout):
    """Per row: fingerprint, sha256, code points. Per task: the blocks of its filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        names = ["doc_id", "print", "sha", "points", "block", "filter"]
        kind = None
        held_p, held_c = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def fold():
            nonlocal held_p, held_c
            values, places = np.unique(np.concatenate([held_p, *seen]), return_inverse=True)
            weights = np.concatenate([held_c, np.ones(sum(map(len, seen)), np.uint64)])
            total = np.zeros(len(values), np.uint64)
            np.add.at(total, places, weights)
            held_p, held_c = values, total
            seen.clear()

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for piece in slices(batch, "text"):
                texts = piece.column("text").to_pylist()
                plain = [normal(t or "") for t in texts]
                prints = np.array([xxhash.xxh3_64_intdigest(p) for p in plain], dtype=np.uint64)
                seen.append(prints)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(prints.view(np.int64)),
                        pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string()),
                        pa.array([len(t or "") for t in texts], pa.int64()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
            if len(seen) > 64:
                fold()
        if kind is None:
            return
        fold()
        blocks, quotients, remainders = layout.cut(held_p)
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(blocks)], strict=True):
            packed = QuotientFilter.build(
                quotients[a:b], remainders[a:b], held_c[a:b], 1 << layout.slot_bits
            ).pack()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, kind),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.string()),
                    pa.nulls(1, pa.int64()),
                    pa.array([int(blocks[a])], pa.int32()),
                    pa.array([packed], pa.binary()),
                ],
                names=names,
            )

    return run, f"doc_id {id_type}, {THIN}"


def _repeated(layout: Layout):
    """Merge the blocks and give out the fingerprints whose counter exceeds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None

        def done():
            if held is None:
                return
            q, r, c = held.entries()
            many = c > 1
            found = layout.join(block, q[many], r[many])
            for i in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 16)].view(np.int64))], names=["print"])

        for batch in batches:
            for at, data in zip(batch.column("block").to_pylist(), batch.column("filter"), strict=True):
                part = QuotientFilter.unpack(data.as_buffer().to_pybytes())
                if at == block:
                    held = QuotientFilter.merged([held, part])
                else:
                    yield from done()
                    block, held = at, part
        yield from done()

    return run


def _candidates(id_type: str, marks):
    """Rows whose fingerprint is marked, with the bytes to be verified."""
    mask = np.uint64((1 << MARK_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks.value, dtype=np.uint8)
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column("text").to_pylist()
                plain = [normal(t or "") for t in texts]
                prints = np.array([xxhash.xxh3_64_intdigest(p) for p in plain], dtype=np.uint64)
                bits = (prints & mask).astype(np.int64)
                keep = np.flatnonzero((table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1)
                if len(keep):
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_id").take(pa.array(keep)),
                            pa.array(prints[keep].view(np.int64)),
                            pa.array([plain[i] for i in keep], pa.binary()),
                            pa.array([len(texts[i] or "") for i in keep], pa.int64()),
                        ],
                        names=["doc_id", "print", "plain", "points"],
                    )

    return run, f"doc_id {id_type}, print long, plain binary, points long"


def _marks(spark, prints: DataFrame):
    """A bit per value of the low fingerprint bits; a table of fixed size (1 MiB), whatever the input."""
    bit = F.col("print").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    rows = (
        prints.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.expr("bit & 32767")).alias("bits"))
        .collect()
    )
    table = np.zeros(1 << (MARK_BITS - 3), dtype=np.uint8)
    for row in rows:  # at most 2 ** (MARK_BITS - 15) rows of 4 KiB
        table[row.part << 12 : (row.part + 1) << 12] = np.frombuffer(bytes(row.bits), np.uint8)
    return spark.sparkContext.broadcast(table.tobytes())


def exact_dedup(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are once the six ASCII white-space characters are
    deleted; a null text counts as empty. Of equal texts the one with the most
    code points stays, then the smallest doc_id (null after all others). Rows
    that also share doc_id and length are repeats of one row: all carry kept =
    true, and ``keep_rows`` leaves one. Other columns are not read. Texts of any
    length are hashed whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    layout = Layout.of(docs.count(), block_rows)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    run, schema = _scan(id_type, layout)
    scanned = stage(source.mapInArrow(run, schema), "fingerprints")
    thin = scanned.where("block IS NULL").select("doc_id", "print", "sha", "points")
    merged = (
        scanned.where("block IS NOT NULL")
        .select("block", "filter")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_repeated(layout), "print long")
    )
    repeated = stage(merged, "repeated")
    run, schema = _candidates(id_type, _marks(spark, repeated))
    # Bytes are the key: a shared fingerprint alone joins nothing.
    verified = (
        source.mapInArrow(run, schema)
        .groupBy("print", "plain")
        .agg(
            F.count("*").alias("group_size"),
            F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id")).alias("best"),
        )
        .where("group_size > 1")
        .select(
            "print",
            F.sha2("plain", 256).alias("sha"),
            "group_size",
            F.col("best.doc_id").alias("keep_id"),
            (-F.col("best.p")).alias("keep_points"),
        )
    )
    verified = stage(verified, "verified")
    unstage(repeated)
    out = thin.join(verified, ["print", "sha"], "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))).alias(
            "kept"
        ),
        F.col("sha").alias("text_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(plain) AS text_sha256
FROM g
"""
