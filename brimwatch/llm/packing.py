"""Packing by powers of two (operator 10).

A document's ids are cut into full sequences of the largest length and then,
from long to short, into one piece per set bit of what is left. Each piece is a
sequence of its own, as long as its bucket: nothing is padded, no sequence
crosses documents, and a batch taken from one bucket has rows of equal length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import running, stage
from brimwatch.llm.tokens import BATCH_BYTES, encoded, public_path

#: Longest sequence; a power of two.
LONGEST = 4096
#: Id behind the last one of a document.
END = 2


def cuts(total: int, longest: int = LONGEST) -> list[int]:
    """Lengths of a document's pieces, long to short."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _layout(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of all pieces of documents with so many ids."""
    powers = longest >> np.arange(longest.bit_length())
    counts = np.empty((len(totals), len(powers)), dtype=np.int64)
    counts[:, 0] = totals // longest
    counts[:, 1:] = (totals[:, None] // powers[1:]) & 1
    owner = np.repeat(np.repeat(np.arange(len(totals)), len(powers)), counts.ravel())
    length = np.repeat(np.tile(powers, len(totals)), counts.ravel())
    ends = np.cumsum(length)
    return owner, ends - length - np.concatenate(([0], np.cumsum(totals)[:-1]))[owner], length


def pieces(
    docs: DataFrame, path: str | None = None, longest: int = LONGEST, end: int = END, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, and its ids as little-endian unsigned 32-bit.

    A null or empty text has the end id alone. Texts of any length are encoded
    whole; other columns are not read, and repeated rows are packed each.
    ``batch_bytes`` of text are encoded at a time: fewer need less memory.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or public_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids, offsets in encoded(batches, path, end, batch_bytes):
            totals = np.diff(offsets)
            owner, start, length = _layout(totals, longest)
            data = ids.astype("<u4").tobytes()
            at = np.concatenate(([0], np.cumsum(length))) * 4
            buffers = [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(pa.array(owner)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(totals[owner]),
                    pa.Array.from_buffers(pa.binary(), len(owner), buffers),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def sequences(parts: DataFrame) -> DataFrame:
    """Number the pieces as sequences, gapless from 0, bucket after bucket from long to short.

    ``parts`` must be narrow (no ids). Within a bucket the order is that of
    doc_id, start and ids_crc32; ``bucket_row`` is a sequence's place there.
    """
    fixed = stage(parts.withColumn("shortness", -F.col("length")), "pieces")
    placed = running(fixed, [], ["shortness", "doc_id", "start", "ids_crc32"], name="sequence_id")
    return placed.drop("shortness").withColumn("offset", F.lit(0).cast("long"))


def pack(
    docs: DataFrame, path: str | None = None, longest: int = LONGEST, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Pieces with sequence numbers and a checksum of their ids; see ``pieces`` for the ids themselves."""
    thin = pieces(docs, path, longest, batch_bytes=batch_bytes).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"
    )
    return sequences(thin).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
