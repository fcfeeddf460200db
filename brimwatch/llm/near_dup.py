"""Near-duplicate documents by a chosen-path set similarity join (operator 1).

Every document has a signature of minwise tokens. A tree starts with all
documents; in each node a few coordinates of the signature are drawn at random,
and a document goes on to one child per coordinate, the one named by its token
there. Similar documents choose the same paths with a probability given by their
similarity, others part after a level or two. Small nodes are compared
exhaustively, larger ones branch again, and independent trees are added until the
chance that all miss a pair is negligible.

Pairs are compared inside a task, within a unit of bounded size; what leaves it
is at most one link fewer than it has documents. Documents known to be connected
are not compared again. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import (
    broadcast_if_small,
    by_key,
    groups,
    mix,
    seeds,
    shingles,
    signed,
    slices,
    stage,
    unstage,
)
from brimwatch.llm.components import components


@dataclass(frozen=True)
class Trees:
    """Shape of the join.

    With ``branches`` b and similarity s, a tree of any depth misses a pair with the
    probability q that solves q = (1 - s + s q) ** b: 1/9 for b = 2, s = 0.75. Six
    trees miss it with q ** 6, two in a million.
    """

    words: int = 5
    percent: int = 75
    coordinates: int = 64
    #: More coordinates, kept as one byte each, that only estimate the similarity of a pair.
    fine: int = 192
    trees: int = 6
    branches: int = 2
    #: Trees whose nodes are compared first, to connect most of a group early.
    early: int = 2
    #: Documents of a unit of comparison; larger units repeat a document in fewer of them.
    unit: int = 512
    #: A node is small if comparing all its pairs takes at most so many rows per document.
    repeats: int = 12
    depth: int = 24
    #: Part of the signature that must agree before sets are compared. At similarity 0.75, 64
    #: coordinates fall below one half with a chance of five in a million.
    agree: float = 0.5
    #: The same over all coordinates: of 256, at similarity 0.75, fewer than five in eight agree
    #: with a chance of four in a million.
    agree_all: float = 0.625


SIGNED = "doc_id {kind}, n_shingles long, v long, w long, sig binary, fine binary"


def _sign(shape: Trees):
    keys = seeds(shape.coordinates, 31)
    fine_keys = (seeds(shape.fine, 5231) >> np.uint64(32)).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingles(piece.column("text").to_pylist(), shape.words)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                sigs = np.zeros((len(sets), shape.coordinates), dtype=np.uint32)
                fine = np.zeros((len(sets), shape.fine), dtype=np.uint8)
                prints = np.zeros((2, len(sets)), dtype=np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for j, key in enumerate(keys):
                        hashed = ((flat ^ key) * (key | np.uint64(1))) >> np.uint64(32)
                        sigs[full, j] = np.minimum.reduceat(hashed, starts)
                    halves = flat.astype(np.uint32)
                    for j, key in enumerate(fine_keys):
                        fine[full, j] = np.minimum.reduceat((halves ^ key) * (key | np.uint32(1)), starts) & 0xFF
                    for row, key in enumerate(seeds(2, 977)):
                        total = np.add.reduceat(mix(flat ^ key), starts)
                        prints[row, full] = mix(total + sizes[full].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(sizes),
                        signed(prints[0]),
                        signed(prints[1]),
                        _binary(sigs.astype("<u4")),
                        _binary(fine),
                    ],
                    names=["doc_id", "n_shingles", "v", "w", "sig", "fine"],
                )

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column, width: int, kind: str = "<u4") -> np.ndarray:
    """Signatures of a table column, one row each."""
    chunks = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    parts = []
    for chunk in chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, int(at[0])))
    return np.concatenate(parts).reshape(-1, width) if parts else np.zeros((0, width), kind)


def _children(shape: Trees, early: list[int]):
    """Rows (v, sig, node) to rows (child, v, first), one per picked coordinate of the node."""
    salts = seeds(shape.branches, 4099)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = _matrix(batch.column("sig"), shape.coordinates).astype(np.uint64)
            nodes = np.array(batch.column("node").to_numpy()).view(np.uint64)
            rows = np.arange(len(nodes))
            first = pa.array(np.isin(nodes.view(np.int64), early))
            for i in range(shape.branches):
                drawn = mix(nodes + salts[i])
                at = (drawn >> np.uint64(33)).astype(np.int64) % shape.coordinates
                child = mix(mix(drawn ^ sigs[rows, at]) + at.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([signed(child), batch.column("v"), first], names=["node", "v", "first"])

    return run


def _split(rows: DataFrame, shape: Trees, early: list[int]) -> DataFrame:
    return rows.select("v", "sig", "node").mapInArrow(_children(shape, early), "node long, v long, first boolean")


def _needed(shape: Trees):
    """Of units (unit, v, comp, block, n_shingles, sig, fine): documents that may link to another component.

    In a unit of two blocks only pairs across them count; a block has a unit of its own.
    """
    least = int(shape.agree * shape.coordinates)
    least_all = int(shape.agree_all * (shape.coordinates + shape.fine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "unit"):
            unit, comp, block, size = (
                table.column(c).to_numpy() for c in ("unit", "comp", "block", "n_shingles")
            )
            sigs = _matrix(table.column("sig"), shape.coordinates)
            fine = _matrix(table.column("fine"), shape.fine, "u1")
            starts = np.flatnonzero(np.diff(unit, prepend=unit[0] ^ 1))
            keep = np.zeros(len(unit), dtype=bool)
            for a, b in zip(starts, [*starts[1:], len(unit)], strict=True):
                rows = a + np.argsort(block[a:b], kind="stable")
                cross = int(np.searchsorted(block[rows], block[rows[-1]]))
                s = sigs[rows]
                for i in range(cross or len(rows) - 1):
                    x, rest = rows[i], cross or i + 1
                    others = rows[rest:]
                    few, many = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
                    near = (comp[others] != comp[x]) & (100 * few >= shape.percent * many)
                    if not near.any():
                        continue
                    same = (s[rest:] == s[i]).sum(axis=1)
                    at = np.flatnonzero(near & (same >= least))
                    at = at[same[at] + (fine[others[at]] == fine[x]).sum(axis=1) >= least_all]
                    if len(at):
                        keep[x] = True
                        keep[others[at]] = True
            if keep.any():
                yield from table.select(["unit", "v", "comp"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _confirmed(shape: Trees):
    """Of units (unit, v, comp, text): links that connect what is similar, by full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "unit", "text"):
            unit = table.column("unit").to_numpy()
            v, comp = table.column("v").to_numpy(), table.column("comp").to_numpy()
            starts = np.flatnonzero(np.diff(unit, prepend=unit[0] ^ 1))
            a_out, b_out = [], []
            for a, b in zip(starts, [*starts[1:], len(unit)], strict=True):
                sets = shingles(table.column("text").slice(a, b - a).to_pylist(), shape.words)
                for i, j in _links(sets, comp[a:b].tolist(), shape.percent):
                    a_out.append(v[a + i])
                    b_out.append(v[a + j])
            if a_out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"]
                )

    return run


#: Shared shingles that are counted at a time.
STRIP = 8192


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1  # the others are in one set only
    owner, code = owner[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, STRIP):
        lo, hi = np.searchsorted(code, (at, at + STRIP))
        held = np.zeros((len(sets), STRIP), dtype=np.float32)  # counts below 2 ** 24 are exact
        held[owner[lo:hi], code[lo:hi] - at] = 1
        both += held @ held.T
    return both


def _links(sets: list[np.ndarray], comp: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """A forest that connects similar sets; pairs already connected are skipped."""
    parent = {c: c for c in comp}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = intersections(sets)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    for i, j in zip(*np.nonzero(np.tril(near, -1) & (size > 0)[:, None]), strict=True):
        x, y = root(comp[i]), root(comp[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield int(i), int(j)


def _members() -> Column:
    """Adds up to the same for the same documents."""
    return F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("s")


class _Join:
    """One run: signatures, texts, and the components of the links confirmed so far."""

    def __init__(self, reps: DataFrame, docs: DataFrame, shape: Trees):
        self.reps, self.docs, self.shape = reps, docs, shape
        self.comps: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Add ``comp``: the component found so far, or the document itself."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("v"))
        known = broadcast_if_small(self.comps.select(F.col("node").alias("v"), F.col("root").alias("comp")))
        return rows.join(known, "v", "left").withColumn("comp", F.coalesce("comp", "v"))

    def compare(self, units: DataFrame) -> None:
        """Find links inside units (unit, v, comp, block) and bring the components up to date."""
        shape = self.shape
        small = "unit long, v long, comp long"
        signed_units = units.join(self.reps.select("v", "n_shingles", "sig", "fine"), "v").select(
            "unit", "v", "comp", "block", "n_shingles", "sig", "fine"
        )
        needed = stage(by_key(signed_units, "unit", _needed(shape), small), "needed")
        if not needed.limit(1).count():
            return
        ids = stage(needed.select("v").distinct().join(self.reps.select("v", "doc_id", "n_shingles"), "v"), "wanted")
        # doc_id may repeat with other texts: the set size, and then the print of the set, tell them apart.
        texts = (
            self.docs.join(broadcast_if_small(ids.select(F.col("doc_id").alias("rep_id")).distinct()),
                           F.col("doc_id").eqNullSafe(F.col("rep_id")))
            .select("doc_id", "text")
        )
        texts = texts.mapInArrow(_printed(shape), "v long, text string").dropDuplicates(["v"])
        full = needed.join(texts, "v").select("unit", "v", "comp", "text")
        found = by_key(full, "unit", _confirmed(shape), "a long, b long")
        links = stage(found, "confirmed")
        if self.comps is None or links.limit(1).count():
            known = self.comps
            if known is not None:
                links = links.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
            self.comps = stage(components(links), "comps")
            unstage(known)
        unstage(needed, ids)

    def early(self, rows: DataFrame) -> None:
        """Cut nodes of any size into units that share their first document, and compare within each."""
        found = rows.groupBy("node").agg(F.count("*").alias("n"), _members(), F.min("v").alias("pivot")).where("n > 1")
        once = found.groupBy("n", "s", "pivot").agg(F.min("node").alias("node"))
        parts = F.ceil(F.col("n") * 2 / self.shape.unit)
        part = F.when(F.col("n") <= self.shape.unit, 0).otherwise(F.pmod(F.xxhash64("v", "node"), parts))
        cut = rows.join(once, "node").withColumn("unit", F.xxhash64("node", part.cast("long")))
        cut = stage(cut.select("unit", "v", "n", "pivot"), "units")
        pivots = cut.where(f"n > {self.shape.unit}").select("unit", F.col("pivot").alias("v"))
        units = cut.select("unit", "v").unionByName(pivots).distinct()
        self.compare(self.labelled(units).withColumn("block", F.lit(0).cast("long")))

    def finish(self, rows: DataFrame, exhaustive: bool) -> DataFrame | None:
        """Compare the small nodes that hold several components; the rows of the others."""
        shape = self.shape
        rows = self.labelled(rows)
        parts = rows.groupBy("node", "comp").agg(F.count("*").alias("m"), _members())
        main = parts.groupBy("node").agg(
            F.sum("m").alias("n"),
            F.count("*").alias("k"),
            F.sum("s").alias("s"),
            F.max(F.struct("m", "comp")).alias("top"),
        )
        # Of nodes with the same documents one is enough.
        main = main.where("k > 1").groupBy("n", "s", "top").agg(F.min("node").alias("node"))
        mixed = main.select("node", "n", F.col("top.m").alias("m"), F.col("top.comp").alias("top"))
        half = F.lit(shape.unit // 2)
        u, a = F.ceil((F.col("n") - F.col("m")) / half), F.ceil(F.col("m") / half)
        cost = (F.col("n") - F.col("m")) * (u + a) + F.col("m") * u
        mixed = mixed.select(
            "node", "top", u.cast("long").alias("u"), a.cast("long").alias("a"),
            (F.lit(exhaustive) | (F.col("n") <= shape.unit) | (cost <= shape.repeats * F.col("n"))).alias("small"),
        )
        rows = stage(rows.join(mixed, "node"), "mixed")
        # Every pair of blocks, save two blocks of the main component, is a unit.
        inner = F.col("comp") == F.col("top")
        block = F.when(inner, F.col("u") + F.pmod(F.xxhash64("v"), F.col("a"))).otherwise(
            F.pmod(F.xxhash64("v"), F.col("u"))
        )
        small = rows.where("small").withColumn("block", block)
        other = F.when(
            inner, F.sequence(F.lit(0).cast("long"), F.col("u") - 1)
        ).otherwise(F.sequence(F.lit(0).cast("long"), F.col("u") + F.col("a") - 1))
        paired = small.select("node", "v", "comp", "block", F.explode(other).alias("other"))
        units = paired.select(
            F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "v", "comp", "block"
        )
        self.compare(units)
        rest = rows.where("NOT small").select("node", "v")
        return rest if rest.limit(1).count() else None


def _printed(shape: Trees):
    """Rows (doc_id, text) to (v, text): the print of the shingle set names the vertex."""
    sign = _sign(Trees(words=shape.words, coordinates=1, fine=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                if piece.num_rows:
                    (out,) = sign([piece])
                    yield pa.RecordBatch.from_arrays([out.column("v"), piece.column("text")], names=["v", "text"])

    return run


def near_duplicates(docs: DataFrame, shape: Trees = Trees()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but the six ASCII white-space characters, with A-Z
    lower-cased; a document's set has its distinct five-word shingles, or the whole
    sequence if it has fewer words. Documents with 100 * intersection >= 75 * union
    are linked. Null, empty and white texts have no set and are linked with nothing.
    component_id is the smallest doc_id reachable (nulls only if all are null); rows
    that repeat a doc_id share its component only through their texts. Equal sets
    (128-bit print and size) are one vertex. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    signed_docs = stage(docs.mapInArrow(_sign(shape), SIGNED.format(kind=kind)), "signed")
    reps = stage(
        signed_docs.where("n_shingles > 0")
        .groupBy("v", "w", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("fine").alias("fine")),
        "sets",
    )
    join = _Join(reps, docs, shape)
    roots = seeds(shape.trees, 65537).view(np.int64).tolist()
    tree = F.explode(F.array(*(F.lit(r) for r in roots))).alias("node")
    level = stage(_split(reps.select("v", "sig", tree), shape, roots[: shape.early]), "level")
    join.early(level.where("first").select("node", "v"))
    rest, depth = level.select("node", "v"), 1
    while rest is not None:
        rest = join.finish(rest, exhaustive=depth > shape.depth)
        depth += 1
        if rest is not None:
            rest = stage(_split(rest.join(reps.select("v", "sig"), "v"), shape, []), "level").select("node", "v")
    if join.comps is None:
        join.comps = components(reps.select(F.col("v").alias("a"), F.col("v").alias("b")).where("false"))
    vertex = signed_docs.join(
        join.comps.select(F.col("node").alias("v"), "root"), "v", "left"
    ).withColumn("root", F.coalesce("root", "v"))
    smallest = stage(
        vertex.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "smallest"
    )
    alone = F.col("n_shingles") == 0
    out = vertex.join(smallest, "root", "left").withColumn(
        "component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least"))
    )
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
