"""Near-duplicate vectors by a forest of random-projection trees (operator 7).

A tree splits its vectors at the middle of their projections on a random
direction; those close to the middle go to both sides. Splitting goes on until a
leaf is small, or until so many pairs of a node are links that splitting only
parts what belongs together. Vectors are compared within leaves, in double
precision. A pair that meets in several leaves counts in the first of them, so
counts need no list of pairs, and each unit gives out a row per vector at most.

How many trees it takes depends on the data: the closer all vectors are, and the
more levels, the more pairs a tree parts. So partners at exactly the threshold
are made for some vectors and routed along, and real links of the same vectors
are found by brute force; trees are added until enough of both pairs meet.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from brimwatch.llm.common import by_key, groups, mix, seeds, signed, stage, unstage
from brimwatch.llm.components import components


LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Forest:
    """Shape of the forest. Splits are learned from about ``sample`` vectors of each node, the only
    bound; every vector is routed and every leaf compared whole."""

    cosine: float = 0.95
    #: Trees to begin with.
    trees: int = 6
    #: Part of the probe pairs that must meet; trees are added until they do, or there are ``most``.
    recall: float = 0.95
    #: About as many vectors are paired with a made partner, and compared with all vectors.
    probes: int = 2048
    #: Real links count from so many on; a few say nothing about the rest.
    enough: int = 100
    most: int = 96
    #: Part of a node, on each side of the middle, that goes to both children.
    spill: float = 0.05
    leaf: int = 2048
    #: Vectors of a block; larger leaves are compared block by block.
    block: int = 1024
    sample: int = 8192
    levels: int = 8
    #: A node in which this part of the pairs are links is not split.
    tight: float = 0.25
    rounds: int = 12


def _vectors(column: pa.Array, kind: np.dtype) -> list[np.ndarray]:
    """Each row's bytes as numbers."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _units(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge vectors in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(node: int, k: int, width: int) -> np.ndarray:
    seed = mix(np.array([node], np.int64).view(np.uint64) + seeds(1, k + 1))[0]
    return np.random.Generator(np.random.PCG64(int(seed))).standard_normal(width)


def _tables(batches, key: str) -> Iterator[tuple[int, pa.Table]]:
    for table in groups(batches, key):
        keys = table.column(key).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            yield int(keys[a]), table.slice(a, b - a)


def _grown(shape: Forest, kind: np.dtype):
    """From a node's sample (node, n, vec): the bounds of its splits in heap order; nan ends a branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, table in _tables(batches, "node"):
            x = _units([v for c in table.column("vec").chunks for v in _vectors(c, kind)])
            rate = table.column("n")[0].as_py() / len(x)
            size = (1 << shape.levels) - 1
            low, high = np.full(size, np.nan), np.full(size, np.nan)
            tight = np.zeros(2 * size + 1, dtype=bool)
            work = [(0, np.arange(len(x)))]
            while work:
                k, rows = work.pop()
                some = x[rows[:512]]
                near = (some @ some.T >= shape.cosine).mean() if len(rows) > 1 else 0.0
                tight[k] = near >= shape.tight
                if k >= size or tight[k] or len(rows) < 8 or len(rows) * rate <= shape.leaf:
                    continue
                along = x[rows] @ _direction(node, k, x.shape[1])
                low[k], high[k] = np.quantile(along, (0.5 - shape.spill, 0.5 + shape.spill))
                if not low[k] < high[k]:  # no spread: nothing to split by
                    low[k] = high[k] = np.nan
                    tight[k] = True
                    continue
                work.append((2 * k + 1, rows[along <= high[k]]))
                work.append((2 * k + 2, rows[along >= low[k]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node], pa.int64()),
                    pa.array([np.concatenate((low, high)).astype("<f8").tobytes()], pa.binary()),
                    pa.array([np.packbits(tight).tobytes()], pa.binary()),
                ],
                names=["node", "bounds", "tight"],
            )

    return run


def _routed(shape: Forest, kind: np.dtype):
    """Rows (node, v, vec, bounds, tight) of whole nodes or parts of them to (node, v, tight) of the children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << shape.levels) - 1
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            if not len(nodes):
                continue
            order = np.argsort(nodes, kind="stable")
            cuts = np.flatnonzero(np.diff(nodes[order])) + 1
            for rows in np.split(order, cuts):
                node = int(nodes[rows[0]])
                first = int(rows[0])
                bounds = np.frombuffer(batch.column("bounds")[first].as_buffer(), "<f8")
                flags = np.unpackbits(np.frombuffer(batch.column("tight")[first].as_buffer(), np.uint8))
                x = _units(_vectors(batch.column("vec").take(pa.array(rows)), kind))
                v = batch.column("v").to_numpy()[rows]
                work = [(0, np.arange(len(rows)))]
                out_v, out_node, out_tight = [], [], []
                while work:
                    k, held = work.pop()
                    if not len(held):
                        continue
                    if k >= size or np.isnan(bounds[k]):
                        child = mix(np.array([node], np.int64).view(np.uint64) ^ mix(np.array([k + 1], np.uint64)))
                        out_v.append(v[held])
                        out_node.append(np.full(len(held), child[0]))
                        out_tight.append(np.full(len(held), bool(flags[k])))
                        continue
                    along = x[held] @ _direction(node, k, x.shape[1])
                    work.append((2 * k + 1, held[along <= bounds[size + k]]))
                    work.append((2 * k + 2, held[along >= bounds[k]]))
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(out_node)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_tight))],
                    names=["node", "v", "tight"],
                )

    return run


def _partners(shape: Forest, kind: np.dtype):
    """For rows (v, vec), a vector at the threshold's cosine in a random direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for v, raw in zip(batch.column("v").to_pylist(), _vectors(batch.column("vec"), kind), strict=True):
                x = _units([raw])[0]
                side = _direction(v, -1, len(x))
                side -= (side @ x) * x
                length = np.linalg.norm(side)
                y = shape.cosine * x + math.sqrt(1 - shape.cosine**2) * side / length if length > 1e-9 else x
                out.append(y.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(out, pa.binary())], names=["v", "vec"])

    return run


def _linked(shape: Forest, kind: np.dtype, sample: dict[int, tuple[np.ndarray, np.ndarray]]):
    """For rows (v, vec), at most one link (a, b) of each to the sample (ids and unit vectors by width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                v, rows = piece.column("v").to_numpy(), _vectors(piece.column("vec"), kind)
                width = np.array([r.nbytes for r in rows])
                for w in np.intersect1d(width, list(sample)):
                    at = np.flatnonzero(width == w)
                    ids, x = sample[int(w)]
                    near = _units([rows[i] for i in at]) @ x.T >= shape.cosine
                    near &= v[at][:, None] != ids
                    some = np.flatnonzero(near.any(axis=1))
                    if not len(some):
                        continue
                    own = v[at][some]
                    draw = mix(own.view(np.uint64)[:, None] ^ mix(ids.view(np.uint64))[None, :]) | np.uint64(1)
                    one = np.where(near[some], draw, np.uint64(0)).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[one])], names=["a", "b"])

    return run


def _met(leaves: DataFrame, pairs: DataFrame) -> dict[str, int]:
    """Of probe pairs (kind, a, b), how many of each kind share a leaf."""
    first = leaves.join(F.broadcast(pairs), F.col("v") == F.col("a")).select("kind", "a", "b", "node")
    ends = F.broadcast(pairs.select(F.col("b").alias("end")).distinct())
    second = leaves.join(ends, F.col("v") == F.col("end")).select(F.col("end").alias("b"), "node")
    met = first.join(second, ["b", "node"]).select("kind", "a", "b").distinct()
    return {r["kind"]: r["count"] for r in met.groupBy("kind").count().collect()}


def _labels(near: np.ndarray) -> np.ndarray:
    """Smallest row connected to each row."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        after = np.minimum(label, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _compared(shape: Forest, kind: np.dtype):
    """Of units (unit, leaf, block, v, weight, leaves, vec, cross): links of each vector, and a forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _tables(batches, "unit"):
            v = table.column("v").to_numpy()
            if len(v) < 2:
                continue
            table = table.combine_chunks()
            x = _units([r for c in table.column("vec").chunks for r in _vectors(c, kind)])
            near = x @ x.T >= shape.cosine
            np.fill_diagonal(near, False)
            if table.column("cross")[0].as_py():
                block = table.column("block").to_numpy()
                near &= block[:, None] != block[None, :]
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            near = near[np.ix_(some, some)]
            # A pair counts where its first common leaf is.
            leaf = table.column("leaf")[0].as_py()
            lists = table.column("leaves").combine_chunks().take(pa.array(some))
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(some)), np.diff(lists.offsets.to_numpy()))
            early = flat < leaf
            names, code = np.unique(flat[early], return_inverse=True)
            # In strips, so that the table of leaves stays small however many there are.
            for at in range(0, len(names), 1024):
                inside = (code >= at) & (code < at + 1024)
                held = np.zeros((len(some), 1024), dtype=np.float32)
                held[owner[early][inside], code[inside] - at] = 1
                near &= held @ held.T == 0
            weight = table.column("weight").to_numpy()[some].astype(np.int64)
            links = near.astype(np.float64) @ weight
            real = np.flatnonzero(links > 0)
            if len(real):
                to = _labels(near)[real]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(v[some][real]),
                        pa.array(links[real].astype(np.int64)),
                        pa.array(v[some][to]),
                    ],
                    names=["v", "links", "other"],
                )

    return run


def _grown_leaves(points: DataFrame, shape: Forest, kind: np.dtype, first: int, last: int) -> DataFrame:
    """Leaves (node, v, n) of the trees ``first`` to ``last`` over ``points`` (v, vec)."""
    # Round by round: learn the splits of nodes that are too large, route, look at the children.
    root = F.xxhash64(F.lit(7), F.col("tree"), F.octet_length("vec"))
    rows_now = points.select("v", "vec", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("tree"))
    rows_now = rows_now.select(root.alias("node"), "v", "vec")
    sizes = stage(rows_now.groupBy("node").agg(F.count("*").alias("n")), "sizes")
    leaves: DataFrame | None = None
    held: list[DataFrame] = []
    for number_ in range(shape.rounds + 1):
        draw = F.pmod(F.xxhash64("v", "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        part = rows_now.join(sizes, "node").where(draw < F.lit(float(shape.sample)) / F.col("n"))
        grown = stage(
            by_key(part.select("node", "n", "vec"), "node", _grown(shape, kind), "node long, bounds binary, tight binary"),
            "splits",
        )
        routed = rows_now.join(grown, "node").mapInArrow(_routed(shape, kind), "node long, v long, tight boolean")
        routed = stage(routed, "routed")
        held.append(routed)
        unstage(grown, sizes)
        sizes = stage(
            routed.groupBy("node").agg(F.count("*").alias("n"), F.max("tight").alias("tight")), "sizes"
        )
        final = F.col("tight") | (F.col("n") <= 2 * shape.leaf) | F.lit(number_ == shape.rounds)
        done = routed.select("node", "v").join(sizes.where(final).select("node", "n"), "node")
        leaves = done if leaves is None else leaves.unionByName(done)
        sizes = sizes.where(~final).select("node", "n")
        if not sizes.limit(1).count():
            break
        rows_now = routed.select("node", "v").join(sizes.select("node"), "node").join(points, "v")
    leaves = stage(leaves, "leaves")
    unstage(*held)
    return leaves


def near_vectors(vectors: DataFrame, shape: Forest = Forest()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id and embedding (an array of numbers). Links are pairs
    found with cosine >= 0.95 in double precision, never below it; measured against
    brute force the forest finds over nine in ten: trees are added until 95 % of
    made pairs at cosine 0.95, and of links to a sample, meet. Null and empty vectors, zero
    ones, and those with a null or non-finite component are linked with nothing.
    Vectors of different lengths are not compared. component_id is the smallest
    vec_id reachable over links. Bitwise equal vectors are one vertex with a
    weight. Labels and other columns are not read.
    """
    element = vectors.schema["embedding"].dataType
    narrow = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    kind = np.dtype("<f4" if narrow else "<f8")
    number = "float" if narrow else "double"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{number}>").alias("e"))
    limit = F.lit(float("inf")).cast(number)
    good = (
        F.col("e").isNotNull()
        & F.coalesce(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit)), F.lit(False))
        & F.coalesce(F.exists("e", lambda c: c != 0), F.lit(False))
    )
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            vecs = [np.asarray(x.values, kind).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(vecs, pa.binary())], names=["vec_id", "vec"]
            )

    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    numbers = rows.where("good").select("vec_id", "e").mapInArrow(packed, f"vec_id {id_kind}, vec binary")
    base = stage(
        numbers.groupBy("vec")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
        .select(F.xxhash64("vec").alias("v"), "vec", "weight", "least"),
        "vectors",
    )
    grove, trees = [], 0
    more = shape.trees
    # Partners are routed with the vectors; only vectors of ``base`` are compared.
    large = base.groupBy(F.octet_length("vec").alias("width")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * shape.leaf)
    rate = F.lit(float(shape.probes)) / F.col("n")
    draw = F.pmod(F.xxhash64("v", F.lit("probe")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = base.join(F.broadcast(large), F.octet_length("vec") == F.col("width")).where(draw < rate).select("v", "vec")
    chosen = stage(chosen, "chosen")
    made = chosen.mapInArrow(_partners(shape, kind), "v long, vec binary")
    made = stage(made.withColumn("partner", F.xxhash64("v", "vec", F.lit("partner"))), "partners")
    points = base.select("v", "vec").unionByName(made.select(F.col("partner").alias("v"), "vec"))
    pairs = made.select(F.lit("made").alias("kind"), F.col("v").alias("a"), F.col("partner").alias("b"))
    by_width: dict[int, list] = {}
    for r in chosen.collect():  # about ``probes`` rows of a width
        by_width.setdefault(len(r.vec), []).append((r.v, np.frombuffer(r.vec, kind)))
    if by_width:
        sample = {w: (np.array([v for v, _ in x], np.int64), _units([y for _, y in x])) for w, x in by_width.items()}
        links = stage(base.select("v", "vec").mapInArrow(_linked(shape, kind, sample), "a long, b long"), "real")
        draw = F.pmod(F.xxhash64("a", F.lit("real")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        links = links.where(draw < F.lit(2.0 * shape.probes / max(1, links.count())))
        pairs = stage(pairs.unionByName(links.select(F.lit("real").alias("kind"), "a", "b")), "probes")
        asked = {r["kind"]: r["count"] for r in pairs.groupBy("kind").count().collect()}
        asked = {k: n for k, n in asked.items() if k == "made" or n >= shape.enough}
    else:
        asked = {}  # each tree is one leaf
    while True:
        grove.append(_grown_leaves(points, shape, kind, trees + 1, trees + more))
        trees += more
        leaves = grove[0]
        for other in grove[1:]:
            leaves = leaves.unionByName(other)
        met = _met(leaves, pairs) if asked else {}
        parts = {k: met.get(k, 0) / n for k, n in asked.items()}
        least = min(parts.values(), default=1.0)
        if asked:
            LOG.info("%d trees: parts of the pairs that share a leaf: %s of %s", trees, parts, asked)
        if least >= shape.recall:
            break
        if trees >= shape.most:
            LOG.warning("with %d trees only %s of the pairs share a leaf", trees, parts)
            break
        needed = math.ceil(trees * math.log(1 - shape.recall) / math.log(1 - least)) if least > 0 else shape.most
        more = max(1, min(needed - trees, trees, shape.most - trees))  # an estimate: at most twice as many at once
    lists = leaves.groupBy("v").agg(F.collect_list("node").alias("leaves"))  # a few per tree
    full = leaves.join(base.select("v", "vec", "weight"), "v").join(lists, "v")
    blocks = F.ceil(F.col("n") / F.lit(shape.block)).cast("long")
    blocks = F.when(F.col("n") <= 2 * shape.leaf, F.lit(1).cast("long")).otherwise(blocks)
    full = full.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = full.select("*", other.alias("other")).select(
        F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        F.col("node").alias("leaf"),
        "block",
        "v",
        "weight",
        "leaves",
        "vec",
    )
    # The unit of a block with itself compares inside it, any other across.
    units = units.withColumn("cross", F.col("unit") != F.xxhash64("leaf", "block", "block"))
    found = stage(by_key(units, "unit", _compared(shape, kind), "v long, links long, other long"), "links")
    roots = stage(components(found.select(F.col("v").alias("a"), F.col("other").alias("b"))), "roots")
    counts = found.groupBy("v").agg(F.sum("links").alias("links"))
    vertex = (
        base.select("v", "weight", "least")
        .join(counts, "v", "left")
        .join(roots.select(F.col("node").alias("v"), "root"), "v", "left")
        .withColumn("root", F.coalesce("root", "v"))
    )
    smallest = vertex.groupBy("root").agg(F.min("least").alias("component"))
    vertex = stage(vertex.join(smallest, "root").select("v", "weight", "links", "component"), "vertices")
    ids = numbers.select("vec_id", F.xxhash64("vec").alias("v")).join(vertex, "v")
    linked = ids.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
    )
    alone = rows.where("NOT good").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        "vec_id",
        "n_links",
        F.col("component_id").cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
