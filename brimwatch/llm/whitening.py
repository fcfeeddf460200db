"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation (operator 12).

Entries become integers, and each distinct integer vector is fitted once. Its
centred rows X are kept in blocks. Products with them run on all blocks at a
time, in turn: u = Xv, then v = Xᵀu, each made orthogonal to all before it. The
numbers left over form a small bidiagonal matrix; its singular vectors and
values are the components and their deviations.

The left vectors u are as long as the table and never stored: a task works out
its rows of them again from its rows of X (U = X W with a small W), so a lost
executor costs one task. Only sums of vectors of d numbers reach the driver, at
most a few hundred of them at a time.

Odd input: rows with a null vector or a null or non-finite entry are left out,
and so are vectors of another width than the most frequent one (of equally
frequent ones the wider). Repeated rows are whitened each. Vectors that do not
vary have no components, and a component with no more than ``flat`` of the
variance is left out, as whitening would divide by nothing; so fewer than
``components`` may come back. No usable row gives no rows. ``deviation`` is null
where it does not fit into a long. Entries beyond 2**61 steps count as 2**61.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import stage, unstage

#: Steps of the grid that entries are put on, and what is added.
STEPS, SHIFT = 64, 1_000_000
#: Steps beyond which entries count as this many, so that differences fit into a long.
MOST = 2.0**61
#: Rows of a block.
BLOCK = 4096
#: Sums of tasks that the driver adds up; more are first added up by tasks.
DIRECT = 512


@dataclass(frozen=True)
class Spectrum:
    """What the fit learned: S, n, components as columns, their variances, and the trace."""

    n: int
    total: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int

    @property
    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """The means S/n, as whole numbers and the n-ths above them."""
        whole = [s // self.n for s in self.total]
        return np.array(whole, np.int64), np.array([s - self.n * w for s, w in zip(self.total, whole, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, above = self.base
        return (x - whole) - above / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n*x - S)**2 as a whole number, if it fits into a long."""
        whole, above = self.base
        rough = np.square(self.n * self.centred(x)).sum(axis=1)
        small = rough < 2.0**62
        # Here no difference passes 2**31, and no sum of squares 2**62.
        exact = np.square(self.n * (x[small] - whole) - above).sum(axis=1).tolist()
        out: list[int | None] = [None] * len(x)
        for row, value in zip(np.flatnonzero(small).tolist(), exact, strict=True):
            out[row] = value
        for row in np.flatnonzero(~small & (rough < 2.0**64)).tolist():
            value = sum((self.n * v - s) ** 2 for v, s in zip(x[row].tolist(), self.total, strict=True))
            out[row] = value if value < 1 << 63 else None
        return out


def grid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Usable rows of the most frequent width, with their whole numbers as ``x``."""
    c = F.col(f"`{column}`").cast("array<double>")
    usable = F.coalesce(
        (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)
    )
    kept = vectors.where(usable).select("vec_id", c.alias("c"))
    widths = kept.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths.width if widths else 0
    return kept.where(F.size("c") == width).select(
        "vec_id", F.transform("c", lambda e: F.floor(F.least(F.greatest(e * STEPS, F.lit(-MOST)), F.lit(MOST))).cast("long") + SHIFT).alias("x")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _blocks(x: DataFrame) -> DataFrame:
    """Rows packed into blocks: (rows, x as little-endian longs row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"rows": [len(rows)], "x": [rows.astype("<i8").tobytes()]})

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                held.append(_matrix(batch.column("x").slice(start, BLOCK)))
                if sum(map(len, held)) >= BLOCK:
                    yield packed()
        if held:
            yield packed()

    return x.select("x").mapInArrow(run, "rows long, x binary")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, raw in zip(batch.column("rows").to_pylist(), batch.column("x"), strict=True):
            yield np.frombuffer(raw.as_buffer(), "<i8").reshape(rows, -1)


def _whole_sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in _each_block(batches):
            n += len(x)
            # Python's whole numbers: the sum of a table need not fit into 64 bits.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            part = [(h << 32) + b for h, b in zip(high, low, strict=True)]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [[str(t) for t in total]]})

    parts = blocks.mapInArrow(run, "n long, total array<string>")
    sums = parts.select("n", F.posexplode("total").alias("i", "t")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t")
    )
    rows = sorted(sums.collect())
    return (rows[0].n, [int(r.t) for r in rows]) if rows else (0, [])


def _sums(blocks: DataFrame, function: Callable[[np.ndarray], np.ndarray], tasks: int) -> np.ndarray:
    """The sum over all blocks of what ``function`` makes of each: a few hundred numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [function(x) for x in _each_block(batches)]
        if parts:
            yield pa.RecordBatch.from_pydict({"s": [np.sum(parts, axis=0)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_matrix(b.column("s")).sum(axis=0) for b in batches if b.num_rows]
        if rows:
            yield pa.RecordBatch.from_pydict({"s": [np.sum(rows, axis=0)]})

    parts = blocks.mapInArrow(run, "s array<double>")
    if tasks > DIRECT:
        parts = parts.repartition(DIRECT).mapInArrow(add, "s array<double>")
    return np.sum([r.s for r in parts.collect()], axis=0)


def bidiagonalise(
    blocks: DataFrame,
    n: int,
    total: list[int],
    components: int,
    tolerance: float = 1e-14,
) -> Spectrum:
    """Leading singular vectors of the centred rows, by alternating products with full reorthogonalisation.

    It stops when the wanted components do not move any more and the variance
    outside the space searched is below the smallest of them, so that nothing
    larger was missed (equal variances show in no single chain); else it goes
    on until the space is the whole one, which is at most d steps. A chain that
    ends early goes on with a fresh direction.
    """
    d = len(total)
    start = Spectrum(n, total, np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    centred = start.centred
    tasks = blocks.rdd.getNumPartitions()
    trace = float(_sums(blocks, lambda x: np.array([np.square(centred(x)).sum()]), tasks)[0])
    if n < 2 or not trace > 0:
        return start
    random = np.random.default_rng(12)

    def direction(known: np.ndarray) -> np.ndarray | None:
        v = random.standard_normal(d)
        for _ in range(3):
            v -= known @ (known.T @ v)
            v /= np.linalg.norm(v)
        return v

    right = np.zeros((d, 0))  # v
    weights = np.zeros((d, 0))  # U = X @ weights
    images = np.zeros((d, 0))  # Xᵀu
    upper = np.zeros((0, 0))  # UᵀXV, bidiagonal but for rounding
    v, tiny = direction(right), tolerance * np.sqrt(trace)

    while True:
        k = right.shape[1]
        # u = Xv less its part along earlier u; that part is known from Xᵀu, rounding is left to the second turn.
        along = images.T @ v
        weight = v - weights @ along
        for turn in range(3):

            def product(x: np.ndarray, w: np.ndarray = weight, known: np.ndarray = weights) -> np.ndarray:
                rows = centred(x)
                p = rows @ w
                return np.concatenate(([p @ p], (rows @ known).T @ p, rows.T @ p))

            sums = _sums(blocks, product, tasks)
            size, left, image = np.sqrt(sums[0]), sums[1 : 1 + k], sums[1 + k :]
            if turn == 2 or size <= tiny or np.abs(left).max(initial=0) <= 1e-13 * size:
                break
            weight = weight - weights @ left
            along = along + left
        alive = size > tiny
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = upper
        grown[:k, k] = along
        grown[k, k] = size if alive else 0.0
        upper, right = grown, np.column_stack((right, v))
        weights = np.column_stack((weights, weight / size if alive else np.zeros(d)))
        images = np.column_stack((images, image / size if alive else np.zeros(d)))
        if k + 1 == d:
            break
        # v = Xᵀu less its part along all v so far.
        v = images[:, -1] - right @ (right.T @ images[:, -1])
        v -= right @ (right.T @ v)
        beta = np.linalg.norm(v)
        outside = trace - np.square(upper).sum()
        if k + 1 >= min(components, d):
            left, deviations, _ = np.linalg.svd(upper)
            moves = beta * np.abs(left[-1, :components])
            smallest = deviations[: min(components, d)][-1]
            if moves.max() <= tolerance * deviations[0] and outside < smallest**2:
                break
        if outside <= trace * 1e-15 and beta <= tiny:
            break
        v = v / beta if beta > tiny else direction(right)
    _, deviations, turn = np.linalg.svd(upper)
    vectors = right @ turn.T
    return Spectrum(n, total, vectors, np.square(deviations) / n, trace / n, right.shape[1])


def fit(x: DataFrame, components: int = 16, flat: float = 1e-13) -> tuple[Spectrum, float]:
    """Components of the distinct vectors of ``x`` by falling variance, and how far whitening is from the identity.

    The largest entry of each component is positive. The second value is the
    largest absolute entry of the whitened fit list's covariance less the
    identity.
    """
    blocks = stage(_blocks(x.select("x").distinct()), "blocks")
    n, total = _whole_sums(blocks)
    if not n:
        unstage(blocks)
        return Spectrum(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0), 0.0
    found = bidiagonalise(blocks, n, total, components)
    keep = min(components, int((found.variances > flat * found.trace).sum()))
    vectors = found.components[:, :keep]
    if keep:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)])
    found = replace(found, components=vectors, variances=found.variances[:keep])
    if not keep:
        unstage(blocks)
        return found, 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    sums = _sums(blocks, moments, blocks.rdd.getNumPartitions()) / n
    unstage(blocks)
    spread = sums[keep:].reshape(keep, keep) - np.outer(sums[:keep], sums[:keep])
    return found, float(np.abs(spread - np.eye(keep)).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 16) -> DataFrame:
    """Each usable vector along each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = grid(vectors, column)
    found, error = fit(x, components)
    width = len(found.variances)
    explained = found.variances / found.trace if width else found.variances
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if width else 0, BLOCK):
                piece = batch.slice(start, BLOCK)
                rows = _matrix(piece.column("x"))
                owner = pa.array(np.repeat(np.arange(len(rows)), width))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("vec_id").take(owner),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(owner), found.n)),
                        pa.array(found.deviation(rows), pa.int64()).take(owner),
                        pa.array(found.whitened(rows).ravel()),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(len(owner), error)),
                    ],
                    names=names,
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(
        run,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double",
    )
