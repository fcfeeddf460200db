"""Exact nearest documents by cosine similarity (RET1, JN8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimwatch.operators.skew import top_per_key

#: Queries and documents of one block; a pair of blocks is one group.
QUERY_ROWS, DOC_ROWS = 4096, 32_768
#: Documents of a tile, and similarities computed at a time.
TILE_ROWS, CELLS = 1024, 4_000_000
_DIGITS = 9  # similarities equal to this many digits count as ties
_ONE = 10**_DIGITS
#: What rounding can add to a product of unit vectors, by far.
_SLACK = 1e-8


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0.0, 1.0, norms)


def _matrix(column) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in column]))


class Best:
    """The ``k`` best documents of each of some queries, so far.

    A document's key holds its rounded similarity and, below it, the place of
    its id from the end: larger keys are better, and no two are equal.
    """

    def __init__(self, queries: np.ndarray, k: int, cells: int = CELLS):
        self.queries, self.k, self.cells = queries, k, cells
        self.keys = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.sims = np.full((len(queries), k), -np.inf)
        self.largest = self.computed = 0

    def meet(self, docs: np.ndarray, places: np.ndarray) -> None:
        """Take in a tile of documents, but for the queries that none of them can serve."""
        centre = _unit(docs.mean(axis=0, keepdims=True))[0]
        near = float((docs @ centre).min())
        wanted = np.arange(len(self.queries))
        if near > 0:
            # Angles obey the triangle inequality: no document is nearer than angle(query, centre) - radius.
            angle = np.arccos(np.clip(self.queries @ centre, -1.0, 1.0)) - np.arccos(min(near, 1.0))
            most = np.cos(np.maximum(angle, 0.0)) + _SLACK
            wanted = np.flatnonzero(np.rint(most * _ONE) >= self.keys.min(axis=1) >> 32)
        step = max(1, self.cells // len(docs))
        for start in range(0, len(wanted), step):
            self._take(wanted[start : start + step], docs, places)

    def _take(self, rows: np.ndarray, docs: np.ndarray, places: np.ndarray) -> None:
        sims = self.queries[rows] @ docs.T
        self.largest, self.computed = max(self.largest, sims.size), self.computed + sims.size
        keys = (np.rint(sims * _ONE).astype(np.int64) << 32) - places
        better = np.flatnonzero(keys.max(axis=1) > self.keys[rows].min(axis=1))
        rows = rows[better]
        keys = np.concatenate((self.keys[rows], keys[better]), axis=1)
        sims = np.concatenate((self.sims[rows], sims[better]), axis=1)
        top = np.argpartition(keys, -self.k, axis=1)[:, -self.k :]
        self.keys[rows] = np.take_along_axis(keys, top, axis=1)
        self.sims[rows] = np.take_along_axis(sims, top, axis=1)

    def rows(self, query_ids: np.ndarray, doc_ids: np.ndarray) -> pd.DataFrame:
        """``doc_ids`` in the order of their places."""
        real = self.sims > -np.inf
        place = -self.keys[real] & 0xFFFFFFFF
        return pd.DataFrame(
            {
                "query_id": pd.Series(np.repeat(query_ids, real.sum(axis=1)), dtype=query_ids.dtype),
                "doc_id": pd.Series(doc_ids[place], dtype=doc_ids.dtype),
                "similarity": self.sims[real],
            }
        )


def search(
    queries: np.ndarray, docs: np.ndarray, places: np.ndarray, k: int, tile: int = TILE_ROWS, cells: int = CELLS
) -> Best:
    """The best documents of every query, tile by tile; rows of both sides have length one or zero.

    Documents near the same pivot share a tile, so that tiles are narrow and the
    bounds leave out much of the work; they never leave out a result.
    """
    best = Best(queries, k, cells)
    if not len(docs):
        return best
    pivots = docs[:: max(1, tile // 4)]
    step = max(1, cells // len(pivots))
    nearest = np.concatenate([np.argmax(docs[i : i + step] @ pivots.T, axis=1) for i in range(0, len(docs), step)])
    order = np.argsort(nearest, kind="stable")
    cuts = np.flatnonzero(np.diff(nearest[order], prepend=-1, append=-1))
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        for start in range(first, end, tile):
            rows = order[start : min(start + tile, end)]
            best.meet(docs[rows], places[rows])
    return best


def _schema(queries: DataFrame, corpus: DataFrame) -> str:
    kinds = dict(queries.dtypes), dict(corpus.dtypes)
    return f"query_id {kinds[0]['query_id']}, doc_id {kinds[1]['doc_id']}, similarity double"


def cosine_top_k(
    queries: DataFrame, corpus: DataFrame, k: int = 4,
    query_rows: int = QUERY_ROWS, doc_rows: int = DOC_ROWS, tile: int = TILE_ROWS, cells: int = CELLS,
) -> DataFrame:
    """RET1. The ``k`` nearest documents of every query, exact.

    ``queries`` has query_id and embedding, ``corpus`` doc_id and embedding. One
    plan for all sizes: both sides are dealt by hash into blocks of about
    ``query_rows`` and ``doc_rows`` rows, and each pair of blocks is one group,
    so a side is repeated once per block of the other. A group goes over its
    documents in tiles, no product has more than ``cells`` similarities, and
    only the best ``k`` per query and group become rows, which are reduced per
    task before the last shuffle. Adds ``rank`` from 1; ties fall to the smaller
    doc_id. Rows without an embedding take no part.
    """
    # Columns of their own on each side: both may come from one table.
    queries = queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").alias("q"))
    corpus = corpus.where("embedding IS NOT NULL").select("doc_id", F.col("embedding").alias("d"))
    q_blocks, d_blocks = _blocks(queries, query_rows), _blocks(corpus, doc_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = queries.select("*", block("query_id", q_blocks).alias("qb"), every(d_blocks).alias("db"))
    right = corpus.select("*", block("doc_id", d_blocks).alias("db"), every(q_blocks).alias("qb"))

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            none = pd.Series([], dtype=object)
            return pd.DataFrame({"query_id": none, "doc_id": none, "similarity": none.astype(float)})
        ids = d["doc_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        places = np.empty(len(ids), dtype=np.int64)
        places[by_id] = np.arange(1, len(ids) + 1)
        best = search(_matrix(q["q"]), _matrix(d["d"]), places, k, tile, cells)
        return best.rows(q["query_id"].to_numpy(), np.concatenate((ids[:1], ids[by_id])))

    found = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInPandas(meet, _schema(queries, corpus))
    order = [F.round("similarity", _DIGITS).desc(), F.col("doc_id")]
    return top_per_key(found, ["query_id"], order, k)


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def similarity(a: Column, b: Column) -> Column:
    """SC13. Cosine similarity of two array columns as a built-in expression."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda total, x: total + x,
    )
    norm = lambda v: F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )
    return dot / (norm(a) * norm(b))
