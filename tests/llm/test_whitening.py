"""Whitening against a dense eigendecomposition of the exact covariance."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from brimwatch.llm import whitening


def dense(vectors):
    """Grid rows, distinct rows, and the covariance from exact sums."""
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    centred = [[n * r[j] - s[j] for j in range(d)] for r in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    return x, n, s, cov


def check(df, vectors, components):
    x, n, s, cov = dense(list(vectors.values()))
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    rows = whitening.whiten(df).collect()
    keys = list(vectors)
    assert len(rows) == len(keys) * components
    by = {(r.vec_id, r.component): r for r in rows}
    centred = {k: np.array([float(Fraction(n * v - t, n)) for v, t in zip(row, s, strict=True)]) for k, row in zip(keys, x, strict=True)}
    for k, row in zip(keys, x, strict=True):
        assert by[k, 1].deviation == sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)) and by[k, 1].n == n
    for c in range(1, components + 1):
        got = np.array([by[k, c].whitened for k in keys])
        want = np.array([centred[k] @ q[:, c - 1] for k in keys]) / np.sqrt(e[c - 1])
        sign = np.sign(got @ want)
        assert np.abs(got * sign - want).max() < 1e-6 * max(1, np.abs(want).max())
        assert by[keys[0], c].explained == pytest.approx(e[c - 1] / np.trace(cov), rel=1e-9)
    assert max(r.identity_error for r in rows) < 1e-9


def test_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet").limit(120)
    check(df, {r.vec_id: r.embedding for r in df.collect()}, 16)


def test_steep_spectrum_copies_and_odd_rows(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((150, 20)) * np.geomspace(300, 3, 20)
    vectors = {i: [float(c) for c in v] for i, v in enumerate(base)}
    vectors |= {1000 + i: vectors[0] for i in range(200)}
    good = [(k, v, 1) for k, v in vectors.items()]
    bad = [
        (1, None, 1), (2, [], 1), (3, [float("nan")] * 20, 1), (4, [1.0] * 19 + [None], 1), (5, [float("inf")] * 20, 1),
        (6, [1.0, 2.0], 1),
    ]
    df = spark.createDataFrame(good + [(k + 5000, v, x) for k, v, x in bad], "vec_id long, embedding array<double>, x int")
    check(df.selectExpr("*", "1 AS c", "2 AS rows", "3 AS n"), vectors, 16)


def test_equal_variances_are_all_found(spark):
    """A cross-polytope: one variance, eight times over, which one chain alone cannot see."""
    rows = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(8)]) for i in range(8) for s in (0, 1)]
    found, error = whitening.fit(whitening.grid(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), 4)
    assert error < 1e-10 and np.allclose(found.variances, found.variances[0]) and found.variances[0] > 0
    assert np.allclose(found.components.T @ found.components, np.eye(4), atol=1e-12)


def test_flat_directions_and_nothing(spark):
    rows = [(i, [float(i % 7), float(i % 3), 2.0]) for i in range(30)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).collect() == [] and whitening.whiten(same.where("false")).collect() == []


def test_large_deviation_is_null(spark):
    rows = [(1, [1e15]), (2, [-1e15]), (3, [1e300]), (4, [0.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 4 and all(r.deviation is None for r in out)


def test_many_tasks_are_added_up_in_between(spark, data, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT", 2)
    df = spark.read.parquet(f"{data}/embeddings.parquet").limit(60).repartition(6)
    check(df, {r.vec_id: r.embedding for r in df.collect()}, 16)
