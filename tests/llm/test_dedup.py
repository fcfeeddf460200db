"""Exact and near deduplication of texts against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from brimwatch.llm import exact_dedup, near_dup
from brimwatch.llm.common import shingles
from brimwatch.llm.components import components


def exact_brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for plain, members in groups.items():
        best = min(members)
        for points, _, _, i in members:
            kept = (points, i) == (best[0], best[3])
            out.append((i, best[3], len(members), kept, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def shingle_set(text, n=5):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    out = []
    for (doc, _), own, p in zip(rows, sets, part):
        ids = [rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None]
        out.append((doc, len(own), min(ids, default=None) if own else doc))
    return sorted(out, key=str)


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_messy(messy):
    got = [tuple(r) for r in exact_dedup.exact_dedup(messy, block_rows=4).collect()]
    assert sorted(got, key=str) == exact_brute(plain(messy))


def test_exact_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []


def test_filters_merge_without_loss():
    rng = np.random.default_rng(5)
    layout = exact_dedup.Layout(3, 6)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    parts = [rng.choice(prints, 400) for _ in range(5)]
    found = {}
    for block in range(8):
        filters = []
        for p in parts:
            b, q, r = layout.cut(p)
            own = b == block
            one = exact_dedup.QuotientFilter.build(q[own], r[own], np.ones(own.sum(), np.uint64), 64)
            filters.append(exact_dedup.QuotientFilter.unpack(one.pack()))
        q, r, c = exact_dedup.QuotientFilter.merged(filters).entries()
        found |= dict(zip(layout.join(block, q, r).tolist(), c.tolist()))
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert found == dict(zip(values.tolist(), counts.tolist()))


def test_shared_fingerprint_is_verified(spark, monkeypatch):
    """Texts whose fingerprints all agree are still told apart by their bytes."""
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (4, " c"), (5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    low = exact_dedup.Layout(0, 4)
    q, r, c = exact_dedup.QuotientFilter.build(
        np.zeros(5, np.int64), np.zeros(5, np.uint64), np.ones(5, np.uint64), 16
    ).entries()
    assert c.tolist() == [5] and low.join(0, q, r).tolist() == [0]
    got = sorted(tuple(x)[:4] for x in exact_dedup.exact_dedup(df).collect())
    assert got == [(1, 1, 2, True), (2, 1, 2, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True)]


def test_near_messy(messy):
    got = [tuple(r)[:3] for r in near_dup.near_duplicates(messy).collect()]
    assert sorted(got, key=str) == near_brute(plain(messy))


def test_near_empty(nothing):
    assert near_dup.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("unit,repeats", [(16, 2)])
def test_near_against_all_pairs(spark, unit, repeats):
    """A large group of near copies, chains, and a passage that most documents share."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        rows.append((i, " ".join(words[:20] + passage + words[20:])))
    for i in range(150, 240):  # similarity of about 0.7 to 0.95 with the base, less with each other
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    chain = list(base[::-1])
    for i in range(240, 270):
        chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
        rows.append((i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shape = near_dup.Trees(unit=unit, repeats=repeats)
    got = [tuple(r)[:3] for r in near_dup.near_duplicates(df, shape).collect()]
    assert sorted(got, key=str) == near_brute(rows)


def test_set_sizes_and_intersections():
    texts = ["a b c d e f", "A b c d e f g", "a b", None, "", "b c d e f g h i"]
    sets = shingles(texts)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    want = [[len(shingle_set(x) & shingle_set(y)) for y in texts] for x in texts]
    both = near_dup.intersections(sets)
    off = ~np.eye(len(texts), dtype=bool)
    assert (both[off] == np.array(want)[off]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (202, 200), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
