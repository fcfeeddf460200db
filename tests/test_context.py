from __future__ import annotations

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwatch.operators import context, retrieve
from brimwatch.plans import triage

NOW = datetime(2026, 5, 1)

ANSWERS = {
    "plain": ('{"recommendation": "clean", "self_confidence": 0.8, "rationale": "r", "key_evidence": ["a", "b"]}', ("clean", 0.8, "r", ["a", "b"])),
    "wrapped": ('Sure:\n```json\n{"recommendation":"escalate_anomaly","self_confidence":0.9}\n``` ok', ("escalate_anomaly", 0.9, "", [])),
    "nested": ('{"recommendation":"clean","self_confidence":0.5,"extra":{"a":{"b":1}}}', ("clean", 0.5, "", [])),
    "no confidence": ('{"recommendation":"clean"}', ("clean", 0.5, "", [])),
    "null confidence": ('{"recommendation":"clean","self_confidence":null}', None),
    "word confidence": ('{"recommendation":"clean","self_confidence":"high"}', None),
    "text number": ('{"recommendation":"clean","self_confidence":" 0.25 "}', ("clean", 0.25, "", [])),
    "unknown": ('{"recommendation":"reboot","self_confidence":0.7}', ("no_action", 0.7, "", [])),
    "missing": ('{"self_confidence":0.7,"key_evidence":null}', ("no_action", 0.7, "", [])),
    "above": ('{"recommendation":"clean","self_confidence":7}', ("clean", 1.0, "", [])),
    "below": ('{"recommendation":"clean","self_confidence":-1}', ("clean", 0.0, "", [])),
    "open": ('{"recommendation":"clean"', None),
    "two": ('{"recommendation":"clean"} {"a":1}', None),
    "list of two": ('{"recommendation":"clean"},{"a":1}', None),
    "junk inside": ('{"recommendation":"clean"} junk }', None),
    "reversed": ("} nothing {", None),
    "none": ("no answer", None),
    "empty": ("", None),
}


def test_answers(spark):
    df = spark.createDataFrame([(k, raw) for k, (raw, _) in ANSWERS.items()], "k string, raw string")
    got = {r.k: r for r in context.parse_answers(df).collect()}
    for name, (_, want) in ANSWERS.items():
        row = got[name]
        if want is None:
            assert (row.recommendation, row.self_confidence, row.key_evidence, row.parsed) == ("no_action", 0.0, [], False), name
        else:
            assert (row.recommendation, row.self_confidence, row.reasoning, row.key_evidence) == want, name
            assert row.parsed


def test_file_listing(spark):
    files = [("h", f"/var/log/f{i:02d}.log", 1000 - i, NOW - timedelta(hours=6 * i)) for i in range(60)]
    files += [("h", "/var/log/_seed_baseline.bin", 10**9, NOW), ("g", "/x/a.log.1", 5, NOW + timedelta(days=1))]
    df = spark.createDataFrame(files, "host_id string, path string, size_bytes long, mtime timestamp")
    got = {r.host_id: r for r in context.file_listing(context.largest_files(df, NOW)).collect()}
    lines = got["h"].file_listing.split("\n")
    assert lines[0] == "size_bytes\tage_days\tis_active\tpath"
    assert lines[1] == "1000\t0.0\tyes\t/var/log/f00.log"
    assert lines[5] == "996\t1.0\tno\t/var/log/f04.log"
    assert len(lines) == 32 and lines[-1] == "... and 20 more (truncated)" and got["h"].n_files == 50
    assert got["g"].file_listing.split("\n")[1:] == ["5\t0.0\tno\t/x/a.log.1"]


def brute_top(queries, docs, k):
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1.0)
    out = {}
    for q, v in queries:
        sims = sorted(((-round(float(unit(v) @ unit(w)), 9), d) for d, w in docs))[:k]
        out[q] = [(d, -s) for s, d in sims]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    docs = [(f"d{i:03d}", rng.normal(size=8).tolist()) for i in range(150)]
    docs += [("d900", docs[3][1]), ("d901", docs[3][1]), ("d902", [0.0] * 8)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(40)] + [(99, docs[3][1])]
    return queries, docs


@pytest.mark.parametrize(("query_rows", "doc_rows", "tile", "cells"), [(4096, 32768, 1024, 10**6), (11, 20, 5, 50), (7, 999, 3, 1)])
@pytest.mark.parametrize("turned", [False, True])
def test_top_k_at_all_sizes(spark, vectors, turned, query_rows, doc_rows, tile, cells):
    queries, docs = vectors
    if turned:
        queries, docs = [(i, v) for i, (_, v) in enumerate(docs)], [(f"d{q:02d}", v) for q, v in queries]
    q = spark.createDataFrame(queries + [(-1, None)], "query_id long, embedding array<double>").repartition(3)
    d = spark.createDataFrame(docs + [("void", None)], "doc_id string, embedding array<double>").repartition(4)
    rows = retrieve.cosine_top_k(q, d, 4, query_rows, doc_rows, tile, cells).collect()
    want = brute_top(queries, docs, 4)
    assert len(rows) == 4 * len(queries)
    for row in rows:
        doc, sim = want[row.query_id][row["rank"] - 1]
        assert row.doc_id == doc and row.similarity == pytest.approx(sim, abs=1e-8)
    assert retrieve.cosine_top_k(q, d.where("false"), 4).collect() == []


def test_products_are_bounded_and_narrow_tiles_spare_work():
    """5,000 by 5,000 vectors in forty topics: every product within the limit, most of them never formed."""
    rng = np.random.default_rng(9)
    topics = rng.normal(size=(40, 32))
    docs = retrieve._unit(topics[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 32)) * 0.08)
    queries = retrieve._unit(topics[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 32)) * 0.08)
    places = rng.permutation(5000) + 1
    best = retrieve.search(queries, docs, places, 4, tile=128, cells=20_000)
    assert best.largest <= 20_000 and best.computed < 0.5 * 5000 * 5000
    sims = np.rint(queries @ docs.T * 1e9).astype(np.int64)
    for i in range(0, 5000, 7):
        top = np.lexsort((places, -sims[i]))[:4]
        assert sorted(best.keys[i], reverse=True) == [(int(sims[i, j]) << 32) - int(places[j]) for j in top]


def test_similarity_expression(spark, vectors):
    a, b = vectors[1][0][1], vectors[1][1][1]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    want = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    assert df.select(retrieve.similarity(F.col("a"), F.col("b")).alias("s")).first().s == pytest.approx(want)


def test_documents_and_prompt(spark):
    found = spark.createDataFrame(
        [("h", 2, "d2", "Two", "incident", 0.125, "second"), ("h", 1, "d1", "One", "runbook", 0.875, "first")],
        "query_id string, rank int, doc_id string, title string, source string, similarity double, content string")
    row = context.doc_block(found).first()
    assert row.doc_ids == ["d1", "d2"] and row.doc_count == 2
    assert row.doc_context == "[1] One (source=runbook, similarity=0.88)\nfirst\n\n[2] Two (source=incident, similarity=0.12)\nsecond"
    host = spark.createDataFrame(
        [("h", "n", "web", "prod", "linux", "/var/log", 100.0, 0.61234, 1.5, None, 90.0, None, None, True, None, None)],
        "host_id string, hostname string, role string, environment string, os string, monitored_path string, "
        "total_disk_gb double, anomaly_score double, forecast_1d_pct double, forecast_3d_pct double, forecast_7d_pct double, "
        "forecast_14d_pct double, hours_to_90pct double, triggered_agent boolean, file_listing string, doc_context string")
    text = host.select(context.prompt().alias("p"), context.query_text().alias("q")).first()
    assert text.q == "linux web server anomalous log growth /var/log"
    for part in ("  host_id:        h\n", "  total_disk_gb:  100.0\n", "  anomaly_score:    0.612\n", "  forecast_3d_pct:  None\n",
                 "  triggered_agent:  True\n", context.NO_FILES, context.NO_DOCS):
        assert part in text.p
    assert json.dumps(text.p)


def test_answers_must_be_strict_json(spark):
    rows = [
        (1, "{'recommendation':'clean','self_confidence':0.95}"),
        (2, '{"recommendation":"clean","self_confidence":"0.9f"}'),
        (3, '{"recommendation":"clean","self_confidence":true}'),
        (4, '{"recommendation":"clean","self_confidence":"0.9"}'),
    ]
    got = {r.id: r for r in context.parse_answers(spark.createDataFrame(rows, "id int, raw string")).collect()}
    assert [got[i].parsed for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert [got[i].self_confidence for i in (1, 2, 3, 4)] == [0.0, 0.0, 1.0, 0.9]


def test_files_of_many_hosts_are_ranked_before_the_join(spark, monkeypatch):
    rows = [(f"h{h}", f"/x/{i}", i * 7 % 83, datetime(2026, 1, 1)) for h in range(4) for i in range(70)]
    files = spark.createDataFrame(rows, "host_id string, path string, size_bytes long, mtime timestamp")
    asking = spark.createDataFrame([("h1",), ("h3",), ("none",)], "host_id string")
    now = datetime(2026, 3, 1)
    few = triage.redacted_listing(files, now, asking)
    monkeypatch.setattr(triage, "FULL_ROWS", 0)
    many = triage.redacted_listing(files, now, asking)
    got = {r.host_id: r.asDict() for r in many.collect()}
    assert set(got) == {"h1", "h3"} and got == {r.host_id: r.asDict() for r in few.collect()}
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan[plan.index("LeftSemi"):]
