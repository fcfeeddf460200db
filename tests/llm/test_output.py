"""Sharding, mixing, packing, training order and the pipeline: laws, round trips, and SQL."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from brimwatch.llm import mixing, packing, ring, training_order
from brimwatch.llm.tokens import TokenIds, public_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


def test_ids_equal_the_tokenizer(tokenizer, spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60).toPandas().text.tolist()
    odd = ["", None, " a  b's CAFÉ É J̌ İİ x,y. 12 3's\x0bq\x1c z", "  hi", "Straße,ÆØÅ. ÿ. mid.dle 'tis n't…", " a b"]
    ids, at = TokenIds(public_path()).of(pa.array(docs + odd))
    for i, text in enumerate(docs + odd):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(tokenizer, text)[:-1].tolist()


def test_words_by_ranks_equal_the_model(monkeypatch):
    """Latin words are encoded all at once, and as the tokenizer's own model does."""
    from brimwatch.llm import tokens

    known = TokenIds(public_path())
    assert known.encode_words != known._by_model
    draw = random.Random(4)
    signs = "etaoinshrdluabcçéèñöß" + "ÿ"
    words = sorted({"".join(draw.choice(signs) for _ in range(draw.randint(1, 24))) for _ in range(4000)})
    for (one, two) in zip(known.encode_words(words), known._by_model(words), strict=True):
        assert one.tolist() == two.tolist()
    # Words that are forgotten in between, and other spellings, change nothing.
    texts = [" ".join([w, w.title() + ".", w.upper() + ",", "", "3" + w, w + ".,"]) for w in words[:300] if "ß" not in w]
    whole = [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    for k in range(0, len(texts), 7):
        ids, at = known.of(pa.array(texts[k : k + 7]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == whole[k : k + 7]



def test_smaller_batches_remember_fewer_words(monkeypatch):
    """Worker memory follows the batch size; the ids do not."""
    from brimwatch.llm import tokens

    texts = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"text": texts})

    def ids_by(size):
        monkeypatch.setattr(tokens, "_loaded", {})
        parts = [ids for _, ids, _ in tokens.encoded(iter([batch]), public_path(), 2, size)]
        return np.concatenate(parts).tolist(), len(tokens.loaded(public_path()).known)

    (small, few), (large, many) = ids_by(1 << 11), ids_by(1 << 20)
    assert small == large
    assert many > 8000 and few < 1000


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, messy, nothing, law):
    same = spark.createDataFrame([(77, "copy")] * 300, "doc_id long, text string")  # one id on most rows
    docs = messy.select("doc_id", "text").unionByName(same)
    out = ring.shard_rows(docs, law=law).collect()
    assert len(out) == docs.count()
    slots, size = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        counts = [len(slots.get(s, [])) for s in range(40)]
        assert max(counts) - min(counts) <= 1
    else:
        largest = max(r["size"] for r in out)
        assert max(size.values()) <= sum(size.values()) / 40 + 1 + largest
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    assert ring.shard_rows(nothing, law=law).collect() == []


def test_slack_limits_movement(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    where = lambda n: {r.doc_id: r.shard for r in ring.shard_rows(docs, n, slack=0.2).collect()}
    before, after = where(20), where(21)
    assert sum(before[i] != after[i] for i in before) < 0.25 * len(before)


def test_mixing_equals_sql(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    cursor = con.execute(mixing.sql())
    names = [c[0] for c in cursor.description]
    got = sorted(map(tuple, mixing.mix_sources(docs).select(*names).collect()))
    assert got == sorted(cursor.fetchall())


def test_mixing_meets_targets(spark, messy, nothing):
    rows = mixing.mix_sources(messy)
    assert rows.count() == messy.count()
    assert rows.where("tokens = 0 AND kept").count() == 0
    cells = spark.createDataFrame(
        [("a", "x", 50), ("a", "y", 10), ("b", "x", 5), ("b", "y", 35)], "source string, lang string, tokens long"
    )
    want = {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.5, "y": 0.5}}
    out = mixing.rake(cells, ("source", "lang"), want, sweeps=40).toPandas()
    for name, share in want.items():
        total = out.groupby(name).weight.sum() / out.weight.sum()
        assert all(abs(total[k] - v) < 1e-6 for k, v in share.items())
    assert mixing.mix_sources(nothing).collect() == []


def test_kept_share_with_a_tiny_cell(spark, data):
    """The pipeline keeps the stated share of tokens, also with one small document in a language or source of its own."""
    docs = spark.createDataFrame(
        [(i, "word " * (20 + i % 7), "abcc"[i % 4], "xyyyz"[i % 5]) for i in range(3000)],
        "doc_id long, text string, source string, lang string",
    )
    for source, lang in ((None, None), ("a", "rare"), ("rare", "x")):
        tiny = spark.createDataFrame([(-1, "word " * 10, source, lang)], docs.schema)
        both = docs.unionByName(tiny) if lang else docs
        kept = corpus_pipeline.to_target_weights(spark, both, data)
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        tokens = sum(20 + i % 7 for i in ids if i >= 0)
        assert abs(tokens / sum(20 + i % 7 for i in range(3000)) - mixing.SHARE) < 0.03
        assert not lang or -1 in ids
        rows = mixing.mix_sources(both, share=mixing.SHARE).toPandas()
        drawn = (rows.tokens * rows.probability).sum()
        assert abs(drawn / rows.tokens.sum() - mixing.SHARE) < 1e-3 and rows.probability.between(0, 1).all()


def test_raking_within_bounds(spark):
    cells = spark.createDataFrame(
        [("a", "x", 50), ("a", "y", 10), ("b", "x", 5), ("b", "y", 35), ("b", "z", 0)],
        "source string, lang string, tokens long",
    )
    want = {"source": {"a": 0.4, "b": 0.6}, "lang": {"x": 0.5, "y": 0.5}}
    out = mixing.rake_within(cells, ("source", "lang"), want, share=0.3, sweeps=40).toPandas()
    assert (out.weight <= out.tokens + 1e-9).all() and abs(out.weight.sum() - 30) < 1e-6
    assert abs(out[out.source == "b"].weight.sum() - 18) < 1e-2 and abs(out[out.lang == "x"].weight.sum() - 15) < 1e-2
    out = mixing.rake_within(cells, ("source", "lang"), want, share=0.9, sweeps=4).toPandas()
    assert (out.weight <= out.tokens + 1e-9).all()
    none = {"lang": {"x": 1.0}}
    out = mixing.rake_within(cells, ("source", "lang"), none, share=0.9, sweeps=4).toPandas()
    assert out[out.lang != "x"].weight.sum() == 0 and abs(out.weight.sum() - 55) < 1e-6


def test_packing(messy, nothing, tokenizer):
    out = packing.pack(messy, longest=64).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    rows = {r.doc_id: r.text for r in messy.collect()}
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0
    for doc, text in rows.items():
        ids = ids_of(tokenizer, text)
        copies = 2 if doc == 2 else 1
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(ids) == copies * own[0].doc_tokens
        assert [r.length for r in own][::copies] == packing.cuts(len(ids), 64)
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack(nothing).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_feistel_is_a_permutation(n):
    for key in (1, 2):
        there = training_order.feistel(np.arange(n), n, key)
        assert sorted(there) == list(range(n))
        assert training_order.feistel(there, n, key, back=True).tolist() == list(range(n))


def test_shards_round_trip(spark, messy, nothing, tokenizer, tmp_path):
    order = training_order.Order(length=32, per_shard=100)
    out = f"{tmp_path}/shards"
    docs = messy.repartition(3)
    index = {r.sequence_id: r for r in training_order.write_shards(docs, out, order=order).collect()}
    stored = training_order.read_shards(spark, out, order).collect()
    assert sorted(r.slot for r in stored) == list(range(len(index)))
    assert {r.sequence_id: r.slot for r in stored} == {k: r.slot for k, r in index.items()}
    # A plain reader finds a record by its slot alone.
    some = index[min(3, len(index) - 1)]
    (path,) = (tmp_path / "shards" / f"shard={some.shard}").glob("part-*")
    record = path.read_bytes()[some.byte_offset : some.byte_offset + order.record]
    assert np.frombuffer(record, "<u4", 1)[0] == some.sequence_id
    # The sequences, in their order, are the documents' ids.
    text = {r.doc_id: r.text for r in messy.collect()}
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u2") for r in stored}
    told = defaultdict(list)
    for k in sorted(index):
        r = index[k]
        assert len(ids[k]) == r.n_tokens
        for i, (doc, start) in enumerate(zip(r.doc_ids, r.doc_starts)):
            stop = r.doc_starts[i + 1] if i + 1 < len(r.doc_ids) else r.n_tokens
            told[doc].extend(ids[k][start:stop].tolist())
    for doc, t in text.items():
        assert told[doc] == ids_of(tokenizer, t).tolist() * (2 if doc == 2 else 1)
    assert training_order.materialise(nothing).collect() == []


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, data), name)
        seen[name] = docs
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert ids["language_id"] >= ids["exact_dedup"] >= ids["near_dedup"] >= ids["mixing"] == ids["packing"]
    assert all(list(seen[k].columns) == list(corpus_pipeline.COLUMNS) for k in list(seen)[:-1])


def test_stages_on_messy_rows(spark, messy, nothing, data):
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, nothing, data).count() == 0, name
    kept = corpus_pipeline.keep_exact(spark, messy, data).collect()
    texts = ["".join((r.text or "").split()) for r in kept]
    assert sorted(texts) == sorted({"".join((r.text or "").split()) for r in messy.collect()})
    assert corpus_pipeline.known_language(spark, messy, data).where("doc_id IN (6, 7, 8, 12)").count() == 0
    near = corpus_pipeline.keep_near(spark, messy, data)
    assert near.where("doc_id IN (9, 10)").count() == 1


def test_packing_does_not_depend_on_the_batch(messy):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = [sorted(map(str, packing.pack(messy, batch_bytes=b).select(*names).collect())) for b in (1 << 22, 100)]
    assert rows[0] == rows[1] and len(rows[0]) > 16


def test_the_pipeline_keeps_a_corpus_without_languages(spark, messy):
    docs = messy.select("doc_id", "text")
    kept = corpus_pipeline.known_language(spark, docs, "")
    want = [r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))
