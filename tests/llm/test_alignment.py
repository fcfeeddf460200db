"""Alignment of two tokenizers against encoding each whole text and comparing byte ends."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from brimwatch.llm import alignment
from brimwatch.llm.tokens import byte_characters, public_path


@pytest.fixture(scope="module")
def whole():
    """Tokens of whole texts, straight from both libraries: [(id, bytes)] each."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    value = {c: i for i, c in enumerate(byte_characters())}

    @cache
    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        one = [(i, bytes(value[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes_b(i)) for i in b.encode(text)]
        raw = (" " + text).encode()
        spelt = text and all(b"".join(x for _, x in side) == raw for side in (one, two))
        return (one, two) if spelt else ([], [])

    return tokens


def brute(rows, tokens):
    """{doc_id: [digest rows]} for (doc_id, text) rows."""
    made, count = [], Counter()
    for key, text in rows:
        one, two = tokens(text or "")
        ends = []
        for side in (one, two):
            at, reached = defaultdict(list), 0
            for i, raw in side:
                reached += len(raw)
                at[reached].append(i)
            ends.append(at)
        links = [(x, y) for e in ends[0] for x in ends[0][e] for y in ends[1].get(e, ())]
        count.update(links)
        shared = sorted(set(ends[0]) & set(ends[1]))
        parts = [([], []) for _ in shared]
        for side in (0, 1):
            for e in sorted(ends[side]):
                parts[bisect_left(shared, e)][side].extend(ends[side][e])
        groups = ["|".join(",".join(map(str, p)) for p in part) for part in parts]
        made.append((key, len(one), len(two), ";".join(groups), links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = defaultdict(list)
    for key, n_a, n_b, groups, links in made:
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_best = sum(count[x] == best[x[1]] for x in links)
        out[key].append(
            (n_a, n_b, groups.count(";") + bool(groups), len(links), n_best, sum(count[x] for x in links), sha)
        )
    return {k: sorted(v) for k, v in out.items()}


def check(docs, tokens):
    got = defaultdict(list)
    for r in alignment.cross_align(docs).collect():
        got[r.doc_id].append((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokens)
    assert {k: sorted(v) for k, v in got.items()} == want
    return want


def test_documents(spark, data, whole):
    assert len(check(spark.read.parquet(f"{data}/documents.parquet").repartition(5), whole)) == 200


def test_messy(spark, messy, nothing, whole):
    check(messy, whole)
    assert alignment.cross_align(nothing).collect() == []


def test_odd_texts(spark, whole):
    draw = random.Random(3)
    signs = list("abcThe's 12,. \n\t\r\x1c\x85  　é中😀<>|▁") + [" "] * 6 + ["the "]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    texts += ["<s> </s> <unk> <0x41> <|endoftext|>", "a▁b", " ", "  ", "x ", "\n", "a \n b", "  a  b  ", "nul\x00l", "ﬁ ½ ²"]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    want = check(spark.createDataFrame(rows, "doc_id long, text string"), whole)
    assert want[401] == [(0, 0, 0, 0, 0, 0, "")] and want[400][0][0] > 0


def test_forgetting_changes_nothing(monkeypatch, whole):
    monkeypatch.setattr(alignment, "REMEMBERED", 8)
    v = alignment.Vocabularies(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    windows = alignment.Windows(v)
    texts = [f"one two {i} three four one {i % 3}" for i in range(40)]
    for k in range(0, 40, 5):
        for text, row in zip(texts[k : k + 5], alignment._align(texts[k : k + 5], v, windows), strict=True):
            a, b = whole(text)
            assert row[:2] == (len(a), len(b))
            one, two = alignment.unpack(row[4], windows.code, windows.width)
            assert len(one) == len(two) == row[2] and (one[-1], two[-1]) == (a[-1][0], b[-1][0])


def test_without_spaces_and_bound(whole):
    v, windows = alignment.loaded(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    assert v.apart and v.encode_a != v._by_file and v.most_pairs < 1 << 20
    text = "abc中文字" * 30_000
    (n_a, n_b, groups, _, _), = alignment._align([text], v, windows)
    a, b = whole(text)
    assert (n_a, n_b) == (len(a), len(b))
    ends = [np.cumsum([len(x) for _, x in side]) for side in (a, b)]
    assert groups == len(np.intersect1d(*ends))


def test_windows_are_aligned_together(monkeypatch, whole):
    """One pass over many windows gives what each of them gives alone."""
    v = alignment.Vocabularies(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    windows = alignment.Windows(v)
    gap = np.array([alignment._GAP], "<u4").tobytes()
    keys = []
    for text in ("a", "unbelievable stories", "Zeitgeist", "x" * 50, "中文", "1234567", "naïve café"):
        a, b = whole(text)
        keys.append(np.array([i for i, _ in a], "<u4").tobytes() + gap + np.array([i for i, _ in b], "<u4").tobytes())
    together = list(windows.align(keys))
    assert together == [x for k in keys for x in windows.align([k])]
    for key, (text, n, links) in zip(keys, together, strict=True):
        assert len(links) == n * windows.code.itemsize and text.count("|") == n
        flat = [int(i) for group in text.split(";") for i in group.split("|")[0].split(",")]
        assert np.array(flat, "<u4").tobytes() == key.split(gap)[0]
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    coded = pa.array(keys * 2, pa.large_binary()).dictionary_encode()
    distinct, at = windows.of(coded)
    assert [distinct[k] for k in at] == together * 2
