"""Alignment of two tokenizers by whitespace-token anchors (operator 13).

Both tokenizers encode each whole text. Where a space-marked token of one and a
space-marked token of the other begin at the same byte, the tokens before them
share an end: these verified ends are anchors, and they cut the document into
windows of token ids, mostly one word each. A window's alignment depends on its
ids alone, so it is worked out once per tuple of ids and then looked up.

The links of a document are staged as pair codes. Their corpus-wide counts have
at most ``Vocabularies.most_pairs`` rows whatever the corpus: of two tokens that
end together one is a byte suffix of the other. That bound is what makes the
counts fit for collecting and broadcasting; it is checked.

Odd input: a text that is null, empty or not reproduced by both tokenizers has
zero counts, and no groups. Repeated rows are aligned each and count each; a
null doc_id stays null; other columns are not read. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import REMEMBERED as FORGET
from brimwatch.llm.common import slices, stage, unstage
from brimwatch.llm.tokens import byte_characters, public_path

#: Distinct words whose ids, and distinct windows whose alignment, a worker remembers; older ones go first.
REMEMBERED = 240_000
#: Longest window, in bytes of its key, that is remembered.
REMEMBERED_KEY = 512
#: Bytes of text that are aligned at a time.
BATCH_BYTES = 2 << 20
#: Windows that are worked out at a time.
TOGETHER = 1 << 13
#: Stands between the ids of the two tokenizers in a window's key; no id.
_GAP = 0xFFFFFFFF
_MARK = "▁"
#: A space after something visible starts a new word for both kinds of tokenizer.
_WORD = re.compile(r"(?<=\S)(?= )")
_LOOSE = re.compile(r"\s ")


class Memory(dict):
    """What was worked out lately: the half used last stays when the other half must go."""

    older: dict = {}

    def missing(self, keys: set) -> set:
        """Keys that must be worked out; remembered ones are moved to the younger half."""
        if len(self) > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        unknown = keys - self.keys()
        again = unknown & self.older.keys()
        self.update({k: self.older[k] for k in again})
        return unknown - again


class Vocabularies:
    """Two tokenizers: ids of texts, bytes of tokens, and the marks of words."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        self.bytes_a = self._byte_level()
        self.bytes_b, names = self._pieces()
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.spaced_a = np.array([x[:1] == b" " for x in self.bytes_a])
        self.spaced_b = np.array([x.startswith(_MARK) for x in names])
        parts = json.loads(self.a.to_str())
        cut = parts["pre_tokenizer"] or {}
        # Words can be encoded apart if no token holds a space behind anything else.
        self.apart = (
            parts["normalizer"] is None
            and (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not any(_MARK in x.lstrip(_MARK) for x in names)
            and self.b.encode("  a") == [*self.b.encode(" "), *self.b.encode("a")]
        )
        self.lone = [self.b.piece_to_id(_MARK)]
        self.known = Memory()
        self.encode_a = self._by_ranks(parts) if self.apart else self._by_file

    def _by_file(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def _by_ranks(self, parts: dict) -> Callable[[str], list[int]]:
        """A faster encoder for the same merges, if ids rise with the order of the merges."""
        merges = [x if isinstance(x, list) else x.split(" ") for x in parts["model"]["merges"]]
        ids = parts["model"]["vocab"]
        made = [ids.get(a + b, -1) for a, b in merges]
        single = [i for i, x in enumerate(self.bytes_a) if len(x) == 1]
        if len(single) != 256 or max(single) > 255 or made != list(range(256, 256 + len(made))):
            return self._by_file
        import public_tokenizers
        import tiktoken

        ranks = {x: i for i, x in enumerate(self.bytes_a) if x}
        pattern = public_tokenizers.PATTERN
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _byte_level(self) -> list[bytes]:
        value = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        out = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in vocabulary.items():
            # Special tokens in the table are no byte characters and are never encoded.
            if all(c in value for c in token):
                out[i] = bytes(value[c] for c in token)
        return out

    def _pieces(self) -> tuple[list[bytes], list[str]]:
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        out = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_MARK, " ").encode()
            for i, x in enumerate(names)
        ]
        return out, names

    @property
    def most_pairs(self) -> int:
        """Most distinct pairs of tokens that can end together."""
        same = np.unique([hash(x) for x in self.bytes_b], return_counts=True)[1].max()
        alike = np.unique([hash(x) for x in self.bytes_a], return_counts=True)[1].max()
        return int(self.length_a.sum() * same + self.length_b.sum() * alike)

    def words(self, text: str) -> list[str]:
        """A text behind one space, cut into words that both tokenizers encode apart."""
        if not self.apart:
            return [" " + text]
        if _LOOSE.search(" " + text):
            return _WORD.split(" " + text)
        return [" " + x for x in text.split(" ")]

    def _tokens(self, words: list[str], apart: list[list[int]]) -> tuple[list[bytes], list[bytes]] | None:
        """Ids of words of both tokenizers, by one call for all; none if their bytes are not the words' in turn.

        ``apart`` are the ids of the second tokenizer, word by word.
        """
        one = self.encode_a("".join(words))
        raw = "".join(words).encode()
        flat = list(chain.from_iterable(apart))
        if any(b"".join([table[i] for i in ids]) != raw for table, ids in ((self.bytes_a, one), (self.bytes_b, flat))):
            return None
        ends = np.cumsum([len(w.encode()) for w in words])
        reach, side = np.cumsum(self.length_a[one]), np.cumsum(self.length_b[flat])
        at, count = np.searchsorted(reach, ends), np.cumsum([len(x) for x in apart])
        if not (reach[at] == ends).all() or not (side[count - 1] == ends).all():
            return None
        out = []
        for ids, cuts in ((one, 4 * (at + 1)), (flat, 4 * count)):
            packed, cuts = array("I", ids).tobytes(), cuts.tolist()
            out.append([packed[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)])
        return out[0], out[1]

    def learn(self, words: list[str]) -> None:
        """Remember the tokens of new words, and whether they spell them."""
        # Only words that end visibly can stand in one text and be cut apart again.
        whole = [w for w in words if not w[-1].isspace() and _MARK not in w] if self.apart else []
        found = self._tokens(whole, self.b.encode([w[1:] for w in whole], num_threads=1)) if whole else None
        if found:
            self.known.update(zip(whole, zip(*found, repeat(True)), strict=False))
        for word in words:
            if word not in self.known:
                one = self._by_file(word)
                two = self.b.encode(word[1:]) if word != " " else self.lone
                raw = word.encode()
                spelt = all(
                    b"".join([table[i] for i in ids]) == raw
                    for table, ids in ((self.bytes_a, one), (self.bytes_b, two))
                )
                self.known[word] = (array("I", one).tobytes(), array("I", two).tobytes(), spelt)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, bool]]:
        """Per text the ids of both tokenizers (little-endian) and whether their bytes equal space and text."""
        cut = [self.words(t) if t else [] for t in texts]
        new = self.known.missing(set(chain.from_iterable(cut)))
        if new:
            self.learn(list(new))
        known = self.known
        for text, words in zip(texts, cut, strict=True):
            if not words:
                yield b"", b"", False
                continue
            found = [known[w] for w in words]
            one, two = b"".join([x[0] for x in found]), b"".join([x[1] for x in found])
            spelt = all([x[2] for x in found]) or self._spelt(text, one, two)
            yield (one, two, True) if spelt else (b"", b"", False)

    def _spelt(self, text: str, one: bytes, two: bytes) -> bool:
        raw = (" " + text).encode()
        return all(
            b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]) == raw
            for table, ids in ((self.bytes_a, one), (self.bytes_b, two))
        )


class Windows:
    """Alignments of windows, remembered by their ids."""

    def __init__(self, vocabularies: Vocabularies):
        self.width = len(vocabularies.bytes_b)
        fits = len(vocabularies.bytes_a) * self.width <= 1 << 32
        self.code = np.dtype("<u4" if fits else "<u8")
        self.length_a, self.length_b = vocabularies.length_a, vocabularies.length_b
        self.ids = max(len(self.length_a), len(self.length_b))
        #: An id inside a side of a group, as the last of A's side, as the last of the group.
        self.said = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]
        self.known = Memory()

    def align(self, keys: list[bytes]) -> Iterator[tuple[str, int, bytes]]:
        """(groups as text, number of groups, pair codes of the links) of each window."""
        flat = np.frombuffer(b"".join(keys), "<u4")
        owner = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys])
        gap = flat == _GAP
        behind = np.arange(len(flat)) > np.flatnonzero(gap)[owner]
        a, b = flat[~behind & ~gap], flat[behind]
        # Both sides of a window have the same bytes, so windows laid end to end share their ends.
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        shared, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        # Tokens have bytes, so exactly one of each side ends there: one link per group.
        codes = a[last_a].astype(self.code) * self.code.type(self.width) + b[last_b].astype(self.code)
        counts = np.bincount(owner[~behind & ~gap][last_a], minlength=len(keys))
        # Groups in turn, of each the tokens of A and then those of B, with what follows them.
        size = np.diff(last_a, prepend=-1) + np.diff(last_b, prepend=-1)
        first = np.cumsum(size) - size
        written = np.empty(len(a) + len(b), dtype=np.int64)
        at_a, at_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        before_a, before_b = (np.concatenate(([0], x[:-1] + 1)) for x in (last_a, last_b))
        place_a = first[at_a] + np.arange(len(a)) - before_a[at_a]
        written[place_a] = a
        place_b = first[at_b] + np.diff(last_a, prepend=-1)[at_b] + np.arange(len(b)) - before_b[at_b]
        written[place_b] = b
        written[place_a[last_a]] += self.ids
        written[place_b[last_b]] += 2 * self.ids
        said = list(map(self.said.__getitem__, written.tolist()))
        raw = codes.tobytes()
        groups = np.cumsum(counts)
        ends = np.cumsum(size)[groups - 1].tolist()
        stops = (groups * self.code.itemsize).tolist()
        begin = start = 0
        for end, stop, n in zip(ends, stops, counts.tolist(), strict=True):
            yield "".join(said[begin:end])[:-1], n, raw[start:stop]
            begin, start = end, stop

    def of(self, coded: pa.DictionaryArray) -> tuple[list[tuple[str, int, bytes]], list[int]]:
        """Alignments of the distinct windows, and the window at each place."""
        raw = coded.dictionary.buffers()[2].to_pybytes()
        cuts = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        keys = [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        new, missing = {}, list(self.known.missing(set(keys)))
        for i in range(0, len(missing), TOGETHER):
            some = missing[i : i + TOGETHER]
            new.update(zip(some, self.align(some), strict=True))
        self.known.update({k: x for k, x in new.items() if len(k) <= REMEMBERED_KEY})
        known = self.known
        return [known[k] if k in known else new[k] for k in keys], coded.indices.to_numpy().tolist()


def _starts(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each token, all bytes) of texts laid end to end."""
    ends = np.cumsum(lengths[ids])
    return ends - lengths[ids], ends[-1:] if len(ends) else np.zeros(1, np.int64)


def cut_windows(
    v: Vocabularies, a: np.ndarray, b: np.ndarray, sizes: list[int]
) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Windows of texts of ``sizes`` bytes laid end to end, and the number of windows before each text.

    A window begins with a text, and where space-marked tokens of both sides do.
    """
    start_a, _ = _starts(a, v.length_a)
    start_b, total = _starts(b, v.length_b)
    first = np.concatenate(([0], np.cumsum(sizes)))
    marked = np.zeros(int(total[0]) + 1, dtype=bool)
    marked[start_a[v.spaced_a[a]]] = True
    anchor = np.zeros_like(marked)
    shared = start_b[v.spaced_b[b]]
    anchor[shared[marked[shared]]] = True
    anchor[first[:-1]] = True
    anchors = np.flatnonzero(anchor)
    at_a = np.append(np.searchsorted(start_a, anchors), len(a))
    at_b = np.append(np.searchsorted(start_b, anchors), len(b))
    number = np.arange(len(anchors))
    flat = np.full(len(a) + len(b) + len(anchors), _GAP, dtype="<u4")
    flat[np.arange(len(a)) + np.repeat(at_b[:-1] + number, np.diff(at_a))] = a
    flat[np.arange(len(b)) + np.repeat(at_a[1:] + number + 1, np.diff(at_b))] = b
    offsets = (at_a + at_b + np.arange(len(at_a))) * 4
    keys = pa.Array.from_buffers(
        pa.large_binary(), len(anchors), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]
    )
    return keys.dictionary_encode(), np.searchsorted(anchors, first)


_loaded: dict[tuple[str, str], tuple[Vocabularies, Windows]] = {}
FORGET.append(_loaded.clear)


def loaded(byte_level: str, pieces: str) -> tuple[Vocabularies, Windows]:
    """The tokenizers and window memory of this worker process."""
    key = (byte_level, pieces)
    if key not in _loaded:
        vocabularies = Vocabularies(byte_level, pieces)
        _loaded[key] = (vocabularies, Windows(vocabularies))
    return _loaded[key]


def _align(texts: list[str | None], v: Vocabularies, windows: Windows) -> Iterator[tuple[int, int, int, str, bytes]]:
    """(ids of A, ids of B, groups, groups as text, links as codes) per text."""
    found = list(v.encode(texts))
    good = [i for i, x in enumerate(found) if x[2]]
    a = np.frombuffer(b"".join([found[i][0] for i in good]), "<u4")
    b = np.frombuffer(b"".join([found[i][1] for i in good]), "<u4")
    if good:
        coded, at = cut_windows(v, a, b, [len(texts[i].encode()) + 1 for i in good])
        distinct, place = windows.of(coded)
    row = 0
    for one, two, spelt in found:
        if not spelt:
            yield 0, 0, 0, "", b""
            continue
        mine = [distinct[k] for k in place[at[row] : at[row + 1]]]
        row += 1
        yield (
            len(one) // 4,
            len(two) // 4,
            sum([x[1] for x in mine]),
            ";".join([x[0] for x in mine]),
            b"".join([x[2] for x in mine]),
        )


def align(
    docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, groups: bool = False
) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``links``.

    ``links`` holds one little-endian code per link, A's id times the size of
    B's vocabulary plus B's id; ``unpack`` takes it apart. With ``groups`` the
    aligned groups come as text, too.
    """
    byte_level = byte_level or public_path("byte_bpe_50k.json")
    pieces = pieces or public_path("piece_bpe_32k.model")
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ["groups"] * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, windows = loaded(byte_level, pieces)
        for batch in batches:
            for piece in slices(batch, "text", BATCH_BYTES):
                rows = list(_align(piece.column("text").to_pylist(), v, windows))
                n_a, n_b, n_groups, text, links = (list(x) for x in zip(*rows, strict=True))
                sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
                counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_groups)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *counts, pa.array(sha), pa.array(links, pa.binary())]
                    + [pa.array(text)] * groups,
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *extra],
                )

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join([schema, *(f"{x} string" for x in extra)])
    )


def unpack(links: bytes, code: np.dtype, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of A, ids of B) of packed links."""
    return np.divmod(np.frombuffer(links, code), code.type(width))


def _codes(column: pa.Array, code: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all rows, first code of each row and their end) of a column of packed links."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(code), (offsets - offsets[0]) // code.itemsize


def pair_counts(links: DataFrame, code: np.dtype) -> DataFrame:
    """How many links hold each pair: (pair, n); counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, code), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def settle() -> None:
            nonlocal pairs, counts
            more, n = np.unique(np.concatenate(held), return_counts=True)
            merged, place = np.unique(np.concatenate((pairs, more)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, n)), len(merged)).astype(np.int64)
            pairs = merged
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            # A copy: the batch may be freed before the counts are settled.
            held.append(_codes(batch.column("links"), code)[0].copy())
            if sum(map(len, held)) > 1 << 21:
                settle()
        if held:
            settle()
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    parts = links.select("links").mapInArrow(run, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def cross_align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """Alignment of every document, and how its links stand in the whole corpus.

    n_best counts the links whose pair is the most frequent one of its B id,
    ties included; count_sum adds up the counts of the pairs of all links.
    """
    byte_level = byte_level or public_path("byte_bpe_50k.json")
    pieces = pieces or public_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    v, windows = loaded(byte_level, pieces)
    code, width, most = windows.code, windows.width, v.most_pairs
    staged = stage(align(docs, byte_level, pieces), "aligned", compression="zstd")
    totals = stage(pair_counts(staged, code), "pairs")
    rows = totals.count()
    if rows > most:
        raise RuntimeError(f"{rows} pairs of tokens end together; two vocabularies allow {most}")
    table = totals.toPandas().sort_values("pair")
    unstage(totals)
    pairs, counts = table["pair"].to_numpy().astype(code), table["n"].to_numpy()
    highest = np.zeros(width, dtype=np.int64)
    target = (pairs % code.type(width)).astype(np.int64)
    np.maximum.at(highest, target, counts)
    shared = spark.sparkContext.broadcast((pairs, counts, counts == highest[target]))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often, best = shared.value
        for batch in batches:
            for piece in slices(batch, "links", 4 * BATCH_BYTES):
                codes, at = _codes(piece.column("links"), code)
                place = np.searchsorted(known, codes)
                sums = [np.concatenate(([0], np.cumsum(x[place], dtype=np.int64))) for x in (best, often)]
                added = {n: pa.array(s[at[1:]] - s[at[:-1]]) for n, s in zip(("n_best", "count_sum"), sums, strict=True)}
                yield pa.RecordBatch.from_arrays(
                    [added[c] if c in added else piece.column(c) for c in columns], names=columns
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in columns[1:-1])
    return staged.mapInArrow(run, f"doc_id {kind}, {longs}, groups_sha256 string")
