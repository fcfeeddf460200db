"""Token ids of whole texts, by a tokenizer file that is a parameter."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from brimwatch.llm.common import REMEMBERED as FORGET
from brimwatch.llm.common import give_back, slices

#: Distinct words a worker remembers; beyond that it forgets them all and goes on.
REMEMBERED = 400_000
#: Bytes of text that are looked up at a time; more text repeats more words.
BATCH_BYTES = 4 << 20
#: With smaller batches fewer words are remembered, one for so many bytes.
BYTES_A_WORD = 10
#: Words whose normal form is plain lower-casing: Latin letters, then at most one full stop or comma.
LATIN_WORD, LATIN_STEM, MARKS = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$", r"^[a-zß-öø-ÿ]+$", [".", ","]


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(other)) for b in range(256)]


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _flat(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and their lengths."""
    lists = list(lists)
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(lengths.sum())), lengths


def _gather(ids: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of the lists ids[at[i]:at[i + 1]] for i in ``row``, laid one after the other."""
    first, count = at[row], at[row + 1] - at[row]
    ends = np.concatenate(([0], np.cumsum(count)))
    return ids[np.arange(ends[-1], dtype=np.int64) + np.repeat(first - ends[:-1], count)], ends


class TokenIds:
    """Ids of texts, from a tokenizer that never joins across white space.

    Each distinct word of a batch is encoded once and looked up after that; the
    words' ids are then laid out in text order. For tokenizers of that kind this
    equals encoding the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.most = REMEMBERED
        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        kinds = [
            [x["type"] for x in (parts[name] or {}).get(member, [])]
            for name, member in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
        ]
        # With these parts a Latin word is one piece for the model, in lower case and byte characters.
        self.direct = kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
        self.byte = byte_characters()
        self.encode_words = (self._by_ranks(parts["model"]) if self.direct else None) or self._by_model
        self._forget()
        del parts
        give_back()  # the vocabulary as text, a multiple of what is kept of it

    def _forget(self) -> None:
        # The first entry is the empty word, which has no ids.
        self.known: dict[str, int] = {"": 0}
        self.at = np.zeros(2, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self._add(MARKS, *self._whole(MARKS))

    def _by_ranks(self, model: dict) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None:
        """A faster encoder of Latin words in lower case, for the same merges; none for other vocabularies.

        The end of a word is written as one more byte, zero, that no such word
        has. Merging the pair whose token has the smallest id equals merging by
        the list of merges if ids rise with that list, after all single bytes.
        """
        suffix, vocabulary = model.get("end_of_word_suffix"), model.get("vocab", {})
        if model.get("type") != "BPE" or not suffix or model.get("dropout") or model.get("continuing_subword_prefix"):
            return None
        value = {c: b for b, c in enumerate(self.byte)}
        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            body = token.removesuffix(suffix)
            if not all(c in value for c in body):
                return None
            ranks[bytes(value[c] for c in body) + b"\0" * (body != token)] = i
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        made = [vocabulary.get("".join(x), -1) for x in merges]
        single = set(self.byte) | {c + suffix for c in self.byte}
        if (
            len(ranks) != len(vocabulary)
            or not single <= vocabulary.keys()
            or len(single) + len(made) != len(vocabulary)
            or any(a >= b for a, b in pairwise([max(vocabulary[c] for c in single), *made]))
        ):
            return None
        import tiktoken

        own = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        last = np.zeros(max(ranks.values()) + 1, dtype=bool)
        last[[i for token, i in ranks.items() if token.endswith(b"\0")]] = True

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = np.array(own.encode_ordinary("\0".join([*words, ""])), dtype=np.uint32)
            return ids, np.diff(np.flatnonzero(last[ids]), prepend=-1)

        return encode

    def _by_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin words in lower case, one after the other, and how many each has."""
        ask, byte = self.tokenizer.model.tokenize, self.byte
        return _flat(
            [t.id for t in ask(w if w.isascii() else "".join([byte[b] for b in w.encode()]))] for w in words
        )

    def _add(self, new: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        start = len(self.at) - 1
        self.known.update(zip(new, range(start, start + len(new)), strict=True))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(lengths)))
        self.ids = np.concatenate((self.ids, flat))

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are remembered; those that are not are encoded."""
        if len(self.known) > min(self.most, REMEMBERED):
            self._forget()
        known, distinct = self.known, words.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in known]
        if self.direct:
            plain = pc.match_substring_regex(pa.array(new, pa.large_string()), LATIN_STEM)
            plain = plain.to_numpy(zero_copy_only=False).tolist()
            if ask := list(compress(new, plain)):
                self._add(ask, *self.encode_words(ask))
            new = [w for w, latin in zip(new, plain, strict=True) if not latin]
        if new:
            self._add(new, *self._whole(new))
        return np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of distinct words, one after the other.

        A Latin word is looked up in lower case and without its mark, whose ids follow.
        """
        if not self.direct:
            return _gather(self.ids, self.at, self._places(words))
        latin = pc.match_substring_regex(words, LATIN_WORD)
        coded = pc.if_else(latin, pc.utf8_lower(pc.utf8_rtrim(words, ".,")), words).dictionary_encode()
        row = np.zeros((len(words), 2), dtype=np.int64)
        row[:, 0] = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        for mark in MARKS:
            row[pc.and_(latin, pc.ends_with(words, mark)).to_numpy(zero_copy_only=False), 1] = self.known[mark]
        ids, ends = _gather(self.ids, self.at, row.ravel())
        return ids, ends[::2]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]. A null text has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        starts = lists.offsets.to_numpy()
        coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        starts = starts - starts[0]
        if not len(coded):
            return np.zeros(0, dtype=np.uint32), starts
        ids, ends = _gather(*self._table(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        return ids, ends[starts]


_loaded: dict[str, TokenIds] = {}
FORGET.append(_loaded.clear)


def loaded(path: str) -> TokenIds:
    """The tokenizer of this worker process."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, end: int, batch_bytes: int = BATCH_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches with their ids and offsets, ``end`` after the last id of each text."""
    known = loaded(path)
    known.most = batch_bytes // BYTES_A_WORD
    for batch in batches:
        for piece in slices(batch, "text", batch_bytes):
            ids, offsets = known.of(piece.column("text"))
            yield piece, np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
