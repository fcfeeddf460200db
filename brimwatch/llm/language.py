"""Language identification with bit-sliced Bloom filters of n-grams (operator 3).

Each language has a Bloom filter of the n-grams seen often enough in its texts.
The filters are stored bit-sliced: slot i holds one bit per language, so that
and-ing the few slots of an n-gram gives at once all languages that contain it.
A text's n-grams are looked up, the hits are counted per language, and each
count is corrected for what the filter would have answered by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import WORD_BYTES, mix, seeds, slices, stage, start_afresh, unstage
from brimwatch.operators.skew import top_per_key

#: Answer for texts without a letter.
UNDECIDED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_KEYS = seeds(8, 50021) | np.uint64(1)


@dataclass(frozen=True)
class Shape:
    sizes: tuple[int, ...] = (2, 3, 4)
    #: Documents that teach a language, at most about; the only bound of the fit.
    sample: int = 4000
    #: n-grams kept per language and size, the most frequent first: bounds the filters.
    grams: int = 20_000
    #: A language contains an n-gram if its rate there is at least this part of the highest rate.
    share: float = 0.25
    #: Documents an n-gram must occur in.
    support: int = 3
    slots: int = 1 << 20
    probes: int = 3


@dataclass
class Filters:
    """``slices[w]`` has bits for languages 64 w and up, one slot per row."""

    langs: list[str]
    slices: list[np.ndarray]
    #: Chance that a language answers for an n-gram it does not hold.
    chance: np.ndarray
    #: The language that answers where nothing was found.
    common: int


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class _Text:
    """Words of letters of several texts, lower-cased, each between blanks, as code points."""

    def __init__(self, texts: list[str | None]):
        plain = [" " + _NOT_LETTERS.sub(" ", t.lower()).strip() + " " if t else " " for t in texts]
        # Number signs such as halves and squares are kept in words but are no letters.
        lettered = [any(c.isalpha() for c in p) for p in plain]
        self.letters = np.array([(len(p) - p.count(" ")) * b for p, b in zip(plain, lettered, strict=True)], dtype=np.int64)
        raw = "".join(plain).encode("utf-32-le", "surrogatepass")
        self.points = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
        self.owner = np.repeat(np.arange(len(plain), dtype=np.int32), [len(p) for p in plain])
        self.blank = self.points == 32

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, text) of the n-grams; a blank may only be at one end."""
        n = max(0, len(self.points) - size + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        inside = self.owner[:n] == self.owner[len(self.owner) - n :]
        for i in range(size):
            rolled += self.points[i : n + i] * _KEYS[i]
            if 0 < i < size - 1:
                inside &= ~self.blank[i : n + i]
        inside &= ~(self.blank[:n] & self.blank[len(self.blank) - n :])
        return mix(rolled[inside] + np.uint64(size)), self.owner[:n][inside]


def _counted(shape: Shape):
    """Rows (lang, text) to (lang, gram, size, docs): in how many documents of the batch a gram occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        for batch in batches:
            for piece in slices(batch, "text", WORD_BYTES):
                langs = np.array(piece.column("lang").to_pylist(), dtype=object)
                texts = piece.column("text").to_pylist()
                for lang in set(langs):
                    own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                    read = _Text(own)
                    for size in shape.sizes:
                        gram, owner = read.grams(size)
                        value, code = np.unique(gram, return_inverse=True)
                        pair = np.unique(code.astype(np.int64) * len(own) + owner)
                        docs = np.bincount(pair // max(1, len(own)), minlength=len(value))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(value), pa.string()),
                                pa.array(value.view(np.int64)),
                                pa.array(np.full(len(value), size, np.int32)),
                                pa.array(docs.astype(np.int64)),
                            ],
                            names=["lang", "gram", "size", "docs"],
                        )

    return run


def _slots(grams: np.ndarray, shape: Shape) -> list[np.ndarray]:
    step = mix(grams ^ _KEYS[7]) | np.uint64(1)
    last = np.uint64(shape.slots - 1)  # slots is a power of two
    return [((grams + np.uint64(i) * step) & last).astype(np.int64) for i in range(shape.probes)]


def fit(docs: DataFrame, shape: Shape = Shape()) -> Filters:
    """Learn the filters from the texts and languages of ``docs`` (text, lang, doc_id).

    Rows without a language and held-out ones are left aside. Every language
    teaches with about ``shape.sample`` documents, those with the smallest hashes
    of doc_id and text; if it has fewer, with all.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    # One row per language, however many documents.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    total = {r.lang: r.n for r in sizes.collect()}
    if not total:
        return Filters([], [np.zeros(shape.slots, np.uint8)], np.zeros(0), 0)
    langs = sorted(total)
    part = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, shape.sample / total[lang]))))
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) / F.lit(1 << 24)
    sample = known.where(rank < F.element_at(part, F.col("lang"))).select("lang", "text")
    taught = min(total.values())
    counts = stage(
        sample.mapInArrow(_counted(shape), "lang string, gram long, size int, docs long")
        .groupBy("lang", "gram", "size")
        .agg(F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min(shape.support, taught)),
        "grams",
    )
    rate = F.col("docs") / F.element_at(
        F.create_map(*(F.lit(x) for lang in langs for x in (lang, float(min(total[lang], shape.sample))))),
        F.col("lang"),
    )
    rated = counts.withColumn("rate", rate)
    highest = rated.groupBy("gram").agg(F.max("rate").alias("highest"))
    chosen = rated.join(highest, "gram").where(F.col("rate") >= shape.share * F.col("highest"))
    order = [F.col("docs").desc(), F.col("gram")]
    # At most languages * sizes * grams rows of the bounded sample.
    rows = top_per_key(chosen, ["lang", "size"], order, shape.grams).select("lang", "gram").toPandas()
    unstage(counts)
    kinds = ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64))
    kind = next((k for bits, k in kinds if len(langs) <= bits), np.uint64)
    slices_ = [np.zeros(shape.slots, kind) for _ in range((len(langs) + 63) // 64)]
    chance = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        used = np.zeros(shape.slots, dtype=bool)
        for slot in _slots(rows.gram[rows.lang == lang].to_numpy(np.int64).view(np.uint64), shape):
            used[slot] = True
        slices_[i // 64][used] |= kind(1 << (i % 64))
        chance[i] = used.mean() ** shape.probes
    return Filters(langs, slices_, chance, int(np.argmax([total[x] for x in langs])))


def decide(texts: list[str | None], filters: Filters, shape: Shape) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    hits = np.zeros((len(texts), len(filters.langs)))
    read = _Text(texts)
    letters = read.letters
    for size in shape.sizes:
        gram, owner = read.grams(size)
        asked = np.bincount(owner, minlength=len(texts)).astype(float)
        slots = _slots(gram, shape)
        for w, table in enumerate(filters.slices):
            mask = table[slots[0]]
            for slot in slots[1:]:
                mask &= table[slot]
            starts = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i in range(64 * w, min(len(filters.langs), 64 * w + 64)):
                bit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                total = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
                found = total[starts[1:]] - total[starts[:-1]]
                # found = true + (asked - true) * chance
                real = (found - asked * filters.chance[i]) / max(1e-9, 1 - filters.chance[i])
                hits[:, i] += np.maximum(real, 0)
    best = hits.argmax(axis=1) if len(filters.langs) else np.zeros(len(texts), int)
    total = hits.sum(axis=1)
    top = hits.max(axis=1) if len(filters.langs) else total
    best = np.where(total > 0, best, filters.common)
    score = np.where(total > 0, top / np.maximum(total, 1e-9), 0.0)
    none = (letters == 0) | (not filters.langs)
    return [UNDECIDED if none[i] else filters.langs[best[i]] for i in range(len(texts))], np.where(none, 0.0, score)


def predict(docs: DataFrame, filters: Filters, shape: Shape = Shape(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add lang_pred and score to the columns ``keep``, from the text alone.

    A text that is null or has no letter is `und` with score 0; a text with
    letters none of which was ever seen gets the most frequent language with
    score 0. The score is the winner's part of all corrected hits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # a slot per language slice: fixed size
    others = [c for c in keep if c != "text"]
    source = docs.select(*others, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        for batch in batches:
            for piece in slices(batch, "text", WORD_BYTES):
                langs, score = decide(piece.column("text").to_pylist(), shared.value, shape)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score)], names=names
                )

    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Fit on the labelled part of ``docs`` and answer for every row: doc_id, held_out, lang_pred, score."""
    filters = fit(docs, shape)
    return predict(docs, filters, shape).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
