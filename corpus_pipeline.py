"""From raw documents to packed sequences: the stages of a training corpus, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimwatch.llm import exact_dedup, language, mixing, near_dup, packing
from brimwatch.llm.common import broadcast_if_small, stage
from brimwatch.session import configure

#: Columns of documents; a column that the input lacks is null.
COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _columns(docs: DataFrame) -> DataFrame:
    have = {f.name for f in docs.schema}
    return docs.select(
        *(F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items())
    )


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose doc_id is (left_semi) or is not (left_anti) among ``ids``, a null among nulls."""
    ids = broadcast_if_small(stage(ids.select(F.col("doc_id").alias("id")).distinct(), "ids"))
    return docs.join(ids, docs.doc_id.eqNullSafe(ids.id), how).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language: no letters, or letters but not one n-gram of any learned language.

    The filters are learned from the labelled part of the stage's own input.
    Documents without a ``lang`` get the predicted one, others keep theirs. If
    nothing can be learned, as no document has a ``lang``, all with letters stay.
    """
    docs = _columns(docs)
    shape = language.Shape()
    filters = language.fit(docs, shape)
    if not filters.langs:
        return docs.where(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    told = language.predict(docs, filters, shape, keep=tuple(COLUMNS))
    found = told.where((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") > 0))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest doc_id; of equal rows one."""
    docs = _columns(docs)
    verdict = stage(exact_dedup.exact_dedup(docs), "exact")
    per_id = stage(verdict.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("stays")), "per_id")
    rest = _only(docs, per_id.where("n > 1 OR NOT stays"), "left_anti")
    if not per_id.where("n > 1").limit(1).count():
        return rest
    # A doc_id on several rows: the one with the longest original for each of its texts that stay.
    several = _only(docs, per_id.where("n > 1"), "left_semi")
    text = F.coalesce("text", F.lit(""))
    plain = several.withColumn("sha", F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256))
    best = plain.groupBy("doc_id", "sha").agg(
        F.max(F.struct(F.length(text).alias("points"), "text", "lang", "source", "n_chars")).alias("r")
    )
    stays = verdict.where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("s")).distinct()
    best = best.join(stays, best.doc_id.eqNullSafe(stays.id) & (best.sha == stays.s), "left_semi")
    return rest.unionByName(best.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars").select(*COLUMNS))


def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    docs = _columns(docs)
    verdict = near_dup.near_duplicates(docs)
    return _only(docs, verdict.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where("NOT stays"), "left_anti")


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw half of the tokens so that sources, languages and topics have their target shares."""
    docs = _columns(docs)
    return _only(docs, mixing.mix_sources(docs, share=mixing.SHARE).where("kept"), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two."""
    # Workers still hold what the other stages needed, so less text at a time and fewer words remembered.
    return packing.pack(docs, batch_bytes=1 << 18)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", keep_exact),
    ("near_dedup", keep_near),
    ("mixing", to_target_weights),
    ("packing", packed),
]
#: Language identification, near deduplication and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
