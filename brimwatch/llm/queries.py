"""The operators as registered queries, each over its whole table, next to their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brimwatch.llm import (
    alignment,
    density,
    exact_dedup,
    language,
    mixing,
    near_dup,
    packing,
    ring,
    secrets,
    toxicity,
    training_order,
    vectors,
    whitening,
)
from brimwatch.llm.common import table
from brimwatch.session import configure

Query = Callable[[SparkSession, str], DataFrame]


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, folder: function(configure(spark), folder)


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": _query(lambda s, d: near_dup.near_duplicates(table(s, d, "documents"))),
    "op2_exact_dedup": _query(lambda s, d: exact_dedup.exact_dedup(table(s, d, "documents"))),
    "op3_language_id": _query(lambda s, d: language.identify(table(s, d, "documents"))),
    "op4_training_order": _query(lambda s, d: training_order.materialise(table(s, d, "documents"))),
    "op5_toxicity": _query(lambda s, d: toxicity.classify(table(s, d, "documents"), table(s, d, "labels"))),
    "op6_sharding": _query(lambda s, d: ring.shard_rows(table(s, d, "documents"))),
    "op7_embedding_near_dedup": _query(lambda s, d: vectors.near_vectors(table(s, d, "embeddings"))),
    "op8_mixing": _query(lambda s, d: mixing.mix_sources(table(s, d, "documents"))),
    "op9_html_extraction": _query(lambda s, d: density.main_texts(table(s, d, "pages"))),
    "op10_packing": _query(lambda s, d: packing.pack(table(s, d, "documents"))),
    "op11_secret_scan": _query(lambda s, d: secrets.secret_spans(table(s, d, "documents"))),
    "op12_whitening": _query(lambda s, d: whitening.whiten(table(s, d, "embeddings"))),
    "op13_token_alignment": _query(lambda s, d: alignment.cross_align(table(s, d, "documents"))),
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op8_mixing": mixing.sql(),
}
