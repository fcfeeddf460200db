"""Triage of triggered hosts: evidence, parsed answers, decisions, plans, tickets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimwatch.config import DEFAULTS, Settings
from brimwatch.functions import redact as R
from brimwatch.functions.scalar import fixed, short_id
from brimwatch.operators import cleanup, context, decision, tickets
from brimwatch.operators.latest import latest_predictions
from brimwatch.operators.retrieve import cosine_top_k
from brimwatch.operators.skew import FULL_ROWS, lookup
from brimwatch.schemas import RUNS
from brimwatch.session import cut_lineage
from brimwatch.sources.sinks import link_tickets


def triggered_context(hosts: DataFrame, predictions: DataFrame) -> DataFrame:
    """LAT3, JN3. Triggered hosts with metadata and newest prediction."""
    newest = latest_predictions(predictions, by_device=False).where("triggered_agent")
    return hosts.join(newest, "host_id")


def redacted_listing(files: DataFrame, as_of: datetime, asking: DataFrame | None = None) -> DataFrame:
    """SRC8, RED16, CTX1. Listing text per host, or per host of ``asking``, with redacted paths and their counts.

    Few hosts that ask are broadcast, and files of others dropped before any
    ranking. Otherwise files are ranked first, since the map tasks then keep only
    the largest ones of each host, and the shuffle serves the join as well.
    """
    few = asking is not None and asking.count() <= FULL_ROWS
    if few:
        files = files.join(F.broadcast(asking), "host_id", "left_semi")
    largest = context.largest_files(files, as_of)
    if asking is not None and not few:
        largest = largest.join(asking, "host_id", "left_semi")
    listed = R.redact(largest, ["path"])
    return context.file_listing(
        listed,
        R.merged_counts(F.col("redactions")).alias("file_redactions"),
        F.max("size_bytes").alias("largest"),
    )


def redacted_docs(queries: DataFrame, corpus: DataFrame, k: int = context.CONTEXT_DOCS) -> DataFrame:
    """RET1, RED16, CTX2. Document text per query with redacted content and counts."""
    best = cut_lineage(cosine_top_k(queries, corpus, k))
    used = corpus.join(best.select("doc_id"), "doc_id", "left_semi")
    clean = R.redact(used.select("doc_id", "source", "title", "content"), ["content"])
    found = best.join(clean, "doc_id")
    return context.doc_block(
        found,
        R.merged_counts(F.col("redactions")).alias("doc_redactions"),
        F.min_by("title", "rank").alias("top_title"),
        F.max("similarity").alias("top_similarity"),
    )


def prompts(
    hosts: DataFrame,
    predictions: DataFrame,
    files: DataFrame,
    corpus: DataFrame,
    query_vectors: DataFrame,
    as_of: datetime,
) -> DataFrame:
    """CTX3. One prompt per triggered host, ready for batch inference.

    ``query_vectors`` holds host_id, query_id and embedding: the vector of the
    host's query text. Hosts with the same query share one search. Queries of
    other hosts are dropped before any ranking, and only documents that were
    found and files that are listed are redacted.
    """
    rows = triggered_context(hosts, predictions).withColumn("query_text", context.query_text())
    rows = cut_lineage(rows)
    asking = rows.select("host_id")
    asked = query_vectors.join(asking, "host_id", "left_semi")
    wanted = asked.select("host_id", "query_id")
    searched = asked.groupBy("query_id").agg(F.any_value("embedding").alias("embedding"))
    docs = redacted_docs(searched, corpus)
    listing = redacted_listing(files, as_of, asking)
    joined = (
        rows.join(listing, "host_id", "left")
        .join(wanted, "host_id", "left")
        .join(docs, "query_id", "left")
    )
    return joined.withColumn("doc_count", F.coalesce("doc_count", F.lit(0))).withColumn(
        "prompt", context.prompt()
    )


def tool_calls() -> Column:
    """Audit entries of the two evidence reads."""
    null = F.lit(None).cast("string")
    files = F.struct(
        F.lit("list_files").alias("tool"),
        F.create_map(F.lit("host_id"), F.col("host_id"), F.lit("path"), F.col("monitored_path")).alias("args"),
        F.when(
            F.col("n_files") > 0,
            F.concat(
                F.col("n_files").cast("string"), F.lit(" files; largest = "),
                F.format_number("largest", 0), F.lit(" bytes"),
            ),
        ).otherwise("no files").alias("output_summary"),
        null.alias("error"),
    )
    docs = F.struct(
        F.lit("search_runbooks").alias("tool"),
        F.create_map(
            F.lit("query"), F.col("query_text"), F.lit("top_k"), F.lit(str(context.CONTEXT_DOCS))
        ).alias("args"),
        F.when(
            F.col("doc_count") > 0,
            F.concat(
                F.col("doc_count").cast("string"), F.lit(" docs retrieved; top: '"), F.col("top_title"),
                F.lit("' ("), fixed(F.col("top_similarity"), 2), F.lit(")"),
            ),
        ).otherwise("no docs").alias("output_summary"),
        null.alias("error"),
    )
    return F.array(files, docs)


@dataclass
class Triage:
    decided: DataFrame  # parsed answer, score, route and rationale per run
    plan: DataFrame  # clean-up plan of the runs that execute, with their run_id
    runs: DataFrame  # audit rows, linked to their tickets; with recommendation and redactions by category
    tickets: DataFrame  # new tickets


def reason(contexts: DataFrame, answers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """PRS1, DEC1-DEC8. Decision per triggered host, without side effects.

    A host without an answer counts as an answer that could not be parsed.
    """
    raw = answers.select("prediction_id", "raw")
    joined = contexts.join(raw, "prediction_id", "left").withColumn("raw", F.coalesce("raw", F.lit("")))
    return decision.decide(context.parse_answers(joined), settings)


def resolve(
    decided: DataFrame,
    files: DataFrame,
    hosts: DataFrame,
    as_of: datetime,
    files_as_of: datetime | None = None,
    existing_tickets: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> Triage:
    """DEC9-DEC11, CLN4, TKT3, SNK5, SNK6, RED16 for all decided hosts at once."""
    # The evidence texts have served their purpose; they are not stored again.
    decided = decided.drop("prompt", "doc_context", "file_listing", "raw")
    decided = cut_lineage(decided.withColumn("run_id", short_id("run-", F.col("host_id"), F.col("prediction_id"))))
    acting = decided.where(decision.runs_cleanup()).select("host_id", "run_id")
    # Few hosts with a clean-up are broadcast, and files of others not shuffled.
    owners = lookup(hosts.join(acting, "host_id", "left_semi"))
    plan = cleanup.cleanup_plan(files, owners, files_as_of or as_of, settings)
    plan = cut_lineage(plan.join(acting, "host_id"))
    outcome = cleanup.plan_totals(plan).select("host_id", "bytes_freed", "files_deleted")
    moment = F.lit(as_of)
    audit = (
        decided.join(outcome, "host_id", "left")
        .withColumn("bytes_freed", F.coalesce("bytes_freed", F.lit(0)))
        .withColumn("files_deleted", F.coalesce("files_deleted", F.lit(0)))
        .withColumn("verdict", decision.verdict(F.col("files_deleted")))
        .withColumn("redactions", R.added_counts(F.col("file_redactions"), F.col("doc_redactions")))
        .withColumns({"started_at": moment, "finished_at": moment})
        .withColumn("tool_calls", tool_calls())
        .withColumns({"ticket_id": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    )
    filed = cut_lineage(tickets.create_tickets(audit, existing_tickets))
    kept = [*(field.name for field in RUNS), "recommendation", "redactions"]
    runs = link_tickets(audit.select(*kept), filed)
    return Triage(decided, plan, runs, filed)
