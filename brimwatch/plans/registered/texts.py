from __future__ import annotations

from pyspark.sql import functions as F

from brimwatch.functions import redact as R
from brimwatch.operators import context, retrieve
from brimwatch.operators.fleet import run_context
from brimwatch.plans import triage
from brimwatch.plans.registered.base import r6, register
from brimwatch.plans.registered.scans import _LISTED as LISTED_SQL
from brimwatch.plans.sqlviews import hid, q_redaction, r6 as q6, with_views
from brimwatch.sources import sample as V

_COUNT_SUM = " + ".join(f"n_{name}" for name in R.CATEGORIES)


def counts_text(column: str = "redactions"):
    """``CATEGORY=count`` pairs in category order."""
    pairs = F.transform(
        F.sort_array(F.map_entries(column)),
        lambda entry: F.concat_ws("=", entry["key"], entry["value"].cast("string")),
    )
    return F.array_join(pairs, ",")


def counts_sql(prefix: str = "n_") -> str:
    parts = ", ".join(
        f"CASE WHEN {prefix}{name} > 0 THEN '{name}=' || {prefix}{name} END" for name in sorted(R.CATEGORIES)
    )
    return f"concat_ws(',', {parts})"


@register(
    "redact_documents",
    with_views("planted", f"SELECT doc_id, text, {counts_sql()} AS counts FROM redacted", q_redaction("planted")),
)
def redact_documents(spark, d):
    """RED1-RED14 over whole documents."""
    rows = R.redact(V.redaction_corpus(spark, d), ["text"])
    return rows.select("doc_id", "text", counts_text().alias("counts"))


@register(
    "redact_records",
    with_views(
        "",
        f"""SELECT conv_id, turn, role, text, CAST({_COUNT_SUM} AS BIGINT) AS hits FROM conversations c
            JOIN redacted r ON r.key = c.conv_id * 100000 + c.turn""".replace("text, CAST", "r.text, CAST"),
        "keyed AS (SELECT conv_id * 100000 + turn AS key, text FROM conversations), " + q_redaction("keyed", "key"),
    ),
)
def redact_records(spark, d):
    """RED15: all string columns of a record, other columns untouched."""
    rows = R.redact(V.wide(V.read(spark, d, "conversations")))
    return rows.select(
        "conv_id", "turn", "role", "text", R.total_redactions(F.col("redactions")).cast("long").alias("hits")
    )


@register(
    "redact_pages",
    with_views(
        "",
        f"SELECT page_id, text, {counts_sql()} AS counts FROM redacted",
        "source AS (SELECT page_id, html AS text FROM pages), " + q_redaction("source", "page_id"),
    ),
)
def redact_pages(spark, d):
    """RED1-RED14 over whole raw pages, as one expression without counters for the text."""
    rows = V.wide(V.read(spark, d, "pages").select("page_id", F.col("html").alias("text")))
    counted = R.redact(rows, ["text"]).select("page_id", counts_text().alias("counts"))
    return rows.select("page_id", R.redacted(F.col("text")).alias("text")).join(counted, "page_id")


@register(
    "parse_answers",
    with_views(
        "parsed",
        "SELECT prediction_id, recommendation, self_confidence, reasoning, evidence, parsed FROM parsed",
    ),
)
def parse_answers(spark, d):
    """PRS1, SC11."""
    rows = context.parse_answers(V.model_outputs(spark, d))
    return rows.select(
        "prediction_id", "recommendation", "self_confidence", "reasoning",
        F.array_join("key_evidence", "|").alias("evidence"), "parsed",
    )


TOP_SQL = """
  sims AS (
    SELECT q.vec_id AS query_id, c.doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), c.embedding) AS similarity
    FROM embeddings q, corpus c),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank
          FROM sims QUALIFY rank <= 4)"""


@register(
    "retrieve_top_k",
    with_views("corpus", f"SELECT query_id, doc_id, rank, {q6('similarity')} AS similarity FROM top", TOP_SQL.strip()),
)
def top_k(spark, d):
    """RET1, JN8, WIN8: the four nearest documents of every stored vector."""
    best = retrieve.cosine_top_k(V.query_vectors(spark, d), V.corpus(spark, d), 4)
    return best.select("query_id", "doc_id", "rank", r6("similarity").alias("similarity"))


@register(
    "retrieve_query_text",
    with_views(
        "hosts latest_prediction",
        """SELECT h.host_id, os || ' ' || role || ' server ' ||
             CASE WHEN anomaly_score > 0.5::DOUBLE THEN 'anomalous log growth' ELSE 'disk cleanup' END || ' ' || monitored_path AS query_text
           FROM hosts h JOIN latest_prediction p ON h.host_id = p.host_id""",
    ),
)
def query_text(spark, d):
    """RET2."""
    found, _ = run_context(V.hosts(spark, d), V.predictions(spark, d))
    return found.select("host_id", context.query_text().alias("query_text"))


LISTING_SQL = """
  listings AS (
    SELECT host_id, count(*) AS n_files,
      'size_bytes' || chr(9) || 'age_days' || chr(9) || 'is_active' || chr(9) || 'path' || chr(10) ||
      string_agg(line, chr(10) ORDER BY rank) FILTER (WHERE rank <= 30) ||
      CASE WHEN count(*) > 30 THEN chr(10) || '... and ' || (count(*) - 30) || ' more (truncated)' ELSE '' END AS file_listing
    FROM (SELECT host_id, rank, size_bytes || chr(9) || format('{:.1f}', age_days) || chr(9) ||
            CASE WHEN is_active_log THEN 'yes' ELSE 'no' END || chr(9) || path AS line FROM flagged)
    GROUP BY host_id)"""


@register(
    "context_file_listing",
    with_views("files files_now", "SELECT host_id, CAST(n_files AS INTEGER) AS n_files, file_listing FROM listings", LISTED_SQL.strip() + "," + LISTING_SQL),
)
def file_listing(spark, d):
    """CTX1, SRT2."""
    return context.file_listing(context.largest_files(V.files(spark, d), V.files_as_of(spark, d)))


DOCS_SQL = (
    TOP_SQL.strip()
    + ", "
    + q_redaction("(SELECT doc_id, content AS text FROM corpus)")
    + """,
  entries AS (
    SELECT query_id, rank, t.doc_id, '[' || rank || '] ' || title || ' (source=' || source || ', similarity=' ||
      format('{:.2f}', similarity) || ')' || chr(10) || r.text AS entry
    FROM top t JOIN corpus c ON t.doc_id = c.doc_id JOIN redacted r ON r.doc_id = t.doc_id),
  blocks AS (
    SELECT query_id, CAST(count(*) AS INTEGER) AS doc_count, string_agg(doc_id, ',' ORDER BY rank) AS doc_ids,
      string_agg(entry, chr(10) || chr(10) ORDER BY rank) AS doc_context FROM entries GROUP BY query_id)"""
)


@register(
    "context_documents",
    with_views("corpus", "SELECT query_id, doc_count, doc_ids, doc_context FROM blocks", DOCS_SQL),
)
def documents(spark, d):
    """CTX2, RED16."""
    rows = triage.redacted_docs(V.query_vectors(spark, d), V.corpus(spark, d))
    return rows.select("query_id", "doc_count", F.array_join("doc_ids", ",").alias("doc_ids"), "doc_context")


def host_queries(spark, d):
    """Each host asks with the vector whose number follows from its own."""
    vectors = V.query_vectors(spark, d)
    n = vectors.count()
    return (
        V.read(spark, d, "customer")
        .select(V.host_id("c_custkey").alias("host_id"), (F.col("c_custkey") % n).alias("query_id"))
        .join(vectors, "query_id")
    )


_HOST_FIELDS = "".join(
    f" || chr(10) || '  {name + ':':<15} ' || {value}"
    for name, value in {
        "host_id": "h.host_id", "hostname": "hostname", "role": "role", "environment": "environment",
        "os": "os", "monitored_path": "monitored_path", "total_disk_gb": "CAST(total_disk_gb AS VARCHAR)",
    }.items()
)
_FORECAST_FIELDS = "".join(
    f" || chr(10) || '  {name + ':':<17} ' || coalesce(CAST({name} AS VARCHAR), 'None')"
    for name in ("forecast_1d_pct", "forecast_3d_pct", "forecast_7d_pct", "forecast_14d_pct", "hours_to_90pct")
)


@register(
    "context_prompts",
    with_views(
        "hosts latest_prediction corpus files files_now",
        f"""SELECT h.host_id, prediction_id, coalesce(doc_count, 0) AS doc_count,
              'Host'{_HOST_FIELDS} || chr(10) || chr(10) || 'Newest prediction' ||
              chr(10) || '  anomaly_score:    ' || format('{{:.3f}}', anomaly_score){_FORECAST_FIELDS} ||
              chr(10) || '  triggered_agent:  ' || CASE WHEN triggered_agent THEN 'True' ELSE 'False' END ||
              chr(10) || chr(10) || 'Largest files below ' || monitored_path || chr(10) ||
              coalesce(file_listing, '(nothing below this path)') || chr(10) || chr(10) ||
              'Nearest documents and earlier cases' || chr(10) ||
              coalesce(doc_context, '(no document is close to this case)') || chr(10) || chr(10) ||
              'Answer with one JSON object in the agreed form and nothing besides.' AS prompt
            FROM hosts h JOIN latest_prediction p ON h.host_id = p.host_id AND p.triggered_agent
            JOIN asked a ON a.host_id = h.host_id
            LEFT JOIN listings l ON l.host_id = h.host_id LEFT JOIN blocks b ON b.query_id = a.query_id""",
        LISTED_SQL.strip() + "," + LISTING_SQL + ", " + DOCS_SQL
        + f", asked AS (SELECT {hid('c_custkey')} AS host_id, c_custkey % (SELECT count(*) FROM embeddings) AS query_id FROM customer)",
    ),
)
def prompts(spark, d):
    """CTX3 for every triggered host. Sample paths hold nothing to redact."""
    rows = triage.prompts(
        V.hosts(spark, d), V.predictions(spark, d), V.files(spark, d), V.corpus(spark, d),
        host_queries(spark, d), V.files_as_of(spark, d),
    )
    return rows.select("host_id", "prediction_id", "doc_count", "prompt")
