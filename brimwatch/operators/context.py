"""Evidence text per host and parsing of model answers (RET2, CTX1-CTX3, PRS1)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimwatch.functions import scalar as S
from brimwatch.operators.skew import top_per_key
from brimwatch.schemas import RECOMMENDATIONS

# List limits and the name left out of file listings.
LISTED_FILES = 50
SHOWN_FILES = 30
CONTEXT_DOCS = 4
EXCLUDED_FILE = "_seed_baseline.bin"


def largest_files(files: DataFrame, as_of: datetime, k: int = LISTED_FILES) -> DataFrame:
    """SRC8, SRT2. Largest files per host with age and live-log flag."""
    rows = files.where(S.basename(F.col("path")) != EXCLUDED_FILE).withColumn(
        "age_days", S.age_days(F.lit(as_of), F.col("mtime"))
    )
    top = top_per_key(rows, ["host_id"], [F.col("size_bytes").desc(), F.col("path")], k)
    return top.withColumn("is_active_log", S.is_active_log(F.col("path"), F.col("age_days")))


def query_text() -> Column:
    """RET2. Search text of a host; growth counts as anomalous strictly above 0.5."""
    topic = F.when(F.col("anomaly_score") > 0.5, "anomalous log growth").otherwise("disk cleanup")
    return F.concat_ws(" ", "os", "role", F.lit("server"), topic, "monitored_path")


def file_listing(listed: DataFrame, *extra: Column) -> DataFrame:
    """CTX1. One text per host from its ranked files (at most ``LISTED_FILES``).

    ``extra`` are further aggregates of the same pass.
    """
    tab = F.lit("\t")
    line = F.concat(
        F.col("size_bytes").cast("string"), tab, S.fixed(F.col("age_days"), 1), tab,
        F.when(F.col("is_active_log"), "yes").otherwise("no"), tab, F.col("path"),
    )
    gathered = (
        listed.withColumn("line", line)
        .groupBy("host_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("_rows"), *extra)
    )
    total = F.size("_rows")
    shown = F.transform(F.slice("_rows", 1, SHOWN_FILES), lambda row: row["line"])
    more = F.concat(
        F.lit("\n... and "), (total - SHOWN_FILES).cast("string"), F.lit(" more (truncated)")
    )
    return gathered.select(
        *[name for name in gathered.columns if name != "_rows"],
        total.alias("n_files"),
        F.concat(
            F.lit("size_bytes\tage_days\tis_active\tpath\n"),
            F.array_join(shown, "\n"),
            F.when(total > SHOWN_FILES, more).otherwise(""),
        ).alias("file_listing"),
    )


def doc_block(found: DataFrame, *extra: Column, key: str = "query_id") -> DataFrame:
    """CTX2. One text per query from its ranked documents (at most ``CONTEXT_DOCS``).

    ``extra`` are further aggregates of the same pass.
    """
    entry = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"),
        F.lit(" (source="), F.col("source"), F.lit(", similarity="),
        S.fixed(F.col("similarity"), 2), F.lit(")\n"), F.col("content"),
    )
    gathered = (
        found.withColumn("entry", entry)
        .groupBy(key)
        .agg(
            # Apart, so that a plan without the text does not gather it.
            F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("_ids"),
            F.sort_array(F.collect_list(F.struct("rank", "entry"))).alias("_texts"),
            *extra,
        )
    )
    return gathered.select(
        *[name for name in gathered.columns if name not in ("_ids", "_texts")],
        F.size("_ids").alias("doc_count"),
        F.transform("_ids", lambda row: row["doc_id"]).alias("doc_ids"),
        F.array_join(F.transform("_texts", lambda row: row["entry"]), "\n\n").alias("doc_context"),
    )


NO_FILES = "(nothing below this path)"
NO_DOCS = "(no document is close to this case)"

# Fields of the prompt, under the names they have in the tables.
_HOST_FIELDS = (
    "host_id", "hostname", "role", "environment", "os", "monitored_path", "total_disk_gb",
)
_FORECAST_FIELDS = (
    "forecast_1d_pct", "forecast_3d_pct", "forecast_7d_pct", "forecast_14d_pct",
    "hours_to_90pct", "triggered_agent",
)


def _labelled(label: str, width: int, text: Column) -> Column:
    return F.concat(F.lit(f"\n  {label + ':':<{width}} "), text)


def prompt() -> Column:
    """CTX3. Full prompt text of one host from its metadata, prediction and evidence."""
    trigger = F.when(F.col("triggered_agent"), "True").when(~F.col("triggered_agent"), "False")
    fields = {name: S.shown(F.col(name)) for name in _FORECAST_FIELDS}
    fields["triggered_agent"] = F.coalesce(trigger, F.lit("None"))
    return F.concat(
        F.lit("Host"),
        *[_labelled(name, 15, S.shown(F.col(name))) for name in _HOST_FIELDS],
        F.lit("\n\nNewest prediction"),
        _labelled("anomaly_score", 17, S.fixed(F.col("anomaly_score"), 3)),
        *[_labelled(name, 17, text) for name, text in fields.items()],
        F.lit("\n\nLargest files below "), S.shown(F.col("monitored_path")), F.lit("\n"),
        F.coalesce("file_listing", F.lit(NO_FILES)),
        F.lit("\n\nNearest documents and earlier cases\n"),
        F.coalesce("doc_context", F.lit(NO_DOCS)),
        F.lit("\n\nAnswer with one JSON object in the agreed form and nothing besides."),
    )


def parse_answers(df: DataFrame, column: str = "raw") -> DataFrame:
    """PRS1, SC11. Recommendation, confidence, rationale and evidence of raw answers.

    The JSON text reaches from the first ``{`` to the last ``}``. Text without
    one valid object counts as no_action with confidence 0; a missing confidence
    is 0.5; unknown recommendations become no_action; confidence ends in 0..1.
    """
    kept = df.columns
    raw = F.col(column)
    start = F.instr(raw, "{")
    stop = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    block = F.when(
        (start > 0) & (F.instr(raw, "}") > 0) & (stop > start),
        F.substring(raw, start, stop - start + 1),
    )
    # As the only element of an array, text behind the object is an error too.
    # Strict JSON: what a lenient reader would accept must not end in deletions.
    strict = {"allowSingleQuotes": "false"}
    parsed = F.from_json(F.concat(F.lit("["), block, F.lit("]")), "array<map<string,string>>", strict)
    rows = df.withColumn("_parsed", parsed).withColumn(
        "_fields", F.when(F.size("_parsed") == 1, F.col("_parsed")[0])
    )
    field = lambda name: F.try_element_at(F.col("_fields"), F.lit(name))
    given = F.map_contains_key("_fields", "self_confidence")
    told = field("self_confidence")
    # Booleans count as 1 and 0; "0.9f" and the like are not numbers.
    read = (
        F.when(told.isin("true", "false"), (told == "true").cast("double"))
        .when(told.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), told.try_cast("double"))
    )
    number = F.when(given, read).otherwise(0.5)
    valid = F.col("_fields").isNotNull() & number.isNotNull()
    known = field("recommendation").isin(list(RECOMMENDATIONS))
    evidence = F.from_json(field("key_evidence"), "array<string>")
    return rows.select(
        *kept,
        F.when(valid & known, field("recommendation")).otherwise("no_action").alias("recommendation"),
        F.when(valid, S.clip(number, 0.0, 1.0)).otherwise(0.0).alias("self_confidence"),
        F.when(valid, F.coalesce(field("rationale"), F.lit("")))
        .otherwise("answer could not be parsed")
        .alias("reasoning"),
        F.when(valid, F.coalesce(evidence, F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>"))
        .alias("key_evidence"),
        valid.alias("parsed"),
    )
