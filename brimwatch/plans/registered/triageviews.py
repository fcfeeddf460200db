from __future__ import annotations

from pyspark.sql import functions as F

from brimwatch.operators import cleanup, context, decision, tickets
from brimwatch.operators.skew import skew_join
from brimwatch.functions.redact import CATEGORIES
from brimwatch.plans import outcome as outcome_of
from brimwatch.plans import triage
from brimwatch.plans.registered.base import r6, register, stamp
from brimwatch.plans.registered.texts import TOP_SQL, counts_sql, counts_text, host_queries
from brimwatch.plans.sqlviews import hid, q_redaction, r6 as q6, stamp as qstamp, with_views
from brimwatch.session import fresh_dir
from brimwatch.sources import sample as V
from brimwatch.sources.sinks import link_tickets


def decision_input(spark, d):
    """Every prediction with its parsed answer and its host; 0 to 5 grounding documents."""
    scored = V.predictions(spark, d).drop("model_version", "device", "triggered_agent")
    answers = context.parse_answers(V.model_outputs(spark, d)).drop("raw", "host_id")
    owners = V.hosts(spark, d).select("host_id", "environment", "role", "monitored_path")
    joined = skew_join(
        scored.join(answers, "prediction_id"), owners, ["host_id"], spread=["prediction_id"]
    )
    return joined.withColumn(
        "doc_count", F.split_part("prediction_id", F.lit("-"), F.lit(2)).cast("long") % 6
    )


def decided(spark, d):
    return decision.decide(decision_input(spark, d))


_LINES = """concat_ws(chr(10),
  'LLM self-confidence ' || format('{:.2f}', self_confidence) || ' → +' || format('{:.2f}', c_self),
  CASE recommendation WHEN 'clean' THEN 'forecast alignment ' WHEN 'escalate_anomaly' THEN 'anomaly alignment ' ELSE 'signals quiet ' END
    || format('{:.2f}', c_signal) || ' → +' || format('{:.2f}', c_ml),
  'RAG grounding (' || doc_count || ' docs) → +' || format('{:.2f}', c_docs),
  'environment=' || environment || ' → +' || format('{:.2f}', c_env),
  CASE WHEN recommendation = 'clean' AND anomaly_score > 0.6::DOUBLE THEN
    'OVERRIDE: anomaly score above 0.6, score held at 0.74 or less' END,
  CASE WHEN recommendation = 'escalate_anomaly' THEN 'escalate_anomaly → minimum chat routing' END,
  'final=' || format('{:.3f}', score) || ' → ' || decision)"""


@register(
    "decision_route",
    with_views(
        "decided",
        f"SELECT prediction_id, host_id, recommendation, confidence_score, decision, {_LINES} AS rationale FROM decided",
    ),
)
def route(spark, d):
    """DEC1-DEC8."""
    return decided(spark, d).select(
        "prediction_id", "host_id", "recommendation", "confidence_score", "decision",
        F.array_join("rationale", "\n").alias("rationale"),
    )


@register(
    "decision_outcome",
    with_views(
        "decided",
        """SELECT prediction_id, executes, files_deleted, verdict, verdict = 'escalated_anomaly' OR decision = 'ticket_only' AS needs_ticket
           FROM (SELECT *, CASE WHEN recommendation = 'escalate_anomaly' THEN 'escalated_anomaly' WHEN files_deleted > 0 THEN 'cleaned'
                   ELSE 'no_action_needed' END AS verdict
                 FROM (SELECT *, decision = 'auto_remediate' AND recommendation = 'clean' AS executes,
                         CASE WHEN decision = 'auto_remediate' AND recommendation = 'clean' THEN doc_count ELSE 0 END AS files_deleted FROM decided))""",
    ),
)
def outcome(spark, d):
    """DEC9, DEC10, DEC11; the grounding count stands in for deleted files."""
    rows = decided(spark, d).withColumn("executes", decision.runs_cleanup())
    rows = rows.withColumn("files_deleted", F.when(F.col("executes"), F.col("doc_count")).otherwise(0))
    rows = rows.withColumn("verdict", decision.verdict(F.col("files_deleted")))
    return rows.select(
        "prediction_id", "executes", "files_deleted", "verdict", decision.needs_ticket().alias("needs_ticket")
    )


@register(
    "decision_summary",
    with_views(
        "runs tickets",
        """SELECT r.run_id, CASE
             WHEN decision = 'auto_remediate' AND verdict = 'cleaned' THEN 'Cleaned up automatically: ' || files_deleted || ' files deleted, '
               || format('{:.2f}', bytes_freed / 1073741824.0::DOUBLE) || ' GB freed.'
             WHEN decision = 'auto_remediate' AND verdict = 'escalated_anomaly' THEN
               'Filed a ticket instead of cleaning: the growth is anomalous.' || coalesce(' Ticket: ' || t.ticket_id || '.', '')
             WHEN decision = 'auto_remediate' THEN 'Nothing to do: no actionable signal.'
             WHEN decision = 'chat_approval' THEN 'Waiting for human approval in chat.'
             ELSE 'Ticket only: confidence below the automatic limit.' || coalesce(' Ticket: ' || t.ticket_id || '.', '') END AS summary
           FROM runs r LEFT JOIN tickets t ON t.agent_run_id = r.run_id""",
    ),
)
def summary(spark, d):
    """DEC12, SNK6."""
    linked = link_tickets(V.runs(spark, d), V.tickets(spark, d))
    return linked.select("run_id", decision.plain_summary().alias("summary"))


def audit_rows(spark, d):
    """Sample runs with their host and prediction: the input of ticket creation."""
    scored = V.predictions(spark, d).drop("ts", "host_id", "device", "model_version", "triggered_agent")
    owners = V.hosts(spark, d).select("host_id", "role", "environment", "monitored_path")
    return skew_join(
        V.runs(spark, d).join(scored, "prediction_id"), owners, ["host_id"], spread=["run_id"]
    )


AUDIT_SQL = """audit AS (
  SELECT r.*, p.anomaly_score, p.forecast_1d_pct, p.forecast_3d_pct, p.forecast_7d_pct, p.forecast_14d_pct, p.hours_to_90pct,
    h.role, h.environment, h.monitored_path
  FROM runs r JOIN predictions p USING (prediction_id) JOIN hosts h ON r.host_id = h.host_id),
  classed AS (
    SELECT *, CASE WHEN verdict = 'escalated_anomaly' OR coalesce(hours_to_90pct < 24, false) THEN 'P2' ELSE 'P3' END AS severity,
      CASE WHEN verdict = 'escalated_anomaly' THEN 'App-Support-' || role ELSE 'Infra-Capacity' END AS assignment_group,
      CASE WHEN verdict = 'escalated_anomaly' THEN 'Anomalous disk growth on ' || host_id || ' — investigate upstream'
        WHEN coalesce(hours_to_90pct < 24, false) THEN 'Disk projected to breach 90% within 24h on ' || host_id
        WHEN decision = 'ticket_only' THEN 'Predictive disk-fill warning for ' || host_id
        ELSE 'Capacity review for ' || host_id END AS short_description
    FROM audit)"""


@register(
    "ticket_classify",
    with_views("runs predictions hosts", "SELECT run_id, severity, assignment_group, short_description FROM classed", AUDIT_SQL),
)
def classify(spark, d):
    """TKT1."""
    columns = [column.alias(name) for name, column in tickets.classify().items()]
    return audit_rows(spark, d).select("run_id", *columns)


def _pct(name: str) -> str:
    return f"coalesce(format('{{:.1f}}', {name}) || '%', 'n/a')"


@register(
    "ticket_describe",
    with_views(
        "runs predictions hosts",
        f"""SELECT run_id, concat_ws(chr(10), 'Auto-generated by predictive disk management.', '', 'AFFECTED CI',
              '  host_id:        ' || host_id, '  role:           ' || role, '  environment:    ' || environment,
              '  monitored_path: ' || monitored_path, '', 'ML SIGNALS',
              '  forecast 1d: ' || {_pct('forecast_1d_pct')}, '  forecast 3d: ' || {_pct('forecast_3d_pct')},
              '  forecast 7d: ' || {_pct('forecast_7d_pct')}, '  forecast 14d: ' || {_pct('forecast_14d_pct')},
              '  hours to 90%: ' || coalesce(CAST(hours_to_90pct AS VARCHAR), 'n/a'),
              '  anomaly score: ' || format('{{:.3f}}', anomaly_score), '', 'AGENT VERDICT', '  decision: ' || decision,
              '  verdict:  ' || verdict, '  confidence_score: ' || CAST(confidence_score AS VARCHAR), '  agent_run_id:     ' || run_id,
              '', 'REASONING', reasoning, '') AS description
            FROM classed""",
        AUDIT_SQL,
    ),
)
def describe(spark, d):
    """TKT2, SC18."""
    return audit_rows(spark, d).select("run_id", tickets.describe().alias("description"))


@register(
    "ticket_create",
    with_views(
        "runs predictions hosts tickets",
        f"""SELECT prefix || CASE WHEN number < 1000 THEN lpad(CAST(number AS VARCHAR), 4, '0') ELSE CAST(number AS VARCHAR) END AS ticket_id,
              run_id AS agent_run_id, host_id, {qstamp('finished_at')} AS created_at, 'new' AS status, severity, assignment_group
            FROM (
              SELECT c.*, prefix, coalesce(last_number, 0) + row_number() OVER (PARTITION BY prefix ORDER BY finished_at, run_id) AS number
              FROM (SELECT *, strftime(finished_at, 'INC-%Y-%m-') AS prefix FROM classed
                    WHERE verdict = 'escalated_anomaly' OR decision = 'ticket_only') c LEFT JOIN used USING (prefix))""",
        AUDIT_SQL
        + """, used AS (SELECT substr(ticket_id, 1, 12) AS prefix, max(CAST(split_part(ticket_id, '-', 4) AS INTEGER)) AS last_number
             FROM tickets GROUP BY 1)""",
    ),
)
def create(spark, d):
    """TKT3, WIN7, SC5: numbers continue after the stored tickets of the month."""
    made = tickets.create_tickets(audit_rows(spark, d), V.tickets(spark, d))
    return made.select(
        "ticket_id", "agent_run_id", "host_id", stamp("created_at").alias("created_at"),
        "status", "severity", "assignment_group",
    )


@register(
    "ticket_approvals",
    with_views(
        "runs",
        """SELECT r.run_id, host_id, confidence_score, CASE WHEN approved IS NULL THEN 'pending' WHEN approved AND can_clean THEN 'cleanup'
             WHEN approved THEN 'ticket_p2' ELSE 'ticket_p3' END AS outcome
           FROM runs r LEFT JOIN approvals USING (run_id) WHERE decision = 'chat_approval'""",
        """approvals AS (SELECT 'run-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS run_id, o_orderpriority <= '2-HIGH' AS approved,
             o_totalprice > 200000 AS can_clean FROM orders WHERE o_orderstatus <> 'O')""",
    ),
)
def approvals(spark, d):
    """TKT4."""
    return tickets.resolve_approvals(V.runs(spark, d), _answers(spark, d))


def _answers(spark, d):
    return (
        V.read(spark, d, "orders")
        .where("o_orderstatus <> 'O'")
        .select(
            F.concat(F.lit("run-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("run_id"),
            (F.col("o_orderpriority") <= "2-HIGH").alias("approved"),
            (F.col("o_totalprice") > 200000).alias("can_clean"),
        )
    )


@register(
    "cleanup_candidates",
    with_views("cleanup_candidates", f"SELECT host_id, path, rule_no, size_bytes, {q6('age_days')} AS age_days FROM cleanup_candidates"),
)
def candidates(spark, d):
    """CLN2, WIN5, SC7-SC9, SET2."""
    rows = cleanup.candidates(V.files(spark, d), V.hosts(spark, d), V.files_as_of(spark, d))
    return rows.select("host_id", "path", "rule_no", "size_bytes", r6("age_days").alias("age_days"))


@register(
    "cleanup_plan",
    with_views("cleanup_plan", "SELECT host_id, path, rule_no, size_bytes, action FROM cleanup_plan"),
)
def plan(spark, d):
    """CLN3, CLN4, WIN6."""
    rows = cleanup.cleanup_plan(V.files(spark, d), V.hosts(spark, d), V.files_as_of(spark, d))
    return rows.select("host_id", "path", "rule_no", "size_bytes", "action")


TRIAGE_SQL = """acting AS (
    SELECT p.host_id, CAST(coalesce(sum(size_bytes) FILTER (WHERE action = 'delete'), 0) AS BIGINT) AS bytes_freed,
      CAST(count(*) FILTER (WHERE action = 'delete') AS INTEGER) AS files_deleted
    FROM cleanup_plan p JOIN triage_decided t ON p.host_id = t.host_id AND decision = 'auto_remediate' AND recommendation = 'clean'
    GROUP BY p.host_id),
  judged AS (
    SELECT 'run-' || substr(sha256(t.host_id || '|' || prediction_id), 1, 12) AS run_id, t.host_id, prediction_id, confidence_score,
      decision, coalesce(bytes_freed, 0) AS bytes_freed, coalesce(files_deleted, 0) AS files_deleted,
      CASE WHEN recommendation = 'escalate_anomaly' THEN 'escalated_anomaly' WHEN coalesce(files_deleted, 0) > 0 THEN 'cleaned'
        ELSE 'no_action_needed' END AS verdict, reasoning
    FROM triage_decided t LEFT JOIN acting a ON a.host_id = t.host_id),
  filed AS (
    SELECT run_id, strftime(now, 'INC-%Y-%m-') || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS ticket_id
    FROM (SELECT run_id, now, row_number() OVER (ORDER BY run_id)
            + coalesce((SELECT max(CAST(split_part(ticket_id, '-', 4) AS INTEGER)) FROM tickets
                        WHERE starts_with(ticket_id, strftime(now, 'INC-%Y-%m-'))), 0) AS n
          FROM judged, files_now WHERE verdict = 'escalated_anomaly' OR decision = 'ticket_only'))"""


@register(
    "triage_runs",
    with_views(
        "triage_decided cleanup_plan tickets files_now",
        """SELECT run_id, host_id, prediction_id, confidence_score, decision, verdict, bytes_freed, files_deleted, ticket_id, reasoning
           FROM judged LEFT JOIN filed USING (run_id)""",
        TRIAGE_SQL,
    ),
)
def triage_runs(spark, d):
    """The whole triage of all triggered hosts, down to audit rows linked to tickets."""
    return _triaged(spark, d).runs.select(
        "run_id", "host_id", "prediction_id", "confidence_score", "decision", "verdict", "bytes_freed",
        "files_deleted", "ticket_id", "reasoning",
    )


def _triaged(spark, d):
    now = V.files_as_of(spark, d)
    contexts = triage.prompts(
        V.hosts(spark, d), V.predictions(spark, d), V.files(spark, d), V.corpus(spark, d),
        host_queries(spark, d), now,
    )
    decided_rows = triage.reason(contexts, V.model_outputs(spark, d))
    return triage.resolve(
        decided_rows, V.files(spark, d), V.hosts(spark, d), now, existing_tickets=V.tickets(spark, d)
    )


def _stored(spark, d):
    """The triage stored three times: twice under one name, and once more under another."""
    path = fresh_dir(spark, "triage")
    result = _triaged(spark, d)
    for commit in ("first", "first", "again"):
        outcome_of.store(result, path, commit)
    return path


@register(
    "triage_tickets",
    with_views(
        "triage_decided cleanup_plan tickets files_now",
        """SELECT ticket_id, agent_run_id, host_id, severity, bytes_planned FROM (
             SELECT f.ticket_id, j.run_id AS agent_run_id, j.host_id,
               CASE WHEN verdict = 'escalated_anomaly' OR coalesce(hours_to_90pct < 24, false) THEN 'P2' ELSE 'P3' END AS severity,
               0::BIGINT AS bytes_planned
             FROM filed f JOIN judged j USING (run_id) JOIN triage_decided t ON t.host_id = j.host_id
             UNION ALL SELECT NULL, run_id, host_id, NULL, bytes_freed FROM judged WHERE bytes_freed > 0)""",
        TRIAGE_SQL,
    ),
)
def triage_tickets(spark, d):
    """SNK5, SNK6, TKT3: tickets and planned bytes per run, read from what was stored; repeats added nothing."""
    path = _stored(spark, d)
    filed = outcome_of.read(spark, path, "tickets").select("ticket_id", "agent_run_id", "host_id", "severity")
    freed = (
        outcome_of.read(spark, path, "plans").where("action = 'delete'").groupBy("run_id", "host_id")
        .agg(F.sum("size_bytes").alias("bytes_planned")).where("bytes_planned > 0")
    )
    null = F.lit(None).cast("string")
    return filed.withColumn("bytes_planned", F.lit(0).cast("long")).unionByName(
        freed.select(
            null.alias("ticket_id"), F.col("run_id").alias("agent_run_id"), "host_id", null.alias("severity"), "bytes_planned"
        )
    )


_COUNTED = ", ".join(f"CAST(sum(n_{c}) AS BIGINT) AS n_{c}" for c in CATEGORIES)


@register(
    "triage_audit",
    with_views(
        "triage_decided corpus",
        """SELECT 'run-' || substr(sha256(t.host_id || '|' || prediction_id), 1, 12) AS run_id, recommendation, counts, summary
           FROM triage_decided t JOIN asked ON asked.host_id = t.host_id JOIN found ON found.query_id = asked.query_id""",
        TOP_SQL.strip()
        + ", "
        + q_redaction("(SELECT doc_id, content AS text FROM corpus)")
        + f""", sums AS (SELECT query_id, count(*) AS n, max(similarity) AS best, arg_min(title, rank) AS title, {_COUNTED}
            FROM top JOIN redacted ON redacted.doc_id = top.doc_id JOIN corpus ON corpus.doc_id = top.doc_id GROUP BY query_id),
          found AS (SELECT query_id, {counts_sql()} AS counts, n || ' docs retrieved; top: ' || chr(39) || title || chr(39) ||
              ' (' || format('{{:.2f}}', best) || ')' AS summary FROM sums),
          asked AS (SELECT {hid('c_custkey')} AS host_id, c_custkey % (SELECT count(*) FROM embeddings) AS query_id FROM customer)""",
    ),
)
def triage_audit(spark, d):
    """SNK5, RED16: what was redacted for each stored run, and its search entry. Sample paths hold nothing to redact."""
    runs = outcome_of.read(spark, _stored(spark, d), "runs")
    search = F.filter("tool_calls", lambda c: c["tool"] == "search_runbooks")[0]["output_summary"]
    return runs.select("run_id", "recommendation", counts_text().alias("counts"), search.alias("summary"))


@register(
    "ticket_approved",
    with_views(
        "runs predictions hosts tickets",
        """SELECT prefix || CASE WHEN number < 1000 THEN lpad(CAST(number AS VARCHAR), 4, '0') ELSE CAST(number AS VARCHAR) END AS ticket_id,
              run_id AS agent_run_id, host_id, CASE WHEN approved THEN 'P2' ELSE 'P3' END AS severity
            FROM (
              SELECT c.*, prefix, coalesce(last_number, 0) + row_number() OVER (PARTITION BY prefix ORDER BY finished_at, run_id) AS number
              FROM (SELECT *, strftime(finished_at, 'INC-%Y-%m-') AS prefix FROM classed
                    JOIN answered USING (run_id) WHERE decision = 'chat_approval' AND NOT (approved AND can_clean)) c
              LEFT JOIN used USING (prefix))""",
        AUDIT_SQL
        + """, used AS (SELECT substr(ticket_id, 1, 12) AS prefix, max(CAST(split_part(ticket_id, '-', 4) AS INTEGER)) AS last_number
             FROM tickets GROUP BY 1),
           answered AS (SELECT 'run-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS run_id, o_orderpriority <= '2-HIGH' AS approved,
             o_totalprice > 200000 AS can_clean FROM orders WHERE o_orderstatus <> 'O')""",
    ),
)
def approved(spark, d):
    """TKT4: answered runs that ask for a ticket get one, numbered after the stored ones."""
    outcomes = tickets.resolve_approvals(V.runs(spark, d), _answers(spark, d))
    made = tickets.approved_tickets(audit_rows(spark, d), outcomes, V.tickets(spark, d))
    return made.select("ticket_id", "agent_run_id", "host_id", "severity")
