"""Times the headline queries and prints one JSON line.

Folder from ``BENCH_SF_DIR``, cores from ``BENCH_CPUS``. Every query runs once
over its whole tables, after two small queries that start the session and its
Python workers; results go to the ``noop`` sink. Queries with their own sinks
include those writes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brimwatch.config import Settings  # noqa: E402
from brimwatch.operators import anomaly  # noqa: E402
from brimwatch.plans.cycle import run_cycle  # noqa: E402
from brimwatch.plans.registered import ENTRIES, models  # noqa: E402
from brimwatch.session import fresh_dir, local_session  # noqa: E402
from brimwatch.sources import sample  # noqa: E402

HEADLINE = (
    "trigger_at_risk",
    "agg_features",
    "forecast_seasonal",
    "forecast_piecewise",
    "cycle_fleet",
    "anomaly_train",
    "fleet_overview",
    "latest_telemetry",
    "agg_hourly_rollup",
    "gap_fill_forward",
    "join_as_of",
    "redact_documents",
    "retrieve_top_k",
    "context_prompts",
    "parse_answers",
    "decision_route",
    "cleanup_plan",
    "ticket_create",
    "triage_runs",
    "sink_insert_ignore",
    "stream_ingest",
    "stream_tumbling",
)


def cycle_scoring(spark, folder: str) -> float:
    """One scoring cycle with a model trained before, as in regular operation."""
    model = anomaly.train(models.labelled(spark, folder)).model
    path = fresh_dir(spark, "predictions")
    begin = time.perf_counter()
    run_cycle(
        sample.telemetry(spark, folder, one_device=True), sample.as_of(spark, folder), model, path,
        Settings(history_days=30),
    )
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cores, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    ENTRIES["src_host_inventory"].run(spark, folder).write.format("noop").mode("overwrite").save()
    spark.range(64).repartition(int(cores)).mapInPandas(lambda rows: rows, "id long").count()
    taken: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        begin = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - begin, 3)
        print(name, taken[name], file=sys.stderr, flush=True)
    if not only or "cycle_scoring" in only:
        taken["cycle_scoring"] = cycle_scoring(spark, folder)
        print("cycle_scoring", taken["cycle_scoring"], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
