"""Streaming jobs over the same operators (ST1-ST5, EXT3).

Every job takes a streaming DataFrame and folders in the shared location.
``available_now`` drains what is there and stops; otherwise a job polls at the
given interval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brimwatch.functions.redact import redact
from brimwatch.operators.latest import latest_per
from brimwatch.operators.skew import skew_join
from brimwatch.sources.keyed import KeyedTable
from brimwatch.sources.sinks import insert_ignore

INTERVAL = "15 minutes"


def _trigger(writer, available_now: bool, interval: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def _each_batch(
    stream: DataFrame,
    work: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    available_now: bool,
    interval: str,
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return _trigger(writer.foreachBatch(work), available_now, interval).start()


def ingest(
    telemetry: DataFrame, table: str, checkpoint: str,
    available_now: bool = True, interval: str = INTERVAL,
) -> StreamingQuery:
    """ST1, ST5, SNK1. Idempotent ingest: each batch is compared with the stored days it touches.

    There is no state and no lateness bound: samples of any age are stored, once.
    """
    return _each_batch(
        telemetry, lambda batch, _: insert_ignore(batch, table), checkpoint, "append", available_now, interval
    )


def latest(
    telemetry: DataFrame, table: str, checkpoint: str,
    available_now: bool = True, interval: str = INTERVAL,
) -> StreamingQuery:
    """ST2. Running newest sample per host, merged into a table of one row per host; no state."""
    kept = ["host_id", "ts", "device", "in_use_pct", "used_bytes", "total_bytes"]

    def work(batch: DataFrame, number: int) -> None:
        newest = latest_per(batch.select(*kept), ["host_id"], "ts", ["device"])
        _latest_table(batch.sparkSession, table).merge(
            newest, lambda old, new: latest_per(old.unionByName(new), ["host_id"], "ts", ["device"]), checkpoint, number
        )

    return _each_batch(telemetry, work, checkpoint, "append", available_now, interval)


def _latest_table(spark: SparkSession, table: str) -> KeyedTable:
    return KeyedTable(spark, table, ["host_id"])


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """What ``latest`` keeps: one row per host."""
    return _latest_table(spark, table).read()


def _windows_table(spark: SparkSession, table: str) -> KeyedTable:
    return KeyedTable(spark, table, ["host_id", "window_start"])


def windows(
    telemetry: DataFrame, table: str, checkpoint: str, width: str = "1 hour",
    slide: str | None = None, available_now: bool = True, interval: str = INTERVAL,
) -> StreamingQuery:
    """EXT3. Tumbling or sliding roll-up per host.

    Sliding windows that are made of whole slides are stored as the sums of these slides; a
    sample then counts once and not once per window, and ``read_windows`` puts them together.
    Each batch is added to the stored sums it touches, so there is no state and
    late samples of any age count. The table keeps the last batch number of the
    stream (known by its checkpoint), so a batch that comes again adds nothing.
    """

    step = _micros(telemetry.sparkSession, slide) if slide else 0
    slots, rest = divmod(_micros(telemetry.sparkSession, width), step) if slide else (1, 0)
    whole = F.window("ts", slide) if slots > 1 and not rest else F.window("ts", width, slide)

    def work(batch: DataFrame, number: int) -> None:
        shares = batch.groupBy("host_id", whole.alias("w")).agg(
            F.count("*").alias("n"),
            F.count("in_use_pct").alias("n_pct"),
            F.sum("in_use_pct").alias("sum_pct"),
            F.max("in_use_pct").alias("max_pct"),
        )
        shares = shares.select(
            "host_id", F.col("w.start").alias("window_start"), "n", "n_pct", "sum_pct", "max_pct",
            F.lit(1 if rest else slots).cast("long").alias("slots"), F.lit(step).cast("long").alias("step"),
        )
        _windows_table(batch.sparkSession, table).merge(shares, _added, checkpoint, number)

    return _each_batch(telemetry, work, checkpoint, "append", available_now, interval)


def _micros(spark: SparkSession, interval: str) -> int:
    length = F.expr(f"INTERVAL '{interval.lower().removeprefix('interval').strip()}'")
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + length)).first()[0]


def _added(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("host_id", "window_start").agg(
        *(F.sum(name).alias(name) for name in ("n", "n_pct", "sum_pct")), F.max("max_pct").alias("max_pct"),
        *(F.max(name).alias(name) for name in ("slots", "step")),
    )


def read_windows(spark: SparkSession, table: str) -> DataFrame:
    """The windows of what ``windows`` keeps."""
    rows = _windows_table(spark, table).read()
    made = rows.select("slots", "step").first()
    if made and made["slots"] > 1:
        rows = _from_slides(rows, made["slots"], made["step"])
    return rows.select("host_id", "window_start", "n", F.try_divide("sum_pct", "n_pct").alias("mean_pct"), "max_pct")


def _from_slides(rows: DataFrame, slots: int, step: int) -> DataFrame:
    """Sums of all windows of ``slots`` slides of ``step`` microseconds that hold a row.

    Time is cut into blocks as long as a window. Windows that start in a block
    need the slides of it and of the next one, so each row goes to two blocks of
    its host, at most twice ``slots`` rows each, whose windows are summed there.
    """
    span, kind = slots * step, rows.schema["window_start"].dataType
    at = F.unix_micros(F.col("window_start").cast("timestamp"))
    block = at - F.pmod(at, F.lit(span))
    sent = rows.select(
        "host_id", F.explode(F.array(block, block - span)).alias("block"),
        F.struct(at.alias("at"), "n", "n_pct", "sum_pct", "max_pct").alias("slide"),
    )
    blocks = sent.groupBy("host_id", "block").agg(F.array_sort(F.collect_list("slide")).alias("slides"))

    def window(place):
        start = F.col("block") + place * F.lit(step)
        inside = F.filter("slides", lambda x: (x["at"] >= start) & (x["at"] < start + F.lit(span)))
        return F.struct(start.alias("start"), inside.alias("inside"))

    places = F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))
    windows = blocks.select("host_id", F.explode(F.transform(places, window)).alias("w")).where(F.size("w.inside") > 0)

    def total(name, zero):
        return F.aggregate("w.inside", zero, lambda s, x: s + F.coalesce(x[name], zero)).alias(name)

    none = F.lit(0).cast("long")
    return windows.select(
        "host_id", F.timestamp_micros("w.start").cast(kind).alias("window_start"),
        total("n", none), total("n_pct", none), total("sum_pct", F.lit(0.0)),
        F.array_max(F.col("w.inside.max_pct")).alias("max_pct"),
    )


def redacted(
    texts: DataFrame, columns: list[str], table: str, checkpoint: str,
    available_now: bool = True, interval: str = INTERVAL,
) -> StreamingQuery:
    """ST4. Stateless redaction of a text stream."""
    writer = (
        redact(texts, columns).writeStream.format("parquet").outputMode("append")
        .option("path", table).option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, available_now, interval).start()


def scored(
    telemetry: DataFrame, score: Callable[[DataFrame], DataFrame], history: Callable[[], DataFrame],
    table: str, checkpoint: str, available_now: bool = True, interval: str = INTERVAL,
) -> StreamingQuery:
    """ST3. After each batch, score the hosts that reported, over their stored history.

    ``history`` reads the telemetry table (of days that matter), ``score`` is the
    scoring cycle. The table holds the newest scores of every host; a batch
    rewrites the buckets of its hosts, and once more if it comes again.
    """

    def work(batch: DataFrame, number: int) -> None:
        reported = batch.groupBy("host_id").agg(F.count("*").alias("n")).select("host_id")
        rows = skew_join(history(), reported, ["host_id"], "left_semi", ["ts"])

        def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select("host_id").distinct(), "host_id", "left_anti").select(*new.columns).unionByName(new)

        _scores_table(batch.sparkSession, table).merge(score(rows), replaced, checkpoint, number)

    return _each_batch(telemetry, work, checkpoint, "append", available_now, interval)


def _scores_table(spark: SparkSession, table: str) -> KeyedTable:
    return KeyedTable(spark, table, ["host_id"])


def read_scores(spark: SparkSession, table: str) -> DataFrame:
    """What ``scored`` keeps: the newest scores of every host."""
    return _scores_table(spark, table).read()
