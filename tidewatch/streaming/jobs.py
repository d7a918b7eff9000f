"""Streaming sources, windowed roll-ups, the rule job and sinks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewatch.functions.timeutil import interval_text, micros
from tidewatch.operators.stats import _spent, session_key, type_count_columns
from tidewatch.plans.actions import ActionRegistry, default_registry
from tidewatch.plans.match import RuleSet
from tidewatch.plans.rules import Rule
from tidewatch.sources.events import log_rows, parse_messages, valid_events, write_log

FLUSH_DELAY = timedelta(seconds=30)
FLUSH_EVERY = "60 seconds"


def message_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines arriving as files; any stream with a ``value`` column will do as well."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_stream(messages: DataFrame) -> DataFrame:
    return valid_events(parse_messages(messages))


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def without_replays(events: DataFrame, lateness: timedelta = FLUSH_DELAY) -> DataFrame:
    """Each event once, although sources deliver at least once."""
    return events.withWatermark("timestamp", interval_text(lateness)).dropDuplicatesWithinWatermark(["event_id"])


def minute_totals_stream(events: DataFrame, size: timedelta = timedelta(minutes=1),
                         lateness: timedelta = FLUSH_DELAY) -> DataFrame:
    """Counts, amount and distinct sessions per user and minute, once the window is past.

    Streams have no distinct count. Events are first totalled per session, so
    the sessions of a window are rows to count, not a set held in state.
    """
    text = interval_text(size)
    per_session = (
        events.withWatermark("timestamp", interval_text(lateness))
        .groupBy("user_id", F.window("timestamp", text).alias("w"), session_key().alias("session_id"))
        .agg(*type_count_columns(), _spent().alias("total_amount"))
    )
    counts = ["event_count", "view_count", "click_count", "purchase_count", "total_amount"]
    return (
        per_session.groupBy("user_id", F.window(F.window_time("w"), text).alias("w"))
        .agg(*[F.sum(c).alias(c) for c in counts], F.count("session_id").alias("unique_sessions"))
        .select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                *counts, "unique_sessions")
    )


def windowed_counts_stream(events: DataFrame, keys: list[str], size: timedelta, slide: timedelta | None = None,
                           lateness: timedelta = FLUSH_DELAY) -> DataFrame:
    """Tumbling or sliding counts, emitted once when the watermark passes the window."""
    slide = slide or size
    if slide > size:
        raise ValueError("slide must not exceed the window size")
    window = F.window("timestamp", interval_text(size), interval_text(slide))
    return (
        events.withWatermark("timestamp", interval_text(lateness))
        .groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("event_count"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_count")
    )


def session_counts_stream(events: DataFrame, key: str, timeout: timedelta,
                          lateness: timedelta = FLUSH_DELAY) -> DataFrame:
    """Inactivity sessions, emitted when the watermark passes their end."""
    session = F.session_window("timestamp", interval_text(timeout))
    return (
        events.withWatermark("timestamp", interval_text(lateness))
        .groupBy(key, session.alias("s")).agg(F.count(F.lit(1)).alias("event_count"))
        .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "event_count")
    )


# --- sinks ------------------------------------------------------------------

def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append_table(stream: DataFrame, path: str, checkpoint: str, every: str | None = FLUSH_EVERY,
                 partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Appends to a parquet table; ``every=None`` takes what is there and stops."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, every).start(path)


def append_log_stream(events: DataFrame, path: str, checkpoint: str, every: str | None = FLUSH_EVERY) -> StreamingQuery:
    """The event log as a sink: one folder per month and micro-batch, files sorted as the batch sink sorts them.

    A repeated micro-batch replaces its own folders, so no row is doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_log(log_rows(batch).withColumn("batch", F.lit(batch_id)), path, ("event_month", "batch"), "overwrite")

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(writer.foreachBatch(write), every).start()


# --- the end of a bounded stream ------------------------------------------------

_MARKER = "timestamp timestamp"


def with_end_markers(events: DataFrame, folder: str) -> DataFrame:
    """The events and, once ``run_to_end`` has put one there, a marker row of nobody's far behind them."""
    spark = events.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        spark.createDataFrame([], _MARKER).write.mode("append").parquet(folder)
    return events.unionByName(table_stream(spark, folder, spark.createDataFrame([], _MARKER).schema), allowMissingColumns=True)


def run_to_end(spark: SparkSession, start: Callable[[], StreamingQuery], markers: str, reach: timedelta) -> None:
    """Runs a windowed job over all that is there, and then its last windows out.

    Windows come out when the watermark passes them, so the last ones of a stream
    that has ended wait for events that never come. When ``start()``, an ``availableNow`` job over
    ``with_end_markers(..., markers)``, has read everything, a marker row later than the last event by ``reach``, the length
    of a window and of two latenesses at least, is put into ``markers``, and a second run takes the watermark past all
    windows of events. The marker's own window stays in the state. Later events up to the marker would be late.
    """
    query = start()
    query.awaitTermination()
    latest = [p["eventTime"]["max"] for p in query.recentProgress if "max" in p.get("eventTime", {})]
    if not latest:
        return
    at = F.to_timestamp(F.lit(max(latest))) + F.expr(f"INTERVAL {micros(reach)} MICROSECONDS")
    spark.range(1).select(at.alias("timestamp")).write.mode("append").parquet(markers)
    start().awaitTermination()


def keyed_messages(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """``key`` and JSON ``value``, the form message sinks take; the key keeps a user's rows in order."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def _kept_moment(spark: SparkSession, folder: str) -> datetime:
    """The moment stored in a folder; the present one, stored there, if there is none."""
    done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        spark.sql("SELECT current_timestamp() AS t").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder).first()["t"]


def rule_job(
    contexts: DataFrame, load_rules: Callable[[], list[Rule]], tag_path: str, order_path: str,
    match_path: str, checkpoint: str, registry: Callable[[], ActionRegistry] = default_registry,
    every: str | None = FLUSH_EVERY,
) -> StreamingQuery:
    """Matches rules to arriving contexts and writes matches, tag changes and orders.

    Rules are loaded anew for every micro-batch, so changes apply while the job
    runs; as long as they stay the same, so does what is compiled. Each micro-batch writes
    its own folder and keeps its moment there, so a repeated one replaces its rows by the same.
    """
    ready: list[RuleSet] = []

    def act(batch: DataFrame, batch_id: int) -> None:
        actions = registry()
        rules = load_rules()
        if not ready or not ready[0].serves(rules, batch.schema):
            ready[:] = [RuleSet(rules, batch.schema)]
        # ids are made from the moment
        now = _kept_moment(batch.sparkSession, f"{checkpoint}/moments/batch={batch_id}")
        hits = ready[0].match(batch, executed_at=now).persist()
        try:
            outputs = {match_path: actions.results(hits)}
            for kind, path in (("TAG_USER", tag_path), ("TRIGGER_AUDIT", order_path)):
                if kind in actions.types():
                    outputs[path] = actions.run(hits, kind)
            for path, rows in outputs.items():
                rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            hits.unpersist()

    writer = contexts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(writer.foreachBatch(act), every).start()
