"""Event input: parsing, validation, the partitioned event log, retention."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema

RETENTION_DAYS = 90
EPOCH_SECONDS_MAX = 20_000_000_000
LOG_KEYS = ("event_date", "event_type", "timestamp", "event_id")

_OPTIONAL = ("session_id", "page_url", "referrer", "user_agent", "ip_address")


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages (batch or stream) to event columns plus ``_reject``.

    ``_reject`` is null for a valid event, else the reason. A message is one JSON object and
    nothing after it, no name twice. Ids and other texts must be JSON texts, the properties an object,
    the time text or a number; only the optional texts may be null, and what has a default may be missing.
    """
    body = F.col(value).cast("string")
    # a number that depends on the message follows it in a list: text after the object cannot pass unseen
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit(","), F.xxhash64(body).cast("string"), F.lit("]")))
    # as a generated row the parsed message is used by all fields and not parsed for each
    rows = messages.select(body.alias("_raw"), F.explode(F.array(whole)).alias("_v"))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", path, "variant"))

    def text(name: str) -> Column:
        return F.try_variant_get("_v", f"$[0].{name}", "string")

    names = ("event_id", "user_id", "event_type", "timestamp", *_OPTIONAL, "properties")
    kinds = F.struct(*[kind(f"$[0].{n}").alias(n) for n in names])
    is_object = F.try_variant_get("_v", "$[0]", "map<string,variant>").isNotNull()
    sealed = F.try_variant_get("_v", "$[1]", "bigint") == F.xxhash64("_raw")
    rows = rows.select(
        "_raw", F.explode(F.array(kinds)).alias("_kind"), F.coalesce(is_object & sealed, F.lit(False)).alias("_object"),
        *[text(n).alias(n) for n in names[:-1]],
        F.to_json(F.try_variant_get("_v", "$[0].properties", "variant")).alias("properties"),
    )
    of = {n: F.col(f"_kind.{n}") for n in names}
    timed = (of["timestamp"] == "STRING") | of["timestamp"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    # events without a time get the time they are first seen
    at = F.when(of["timestamp"].isNull(), F.current_timestamp()).when(timed, _moment(F.col("timestamp")))
    # ids are random where the producer gave none; a digest keeps replays stable
    event_id = F.coalesce(F.col("event_id"), F.sha2(F.col("_raw"), 256))
    reason = (
        F.when(~F.col("_object"), F.lit("malformed"))
        .when(of["user_id"].isNull() | (of["user_id"] == "VOID"), F.lit("missing user_id"))
        .when(of["user_id"] != "STRING", F.lit("bad user_id"))
        .when((of["event_type"] != "STRING") | ~_known_type(F.col("event_type")), F.lit("unknown event_type"))
        .when(at.isNull(), F.lit("bad timestamp"))
        .when(~of["properties"].startswith("OBJECT"), F.lit("bad properties"))
        .when(of["event_id"] != "STRING", F.lit("bad event_id"))
    )
    for name in _OPTIONAL:
        reason = reason.when(~of[name].isin("STRING", "VOID"), F.lit(f"bad {name}"))
    return rows.select(
        event_id.alias("event_id"), "user_id", "event_type", at.alias("timestamp"), *_OPTIONAL,
        F.coalesce("properties", F.lit("{}")).alias("properties"), reason.alias("_reject"), "_raw",
    )


def _moment(text: Column) -> Column:
    """ISO text, or a number of seconds (of milliseconds, where it is too large for seconds)."""
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > EPOCH_SECONDS_MAX, number / 1000).otherwise(number)
    instant = F.when(F.abs(seconds) < EPOCH_SECONDS_MAX, F.timestamp_micros((seconds * 1_000_000).cast("bigint")))
    return F.when(number.isNotNull(), instant).otherwise(F.try_to_timestamp(text))


def _known_type(event_type: Column) -> Column:
    return F.coalesce(event_type.isin(*schema.EVENT_TYPES), F.lit(False))


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter("_reject is null").drop("_reject", "_raw")


def rejected_messages(parsed: DataFrame) -> DataFrame:
    return parsed.filter("_reject is not null").select(
        F.col("_raw").alias("message"), F.col("_reject").alias("reason")
    )


def standard_events(events: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Events with the time of processing and an empty tag list."""
    at = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return events.withColumn("processed_at", at).withColumn("tags", F.array().cast("array<string>"))


def log_rows(events: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Stored form: empty text is null, the day and month are added."""
    blank = {
        c: F.nullif(F.col(c), F.lit(""))
        for c in ("session_id", "page_url", "referrer", "user_agent", "ip_address")
        if c in events.columns
    }
    rows = events.withColumns(blank)
    if dict(rows.dtypes).get("properties", "string") != "string":
        rows = rows.withColumn("properties", F.to_json("properties"))
    return rows.withColumns({
        "event_date": F.to_date("timestamp"),
        "event_month": F.date_format("timestamp", "yyyy-MM"),
        "ingested_at": ingested_at if ingested_at is not None else F.current_timestamp(),
    })


def append_log(
    events: DataFrame, path: str, ingested_at: Column | None = None, files_per_month: int | None = None
) -> None:
    """Appends to the log: one folder per month, files sorted by the log keys.

    Rows are spread over files by a hash of the id within each month, so one
    crowded month is still written by many tasks.
    """
    rows = log_rows(events, ingested_at)
    if files_per_month:
        spread = F.pmod(F.xxhash64("event_id"), F.lit(files_per_month))
        rows = rows.repartition("event_month", spread)
    write_log(rows, path)


def write_log(rows: DataFrame, path: str, folders: tuple[str, ...] = ("event_month",), mode: str = "append") -> None:
    """Rows of the log form as files sorted by the log keys, with a Bloom filter of their event ids.

    The filter lets a look-up by id skip row groups, whatever they are sorted by. ``overwrite`` replaces the folders
    that the rows fall into and no others.
    """
    (
        rows.sortWithinPartitions(*folders, *LOG_KEYS).write.mode(mode)
        .option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#event_id", "true")
        .partitionBy(*folders).parquet(path)
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    fields = [*schema.EVENT_LOG.fields, T.StructField("event_month", T.StringType(), True)]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def retained(events: DataFrame, as_of: date, days: int = RETENTION_DAYS) -> DataFrame:
    """Events not older than ``days``; whole months are skipped at the scan."""
    first = as_of - timedelta(days=days)
    kept = events.filter(F.col("event_date") >= F.lit(first))
    if "event_month" in events.columns:
        kept = kept.filter(F.col("event_month") >= first.strftime("%Y-%m"))
    return kept


# the benchmark table; its zone-less instants are read as UTC instants, without a cast in the way of filters
BENCH_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def events_std(table: DataFrame) -> DataFrame:
    """The benchmark event table in the shape of this package's events."""
    item = F.get_json_object("props", "$.k")
    at = F.col("ts").cast("timestamp")
    user = F.col("user_id").cast("string")
    return table.select(
        F.col("event_id").cast("string").alias("event_id"),
        user.alias("user_id"),
        "event_type",
        at.alias("timestamp"),
        F.concat(user, F.lit("_"), F.hour(at).cast("string")).alias("session_id"),
        F.concat(F.lit("/item/"), item).alias("page_url"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("props").alias("properties"),
        F.col("value"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        item.alias("product_id"),
        F.to_date(at).alias("event_date"),
    )


def load_events(spark: SparkSession, folder: str) -> DataFrame:
    return events_std(spark.read.schema(BENCH_EVENTS).parquet(f"{folder}/events.parquet"))
