"""Event-log queries: search, paging, totals, roll-ups, trend."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import bucket_table, micros, window_start

# Largest page and feed, and the trend ranges (bucket width, count).
PAGE_LIMIT = 200
FEED_LIMIT = 500
TREND_RANGES = {
    "1h": (timedelta(minutes=5), 12),
    "6h": (timedelta(minutes=30), 12),
    "24h": (timedelta(hours=1), 24),
    "7d": (timedelta(days=1), 7),
}


def in_range(events: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Both ends belong to the range; on the stored log, other months are not opened."""
    by_month = "event_month" in events.columns
    if start is not None:
        events = events.filter(F.col("timestamp") >= F.lit(start))
        events = events.filter(F.col("event_month") >= start.strftime("%Y-%m")) if by_month else events
    if end is not None:
        events = events.filter(F.col("timestamp") <= F.lit(end))
        events = events.filter(F.col("event_month") <= end.strftime("%Y-%m")) if by_month else events
    return events


def search(
    events: DataFrame, user_id: str | None = None, event_type: str | None = None,
    session_id: str | None = None, ip_address: str | None = None, page_url: str | None = None,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """All matching events; only the given criteria apply.

    ``page_url`` is searched anywhere in the address, ``%`` and ``_`` acting as wildcards.
    """
    equal = {"user_id": user_id, "event_type": event_type, "session_id": session_id,
             "ip_address": ip_address}
    found = in_range(events, start, end)
    for name, value in equal.items():
        if value:
            found = found.filter(F.col(name) == value)
    if page_url:
        found = found.filter(F.col("page_url").like(f"%{page_url}%"))
    return found


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered listing; only ``number * size`` rows leave each task."""
    if number < 1 or not 1 <= size <= PAGE_LIMIT:
        raise ValueError(f"page starts at 1 and size lies in 1..{PAGE_LIMIT}")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def search_page(events: DataFrame, number: int = 1, size: int = 20, direction: str = "desc",
                **criteria) -> DataFrame:
    ascending = direction.lower() == "asc"
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("timestamp", "event_id")]
    return page(search(events, **criteria), order, number, size)


def search_total(events: DataFrame, **criteria) -> DataFrame:
    return search(events, **criteria).agg(F.count(F.lit(1)).alias("total"))


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id).limit(1)


def live_feed(events: DataFrame, event_type: str | None = None, size: int = FEED_LIMIT) -> DataFrame:
    if event_type:
        events = events.filter(F.col("event_type") == event_type)
    return events.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(size)


def type_counts(events: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return (
        in_range(events, start, end)
        .groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy(F.desc("event_count"), "event_type")
    )


def top_type(events: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return type_counts(events, start, end).limit(1)


def totals(events: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events, distinct users and distinct sessions.

    Pairs of user and session are reduced first, so both distinct counts run
    over the pairs rather than over all events.
    """
    pairs = (
        in_range(events, start, end)
        .groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n"))
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("session_id").alias("unique_sessions"),
    )


def hourly_stats(events: DataFrame) -> DataFrame:
    """Events and distinct users per hour and type; exact, recomputed from the log."""
    return (
        events.groupBy(F.date_trunc("hour", "timestamp").alias("hour"), "event_type")
        .agg(F.count(F.lit(1)).alias("event_count"), F.count_distinct("user_id").alias("unique_users"))
    )


def write_hourly_stats(events: DataFrame, path: str) -> None:
    """The roll-up as a table of its own, one folder per day; rewrites the days given."""
    (
        hourly_stats(events).withColumn("day", F.to_date("hour"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").parquet(path)
    )


def event_trend(events: DataFrame, range_name: str, as_of: datetime) -> DataFrame:
    """Event counts per bucket over the latest range, zero-filled and aligned."""
    width, count = TREND_RANGES[range_name]
    size = micros(width)
    epoch = datetime(1970, 1, 1, tzinfo=as_of.tzinfo)
    last = epoch + width * ((as_of - epoch) // width)
    start, stop = last - width * (count - 1), last + width
    counts = (
        events.filter((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") <= F.lit(as_of)))
        .groupBy(window_start(F.col("timestamp"), timedelta(microseconds=size)).alias("bucket_start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        bucket_table(events.sparkSession, start, stop, width)
        .join(counts, "bucket_start", "left")
        .select("bucket_start", F.coalesce("n", F.lit(0)).alias("event_count"))
        .orderBy("bucket_start")
    )
