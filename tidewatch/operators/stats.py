"""Per-user aggregates: minute roll-up, running totals, statistics, rule contexts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import json_number
from tidewatch.operators.windows import tumbling

MINUTE = timedelta(minutes=1)
PERIOD_DAYS = (1, 7, 30)
EXACT_AMOUNT = 1e15


def with_amount(events: DataFrame) -> DataFrame:
    """``amount`` of purchases, taken from the properties where it is a number."""
    amount = F.when(F.col("event_type") == "purchase", json_number(F.col("properties"), "amount"))
    return events.withColumn("amount", amount)


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def _spent(condition: Column | None = None) -> Column:
    """Sum of purchase amounts, the same however rows are spread over tasks.

    Amounts are added as decimals, as adding doubles depends on their order;
    only amounts no decimal here can hold are added as doubles.
    """
    bought = _is("purchase") if condition is None else _is("purchase") & condition
    usual = F.abs("amount") < EXACT_AMOUNT
    exact = F.sum(F.when(bought, F.when(usual, F.col("amount")).cast("decimal(28,10)")))
    huge = F.sum(F.when(bought & ~usual, F.col("amount")))
    return F.coalesce(exact, F.lit(0)).cast("double") + F.coalesce(huge, F.lit(0.0))


def type_count_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(_is("view")).alias("view_count"),
        F.count_if(_is("click")).alias("click_count"),
        F.count_if(_is("purchase")).alias("purchase_count"),
    ]


def session_key() -> Column:
    """Sessions without an id are not counted."""
    return F.nullif(F.col("session_id"), F.lit(""))


def minute_totals(events: DataFrame, size: timedelta = MINUTE) -> DataFrame:
    """Counts, amount and distinct sessions per user and minute."""
    return tumbling(events, size).groupBy("user_id", "window_start", "window_end").agg(
        *type_count_columns(),
        _spent().alias("total_amount"),
        F.count_distinct(session_key()).alias("unique_sessions"),
    )


def running_totals(events: DataFrame) -> DataFrame:
    """Events so far and the latest event per user."""
    latest = F.max(F.struct("timestamp", "event_id", "event_type"))
    return (
        events.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total_events"), latest.alias("_last"))
        .select(
            "user_id", "total_events",
            F.col("_last.timestamp").alias("last_event_time"),
            F.col("_last.event_type").alias("last_event_type"),
        )
    )


def user_stats(events: DataFrame, as_of: datetime, login: Column | None = None) -> DataFrame:
    """Totals, trailing 1/7/30-day figures and last activity per user.

    A period holds the events after ``as_of`` minus its days, up to ``as_of``.
    """
    at = F.lit(as_of)
    logged_in = _is("login") if login is None else login
    recent = {
        d: F.col("timestamp") > at - F.expr(f"INTERVAL {d} DAYS") for d in PERIOD_DAYS
    }
    columns = [
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct(session_key()).alias("total_sessions"),
        F.count_if(_is("purchase")).alias("total_purchases"),
        _spent().alias("total_amount"),
    ]
    for days, inside in recent.items():
        columns += [
            F.count_if(inside).alias(f"events_{days}d"),
            F.count_if(inside & _is("purchase")).alias(f"purchases_{days}d"),
            _spent(inside).alias(f"amount_{days}d"),
        ]
    columns += [
        F.max("timestamp").alias("last_event_time"),
        F.max(F.when(_is("purchase"), F.col("timestamp"))).alias("last_purchase_time"),
        F.max(F.when(logged_in, F.col("timestamp"))).alias("last_login_time"),
    ]
    past = events.filter(F.col("timestamp") <= at)
    return past.groupBy("user_id").agg(*columns).withColumn("update_time", at.cast("timestamp"))


def write_user_stats(stats: DataFrame, path: str, as_of: datetime) -> None:
    """Stores the statistics of one day, replacing that day's earlier run."""
    (
        stats.withColumn("as_of", F.to_date(F.lit(as_of)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of").parquet(path)
    )


def rule_contexts(events: DataFrame, as_of: datetime, failed_login: Column | None = None) -> DataFrame:
    """The variables rules see, one row per user."""
    failed = F.lit(False) if failed_login is None else failed_login
    return events.groupBy("user_id").agg(
        *type_count_columns(),
        _spent().alias("total_amount"),
        F.count_if(failed).alias("login_fail_count"),
        F.date_diff(F.to_date(F.lit(as_of)), F.to_date(F.max("timestamp")))
        .cast("bigint").alias("days_since_last_visit"),
    )
