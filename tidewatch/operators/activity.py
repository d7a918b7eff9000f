"""Activity feed and counters over the tables of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED_SIZE = 8


def feed_items(orders: DataFrame, matches: DataFrame, tag_changes: DataFrame) -> DataFrame:
    """Orders, rule matches and tag changes in one shape."""
    order_items = orders.select(
        F.col("id"), F.lit("audit_complete").alias("type"),
        F.concat(F.lit("Audit "), F.lower("status")).alias("title"),
        F.concat(F.lit("Order for "), F.col("user_id"), F.lit(" - "), F.col("audit_level")).alias("description"),
        F.col("create_time").alias("timestamp"),
    )
    match_items = matches.select(
        F.concat_ws(":", "rule_id", "user_id").alias("id"), F.lit("rule_trigger").alias("type"),
        F.lit("Rule triggered").alias("title"),
        F.concat(F.col("rule_id"), F.lit(" for "), F.col("user_id")).alias("description"),
        F.col("executed_at").alias("timestamp"),
    )
    verb = F.when(F.col("deleted"), F.lit(" tag removed from ")).otherwise(F.lit(" tag added to "))
    tag_items = tag_changes.select(
        F.concat_ws(":", "user_id", "tag_name").alias("id"), F.lit("tag_update").alias("type"),
        F.lit("Tag updated").alias("title"),
        F.concat(F.col("tag_name"), verb, F.col("user_id")).alias("description"),
        F.col("ts").alias("timestamp"),
    )
    return order_items.unionByName(match_items).unionByName(tag_items)


def recent_activity(orders: DataFrame, matches: DataFrame, tag_changes: DataFrame,
                    size: int = FEED_SIZE) -> DataFrame:
    return (
        feed_items(orders, matches, tag_changes)
        .orderBy(F.desc("timestamp"), "type", "id").limit(size)
    )


def _counter(rows: DataFrame, name: str, first, second) -> DataFrame:
    return (
        rows.groupBy(first.cast("string").alias("label"), second.cast("string").alias("detail"))
        .agg(F.count(F.lit(1)).alias("total"))
        .select(F.lit(name).alias("counter"), "label", "detail", "total")
    )


def activity_counters(events: DataFrame, matches: DataFrame, orders: DataFrame,
                      tag_changes: DataFrame, source: str = "log") -> DataFrame:
    """Events by type and source, matches by rule, orders by status and level, tag
    changes by operation and source."""
    operation = F.when(F.col("deleted"), F.lit("remove")).otherwise(F.lit("add"))
    return (
        _counter(events, "events", F.col("event_type"), F.lit(source))
        .unionByName(_counter(matches, "rule_matches", F.col("rule_id"), F.lit("")))
        .unionByName(_counter(orders, "orders", F.col("status"), F.col("audit_level")))
        .unionByName(_counter(tag_changes, "tag_changes", operation, F.col("source")))
    )
