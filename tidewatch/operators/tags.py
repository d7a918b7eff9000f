"""User tags as a change log read latest-wins.

A change row is an upsert or, with ``deleted``, a removal; a removal without a tag name
takes all tags the user holds by then. Nothing is updated in place: concurrent writers
append, readers take the latest row per user and tag. ``seq`` orders changes of one
instant; where it is null, as in older logs, it counts as 0.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema

#: Longest list of users that is a filter; a longer one is joined, with the same answer.
BATCH_LIMIT = 100
_VALUE_FIELDS = ("value", "source", "confidence", "expire_at", "ts", "deleted", "seq")


def change_rows(
    rows: DataFrame, user: Column, name: Column, value: Column, ts: Column,
    source: Column | None = None, confidence: Column | None = None, expire_at: Column | None = None,
    deleted: Column | None = None, seq: Column | None = None,
) -> DataFrame:
    """Rows of the tag change log; an unknown source is recorded as AUTO."""
    given = F.upper(source) if source is not None else F.lit("AUTO")
    return rows.select(
        user.cast("string").alias("user_id"),
        name.cast("string").alias("tag_name"),
        value.cast("string").alias("value"),
        F.when(given.isin(*schema.TAG_SOURCES), given).otherwise(F.lit("AUTO")).alias("source"),
        (confidence if confidence is not None else F.lit(1.0)).cast("double").alias("confidence"),
        (expire_at if expire_at is not None else F.lit(None)).cast("timestamp").alias("expire_at"),
        ts.cast("timestamp").alias("ts"),
        (deleted if deleted is not None else F.lit(False)).cast("boolean").alias("deleted"),
        (seq if seq is not None else F.lit(0)).cast("bigint").alias("seq"),
    )


def removals(rows: DataFrame, user: Column, name: Column, ts: Column) -> DataFrame:
    return change_rows(rows, user, name, F.lit(None), ts, deleted=F.lit(True))


def latest_changes(changes: DataFrame) -> DataFrame:
    """Last change per user and tag, removals included.

    At equal times the larger ``seq`` is the later change; at equal ones of these a removal wins
    over an upsert, then the larger value. An aggregate, so each task reduces its own
    rows before the shuffle; only one row per user and tag is then held against the
    user's last removal of all tags.
    """
    order = F.struct("ts", F.coalesce("seq", F.lit(0)).alias("seq"), "deleted", "value", "source", "confidence", "expire_at")
    last = changes.groupBy("user_id", "tag_name").agg(F.max(order).alias("_last"))
    at = F.struct("_last.ts", "_last.seq")
    cleared = F.max(F.when(F.col("tag_name").isNull(), at)).over(Window.partitionBy("user_id"))
    gone = F.col("_last.deleted") | F.coalesce(at < F.col("_cleared"), F.lit(False))
    return (
        last.withColumn("_cleared", cleared).filter(F.col("tag_name").isNotNull())
        .select("user_id", "tag_name", *[
            gone.alias(c) if c == "deleted" else F.col(f"_last.{c}").alias(c) for c in _VALUE_FIELDS
        ])
    )


def current_tags(changes: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Present tags; with ``as_of`` the changes up to then and only tags still valid."""
    if as_of is not None:
        changes = changes.filter(F.col("ts") <= F.lit(as_of))
    tags = latest_changes(changes).filter(~F.col("deleted")).drop("deleted", "seq")
    return tags if as_of is None else valid_tags(tags, as_of)


def valid_tags(tags: DataFrame, as_of: datetime) -> DataFrame:
    return tags.filter(F.col("expire_at").isNull() | (F.col("expire_at") > F.lit(as_of)))


def compact(changes: DataFrame) -> DataFrame:
    """The same present tags in the fewest change rows; for a periodic rewrite of the log."""
    return latest_changes(changes).filter(~F.col("deleted"))


def user_tags(tags: DataFrame, user_id: str) -> DataFrame:
    return tags.filter(F.col("user_id") == user_id)


def batch_tags(tags: DataFrame, users: list[str] | DataFrame, names: list[str] | None = None) -> DataFrame:
    """Tags of many users, optionally of some names.

    A list of up to ``BATCH_LIMIT`` users becomes a pushed-down filter; a longer one,
    or a DataFrame of ``user_id``, is joined.
    """
    if names:
        tags = tags.filter(F.col("tag_name").isin(*names))
    if not isinstance(users, DataFrame) and len(users) > BATCH_LIMIT:
        users = tags.sparkSession.createDataFrame([(u,) for u in users], "user_id string")
    if isinstance(users, DataFrame):
        return tags.join(users.select("user_id"), "user_id", "left_semi")
    return tags.filter(F.col("user_id").isin(*users))


def tag_maps(tags: DataFrame) -> DataFrame:
    """One row per user: map from tag name to its value record. A user holds few tags."""
    record = F.struct("value", "source", "confidence", "expire_at", "ts")
    return tags.groupBy("user_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag_name", record)))).alias("tags")
    )


def map_tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def map_set_tag(tags: Column, name: str, record: Column) -> Column:
    return F.map_concat(map_remove_tag(tags, name), F.create_map(F.lit(name), record))


def map_remove_tag(tags: Column, name: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != name)


def users_with_tag(tags: DataFrame, name: str, value: str | None = None) -> DataFrame:
    found = tags.filter(F.col("tag_name") == name)
    if value is not None:
        found = found.filter(F.col("value") == value)
    return found.select("user_id").distinct()


def tag_statistics(tags: DataFrame) -> DataFrame:
    """Users per tag. ``tags`` has one row per user and tag."""
    return tags.groupBy("tag_name").agg(F.count(F.lit(1)).alias("user_count"))


def tag_distribution(tags: DataFrame, name: str) -> DataFrame:
    return (
        tags.filter(F.col("tag_name") == name)
        .groupBy("tag_name", "value").agg(F.count(F.lit(1)).alias("user_count"))
    )


def replace_tags(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Change rows that make each user of ``wanted`` hold exactly the given tags.

    ``wanted`` is in change-row form. Present tags outside the new set are
    removed at the time of the user's replacement.
    """
    moments = wanted.groupBy("user_id").agg(F.max("ts").alias("_at"))
    gone = (
        tags.join(wanted.select("user_id", "tag_name"), ["user_id", "tag_name"], "left_anti")
        .join(moments, "user_id")
    )
    return wanted.unionByName(removals(gone, F.col("user_id"), F.col("tag_name"), F.col("_at")))
