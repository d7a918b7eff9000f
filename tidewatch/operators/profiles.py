"""Profile tables: upserts, partial updates, deletion, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a new profile holds where nothing is given.
EMPTY_OBJECT = "{}"
DEFAULT_RISK = "low"
_FIELDS = ("basic_info", "behavior_tags", "stat_tags", "predict_tags", "risk_level")


def _defaults() -> dict[str, Column]:
    blank = F.lit(EMPTY_OBJECT)
    return {
        "basic_info": blank,
        "behavior_tags": F.array().cast("array<string>"),
        "stat_tags": blank,
        "predict_tags": blank,
        "risk_level": F.lit(DEFAULT_RISK),
    }


def latest_profiles(versions: DataFrame) -> DataFrame:
    """Last written profile per user from a log of whole profiles."""
    bare = [c for c in versions.columns if c not in ("user_id", "update_time")]
    newest = F.max(F.struct("update_time", *bare))
    return (
        versions.groupBy("user_id").agg(newest.alias("_last"), F.min("create_time").alias("_created"))
        .select("user_id", *[
            F.col("_created" if c == "create_time" else f"_last.{c}").alias(c)
            for c in versions.columns if c != "user_id"
        ])
    )


def merge_updates(updates: DataFrame) -> DataFrame:
    """Several partial updates per user as one: per field the latest value given."""
    return updates.groupBy("user_id").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("update_time"))).alias(c) for c in _FIELDS],
        F.min("update_time").alias("_first_update"),
        F.max("update_time").alias("update_time"),
    )


def partial_update(profiles: DataFrame, updates: DataFrame) -> DataFrame:
    """Applies updates field by field; absent (null) fields keep what is stored.

    ``updates`` has at most one row per user (see ``merge_updates``). A user
    without a profile gets one with defaults for what is not given.
    """
    first = "_first_update" if "_first_update" in updates.columns else "update_time"
    fresh = updates.select(
        "user_id", *[F.col(c).alias(f"_new_{c}") for c in _FIELDS],
        F.col(first).alias("_first"), F.col("update_time").alias("_at"),
    )
    known = profiles.withColumn("_known", F.lit(True))
    joined = known.join(fresh, "user_id", "full_outer")
    defaults = _defaults()
    merged = [
        F.coalesce(
            F.col(f"_new_{c}"), F.col(c), F.when(F.col("_known").isNull(), defaults[c])
        ).alias(c)
        for c in _FIELDS
    ]
    return joined.select(
        "user_id", *merged,
        F.coalesce("create_time", "_first").alias("create_time"),
        F.coalesce("_at", "update_time").alias("update_time"),
    )


def profile_of(profiles: DataFrame, user_id: str) -> DataFrame:
    return profiles.filter(F.col("user_id") == user_id)


def users_by_risk(profiles: DataFrame, level: str) -> DataFrame:
    return profiles.filter(F.col("risk_level") == level).select("user_id")


def count_users(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count(F.lit(1)).alias("user_count"))


def delete_users(tables: list[DataFrame], users: DataFrame) -> list[DataFrame]:
    """Each table without the rows of the given users."""
    gone = users.select("user_id").distinct()
    return [table.join(gone, "user_id", "left_anti") for table in tables]
