"""The rule table: upkeep, listings, statistics, and rules as driver-side records."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema


@dataclass(frozen=True)
class Action:
    type: str
    params: dict = field(default_factory=dict)
    async_exec: bool = True
    retry_count: int = 3
    retry_delay: float = 1.0


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    condition: str
    priority: int = 0
    enabled: bool = True
    description: str | None = None
    actions: tuple[Action, ...] = ()
    tags: tuple[str, ...] = ()
    created_at: datetime | None = None
    updated_at: datetime | None = None
    created_by: str | None = None
    version: int = 1


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table; ``load_order`` keeps the order they came in."""
    rows = [
        (
            r.id, r.name, r.description, r.condition, r.priority, r.enabled,
            [(a.type, json.dumps(a.params, ensure_ascii=False), a.async_exec, a.retry_count,
              float(a.retry_delay)) for a in r.actions],
            list(r.tags), r.created_at, r.updated_at, r.created_by, r.version, i,
        )
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, schema.RULES)


def collect_rules(table: DataFrame) -> list[Rule]:
    """Rules as records: configuration, as large as the plan made of them."""
    order = [F.asc("load_order")] if "load_order" in table.columns else [F.asc("id")]
    rows = table.orderBy(*order).collect()
    return [_record(row.asDict(recursive=True)) for row in rows]


def _record(row: dict) -> Rule:
    actions = tuple(
        Action(a["type"], json.loads(a["params"] or "{}"), a["async_exec"], a["retry_count"], a["retry_delay"])
        for a in row["actions"] or []
    )
    return Rule(
        id=str(row["id"]), name=row["name"], condition=row["condition"], priority=row["priority"],
        enabled=row["enabled"], description=row["description"], actions=actions,
        tags=tuple(row["tags"] or ()), created_at=row["created_at"], updated_at=row["updated_at"],
        created_by=row["created_by"], version=row["version"],
    )


def registered(rules: list[Rule]) -> list[Rule]:
    """One rule per id: a later one replaces an earlier one in its place."""
    return list({r.id: r for r in rules}.values())


def to_evaluate(rules: list[Rule], rule_ids: list[str] | None = None) -> list[Rule]:
    """Enabled rules, larger priority first, else in the given order; no ids means all."""
    known = {r.id: r for r in registered(rules)}
    chosen = [known[i] for i in dict.fromkeys(rule_ids) if i in known] if rule_ids else list(known.values())
    return sorted((r for r in chosen if r.enabled), key=lambda r: -r.priority)


def _by_priority(rules: DataFrame) -> list:
    order = [F.desc("priority")]
    return [*order, F.asc("load_order" if "load_order" in rules.columns else "id")]


def list_rules(rules: DataFrame, enabled: bool | None = None, tag: str | None = None,
               limit: int = 100, offset: int = 0) -> DataFrame:
    if enabled is not None:
        rules = rules.filter(F.col("enabled") == enabled)
    if tag:
        rules = rules.filter(F.array_contains("tags", tag))
    return rules.orderBy(*_by_priority(rules)).offset(offset).limit(limit)


def search_rules(rules: DataFrame, text: str = "", priority: int | None = None) -> DataFrame:
    """Name or description holds the text, whatever its case; optionally one priority."""
    if text:
        wanted = F.lower(F.lit(text))
        inside = [F.contains(F.lower(F.coalesce(c, F.lit(""))), wanted) for c in ("name", "description")]
        rules = rules.filter(inside[0] | inside[1])
    return rules if priority is None else rules.filter(F.col("priority") == priority)


def rule_of(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.filter(F.col("id") == rule_id)


def rule_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(F.col("enabled")).alias("enabled_rules"),
        F.count_if(~F.col("enabled")).alias("disabled_rules"),
    )


def rules_by_tag(rules: DataFrame) -> DataFrame:
    tagged = rules.select(F.explode("tags").alias("tag"))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("rule_count"))


def rules_by_priority(rules: DataFrame) -> DataFrame:
    return rules.groupBy("priority").agg(F.count(F.lit(1)).alias("rule_count"))


def rule_changes_applied(changes: DataFrame) -> DataFrame:
    """The rule table after a log of changes.

    ``changes`` has the rule columns plus ``op`` (create, update, delete) and
    ``ts``, unique per rule. An update holds only the fields it sets (others
    null) and raises the version; creating an id anew replaces the rule; updates
    of absent rules have no effect.
    """
    fields = ("name", "description", "condition", "priority", "enabled", "actions", "tags", "created_by")
    births = (
        changes.filter(F.col("op").isin("create", "delete"))
        .groupBy("id").agg(F.max_by("op", "ts").alias("_op"), F.max("ts").alias("_born"))
        .filter(F.col("_op") == "create").drop("_op")
    )
    live = changes.join(births, "id").filter(F.col("ts") >= F.col("_born"))
    return live.groupBy("id").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in fields],
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        (F.count_if(F.col("op") == "update") + 1).cast("int").alias("version"),
    )
