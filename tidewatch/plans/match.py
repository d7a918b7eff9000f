"""Matching rules against a table of user contexts."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans.rule_index import RuleIndex, literal_rows
from tidewatch.plans.rules import Rule, to_evaluate

_NO_ACTIONS = "array<struct<action_no:int,type:string,params:string>>"
_HIT = f"array<struct<rule_id:string,rule_name:string,priority:int,actions:{_NO_ACTIONS}>>"


def _record(rule: Rule) -> dict:
    actions = [
        {"action_no": i, "type": a.type, "params": json.dumps(a.params, ensure_ascii=False)} for i, a in enumerate(rule.actions)
    ]
    return {"rule_id": rule.id, "rule_name": rule.name, "priority": rule.priority, "actions": actions}


class RuleSet:
    """Rules made ready for contexts of one schema; to be kept for as long as the rules stay the same."""

    def __init__(self, rules: list[Rule], schema: T.StructType, rule_ids: list[str] | None = None):
        self.rules, self.schema = list(rules), schema
        chosen = to_evaluate(self.rules, rule_ids)
        #: Place by priority is the number in the index.
        self.index = RuleIndex([r.condition for r in chosen], schema)
        self._details = literal_rows([_record(r) for r in chosen], _HIT)

    def serves(self, rules: list[Rule], schema: T.StructType) -> bool:
        """Whether these are the very rules and columns it was made for."""
        return self.rules == list(rules) and self.schema == schema

    def match(self, contexts: DataFrame, executed_at: datetime | None = None, user: str = "user_id") -> DataFrame:
        """See ``match``."""
        at = F.lit(executed_at).cast("timestamp") if executed_at else F.current_timestamp()
        user_id = F.col(user).cast("string") if user in contexts.columns else F.lit(None).cast("string")
        held = contexts.withColumn("_numbers", self.index.hits)
        return held.select(
            user_id.alias("user_id"),
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in contexts.columns]), {"ignoreNullFields": "false"}).alias("context"),
            at.alias("executed_at"),
            F.posexplode("_numbers").alias("rank", "_number"),
        ).withColumn("_hit", F.get(self._details, F.col("_number"))).select(
            "user_id", "_hit.rule_id", "_hit.rule_name", "_hit.priority", "rank", "_hit.actions",
            "context", "executed_at",
        )


def match(
    contexts: DataFrame, rules: list[Rule], rule_ids: list[str] | None = None,
    executed_at: datetime | None = None, user: str = "user_id",
) -> DataFrame:
    """One row per user and rule that holds, with the rule's place by priority.

    All rules are one column of a projection: contexts are read once and nothing
    is joined or shuffled, however many rules there are. ``context`` is the user's row as JSON.
    """
    return RuleSet(rules, contexts.schema, rule_ids).match(contexts, executed_at, user)


def dry_run(contexts: DataFrame, rules: list[Rule], rule_ids: list[str] | None = None,
            executed_at: datetime | None = None) -> DataFrame:
    """Matches only; nothing is written and no action is prepared."""
    return match(contexts, rules, rule_ids, executed_at).drop("actions")


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("match_count"))


def validate(contexts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per rule: in how many contexts the condition evaluates without error, and holds.

    ``valid`` asks for every context to evaluate; ``error`` names the problem
    where it is known without looking at data.
    """
    index = RuleIndex([r.condition for r in rules], contexts.schema)
    columns, valid_of = index.valid_sets()
    # a context counts once for itself, for each check that it passes, and for each rule that holds
    everyone, check = -1, lambda k: -2 - k
    passed = [F.when(held, F.lit(check(k))) for k, held in enumerate(columns)]
    codes = F.concat(F.array_compact(F.array(F.lit(everyone), *passed)), index.hits)
    counts = contexts.select(F.explode(codes).alias("code")).groupBy("code").count()
    problems = {i: c.problem for i, c in index.compiled.items()}
    rows = [
        (r.id, r.condition, problems.get(i) or "fails for some contexts", i, check(valid_of[i]), everyone) for i, r in enumerate(rules)
    ]
    table = contexts.sparkSession.createDataFrame(rows, "rule_id string, condition string, problem string, held int, valid int, everyone int")
    for name in ("held", "valid", "everyone"):
        table = table.join(counts.toDF(name, f"{name}_count"), name, "left").drop(name)
    valid, n = (F.coalesce(F.col(f"{c}_count"), F.lit(0)) for c in ("valid", "everyone"))
    return table.select(
        "rule_id", "condition", (valid == n).alias("valid"), valid.alias("valid_contexts"),
        F.coalesce("held_count", F.lit(0)).alias("matched_contexts"), F.when(valid < n, F.col("problem")).alias("error"),
    )
