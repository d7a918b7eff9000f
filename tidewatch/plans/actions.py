"""What rule matches lead to: tag changes, review orders, result rows.

A handler has two parts: ``check`` gives the error of one action as a column
(null when it can run), ``apply`` turns action rows into the rows to write.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import format_iso
from tidewatch.operators import audit, tags

# Parameter defaults and error texts of the two actions.
TAG_ACTIONS = ("add", "remove", "set")
TAG_VALUE = "true"
DEFAULT_REASON = "Rule triggered audit"
BATCH_REASON = "Batch audit"
MISSING_USER = "Missing user_id in context"
MISSING_TAGS = "Missing tags parameter"

_TAG_PARAMS = "tags array<string>, action string, source string, ttl bigint"
_AUDIT_PARAMS = "level string, reason string, rule_id string, assignee string"


@dataclass(frozen=True)
class Handler:
    check: Callable[[Column, Column], Column]
    apply: Callable[[DataFrame], DataFrame]


class ActionRegistry:
    """Action types and their handlers; types without one fail row by row."""

    def __init__(self, handlers: dict[str, Handler] | None = None):
        self._handlers = dict(handlers or {})

    def register(self, action_type: str, handler: Handler) -> None:
        self._handlers[action_type] = handler

    def unregister(self, action_type: str) -> bool:
        return self._handlers.pop(action_type, None) is not None

    def types(self) -> list[str]:
        return list(self._handlers)

    def _error(self, user: Column, action: Column) -> Column:
        kind = action["type"]
        error = F.concat(F.lit("No handler registered for action type: "), kind)
        for name, handler in self._handlers.items():
            error = F.when(kind == name, handler.check(user, action)).otherwise(error)
        return error

    def results(self, matches: DataFrame) -> DataFrame:
        """Matches with their executed actions (type, success, error) and the last failure."""
        user = F.col("user_id")
        executed = F.transform(
            "actions",
            lambda a: F.struct(
                a["type"].alias("action"), self._error(user, a).isNull().alias("success"),
                self._error(user, a).alias("error"),
            ),
        )
        known = [F.lit(t) for t in self._handlers]
        failed = F.filter(
            "actions_executed",
            lambda a: ~a["success"] & (F.array_contains(F.array(*known), a["action"]) if known else F.lit(False)),
        )
        last = F.try_element_at(failed, F.lit(-1))["error"]
        return matches.withColumn("actions_executed", executed).withColumn(
            "error", F.when(last.isNotNull(), F.concat(F.lit("Action execution failed: "), last))
        ).drop("actions")

    def rows(self, matches: DataFrame) -> DataFrame:
        """One row per match and action, with the error that keeps it from running."""
        spread = matches.withColumn("action", F.explode("actions")).drop("actions")
        return spread.withColumn("error", self._error(F.col("user_id"), F.col("action")))

    def run(self, matches: DataFrame, action_type: str) -> DataFrame:
        """The rows one action type writes."""
        handler = self._handlers[action_type]
        due = self.rows(matches).filter((F.col("action.type") == action_type) & F.col("error").isNull())
        return handler.apply(due)


def _no_user(user: Column) -> Column:
    return user.isNull() | (user == "")


def _tag_check(user: Column, action: Column) -> Column:
    params = F.from_json(action["params"], _TAG_PARAMS)
    kind = F.coalesce(params["action"], F.lit("add"))
    return (
        F.when(_no_user(user), F.lit(MISSING_USER))
        .when(F.coalesce(F.size(params["tags"]), F.lit(0)) <= 0, F.lit(MISSING_TAGS))
        .when(~kind.isin(*TAG_ACTIONS), F.concat(F.lit("Unknown action: "), kind))
    )


def tag_handler() -> Handler:
    """TAG_USER. Changes of one match take effect by place of the rule, then of the action.

    ``set`` first removes all tags the user holds by then, in a row without a tag name.
    """

    def apply(actions: DataFrame) -> DataFrame:
        rows = actions.withColumn("_p", F.from_json("action.params", _TAG_PARAMS)).withColumn(
            "_kind", F.coalesce("_p.action", F.lit("add"))
        )
        named = F.array_distinct(F.filter("_p.tags", lambda t: t.isNotNull()))
        everything = F.array(F.lit(None).cast("string"))
        each = rows.withColumn(
            "_tag", F.explode(F.when(F.col("_kind") == "set", F.concat(everything, named)).otherwise(named))
        )
        ttl = F.nullif(F.col("_p.ttl"), F.lit(0).cast("bigint"))
        expire = F.timestamp_micros(F.unix_micros("executed_at") + ttl * 1_000_000)
        removed = (F.col("_kind") == "remove") | F.col("_tag").isNull()
        place = F.shiftleft(F.col("rank").cast("bigint"), 32) + F.col("action.action_no")
        return tags.change_rows(
            each, F.col("user_id"), F.col("_tag"), F.when(~removed, F.lit(TAG_VALUE)), F.col("executed_at"),
            source=F.coalesce("_p.source", F.lit("rule")),
            expire_at=F.when(~removed, expire), deleted=removed, seq=place,
        )

    return Handler(_tag_check, apply)


def _audit_check(user: Column, action: Column) -> Column:
    return F.when(_no_user(user), F.lit(MISSING_USER))


def _audit_orders(actions: DataFrame) -> DataFrame:
    rows = actions.withColumn("_p", F.from_json("action.params", _AUDIT_PARAMS))
    rule = F.coalesce(F.nullif("_p.rule_id", F.lit("")), F.get_json_object("context", "$.rule_id"), "rule_id")
    metadata = F.get_json_object("action.params", "$.metadata")
    own = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))

    def inside(text: Column) -> Column:
        return F.substring(text, F.lit(2), F.length(text) - 2)

    def field(name: str, value: Column) -> Column:
        text = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
        return F.when(~F.array_contains(own, name), inside(text))

    # metadata takes the place of fields of the same name
    data = F.concat(F.lit("{"), F.concat_ws(
        ",", field("rule_id", rule), field("reason", F.coalesce("_p.reason", F.lit(DEFAULT_REASON))),
        field("triggered_at", format_iso(F.col("executed_at"))),
        F.when(~F.array_contains(own, "context"), F.concat(F.lit('"context":'), F.col("context"))),
        F.when(F.size(own) > 0, inside(metadata)),
    ), F.lit("}"))
    key = audit.order_id(
        F.col("user_id"), rule, F.col("action.action_no").cast("string"), F.col("executed_at").cast("string")
    )
    return audit.create_orders(
        rows, F.col("user_id"), rule, data, F.coalesce("_p.level", F.lit(audit.DEFAULT_LEVEL)),
        F.col("executed_at"), order_key=key, assignee=F.col("_p.assignee"), fold_case=True,
    )


def audit_handler() -> Handler:
    """TRIGGER_AUDIT."""
    return Handler(_audit_check, _audit_orders)


def default_registry() -> ActionRegistry:
    """Handlers of the two actions that have one; notifications, blocks and alerts have none."""
    return ActionRegistry({"TAG_USER": tag_handler(), "TRIGGER_AUDIT": audit_handler()})


def batch_tag_status(rows: DataFrame) -> DataFrame:
    """Requests (user_id, tags) with a status per user."""
    bad = _no_user(F.col("user_id")) | (F.coalesce(F.size("tags"), F.lit(0)) <= 0)
    return rows.select(
        "user_id", F.when(bad, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(bad, F.lit("Missing user_id or tags")).alias("error"),
    )


def batch_tag_changes(rows: DataFrame, ts: Column) -> DataFrame:
    """Tag changes of the requests that can be carried out."""
    good = rows.filter(~_no_user(F.col("user_id")) & (F.size("tags") > 0))
    each = good.withColumn("_tag", F.explode("tags"))
    return tags.change_rows(each, F.col("user_id"), F.col("_tag"), F.lit(TAG_VALUE), ts, source=F.lit("RULE"))


def batch_audit_status(rows: DataFrame) -> DataFrame:
    bad = _no_user(F.col("user_id"))
    return rows.select(
        "user_id", F.when(bad, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(bad, F.lit("Missing user_id")).alias("error"),
    )


def batch_audit_orders(rows: DataFrame, at: Column) -> DataFrame:
    """Orders for users (user_id, level, reason, trigger_data, rule_id), all but user_id optional."""
    for name in ("level", "reason", "trigger_data", "rule_id"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    good = rows.filter(~_no_user(F.col("user_id")))
    data = F.coalesce(
        "trigger_data", F.to_json(F.struct(F.coalesce("reason", F.lit(BATCH_REASON)).alias("reason")))
    )
    level = F.coalesce("level", F.lit(audit.DEFAULT_LEVEL))
    return audit.create_orders(good, F.col("user_id"), F.col("rule_id"), data, level, at)
