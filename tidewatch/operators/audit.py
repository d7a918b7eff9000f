"""Review orders: creation, legal transitions, replay of requests, lists, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions.values import ranked
from tidewatch.operators.logs import page
from tidewatch.operators.skew import LIGHT, ordered_states

# Which status may follow which.
TRANSITIONS = {
    "pending": ("in_review", "closed"),
    "in_review": ("approved", "rejected", "pending"),
    "approved": ("closed",),
    "rejected": ("closed", "in_review"),
    "closed": (),
}
OPEN_STATUSES = ("pending", "in_review")
DEFAULT_LEVEL = "MEDIUM"
STATUSES = schema.AUDIT_STATUSES


def audit_level(level: Column, fold_case: bool = False) -> Column:
    """A known level, else MEDIUM. Only rule actions accept lower case."""
    given = F.upper(level) if fold_case else level
    return F.when(given.isin(*schema.AUDIT_LEVELS), given).otherwise(F.lit(DEFAULT_LEVEL))


def order_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def create_orders(
    rows: DataFrame, user: Column, rule: Column, data: Column, level: Column, at: Column,
    order_key: Column | None = None, assignee: Column | None = None, fold_case: bool = False,
) -> DataFrame:
    """New pending orders. Ids follow from user, rule and time, so a rerun repeats them."""
    at = at.cast("timestamp")
    key = order_key if order_key is not None else order_id(user, rule, at.cast("string"))
    return rows.select(
        key.alias("id"),
        user.cast("string").alias("user_id"),
        rule.cast("string").alias("rule_id"),
        data.alias("trigger_data"),
        audit_level(level, fold_case).alias("audit_level"),
        F.lit("pending").alias("status"),
        (assignee if assignee is not None else F.lit(None)).cast("string").alias("assignee"),
        F.lit(None).cast("string").alias("reviewer_note"),
        at.alias("create_time"),
        at.alias("update_time"),
    )


def next_statuses(status: Column) -> Column:
    table = F.create_map(*[
        part for s, allowed in TRANSITIONS.items()
        for part in (F.lit(s), F.array(*[F.lit(a) for a in allowed]).cast("array<string>"))
    ])
    return F.coalesce(F.try_element_at(table, status), F.array().cast("array<string>"))


def can_move(status: Column, to: Column) -> Column:
    return F.array_contains(next_statuses(status), to)


def _code(status: Column) -> Column:
    return (ranked(status, STATUSES) - 1).cast("int")


def status_after(action: str, status: str, wanted: str | None) -> str:
    """Status after one request; the same status where it is refused."""
    if action == "assign":
        return "in_review" if status == "pending" else status
    if action == "reopen":
        return "in_review" if status == "rejected" else status
    return wanted if wanted in TRANSITIONS[status] else status


def _moves(action: str, wanted: str | None = None) -> list[int]:
    """The request as a map from each status to the next, by position in STATUSES."""
    return [STATUSES.index(status_after(action, status, wanted)) for status in STATUSES]


def _step() -> Column:
    action, status = F.col("action"), F.col("status")

    def codes(moves: list[int]) -> Column:
        return F.array(*[F.lit(m) for m in moves])

    step = F.when(action == "assign", codes(_moves("assign"))).when(
        action == "reopen", codes(_moves("reopen"))
    ).when(action == "close", codes(_moves("review", "closed")))
    for wanted in STATUSES:
        step = step.when((action == "review") & (status == wanted), codes(_moves("review", wanted)))
    return step.otherwise(codes(_moves("review")))


def replay(orders: DataFrame, requests: DataFrame, light: int = LIGHT) -> DataFrame:
    """Each request with ``status_before``, ``accepted`` and ``status_after``.

    Requests of an order apply by ``seq`` (unique within the order). Whether one
    is accepted depends on the status alone, which has five values; so the many
    requests of a crowded order (more than ``light``) are folded block by block
    into status-to-status maps. Requests for unknown orders are refused: their
    status is null.
    """
    start = orders.select(F.col("id").alias("order_id"), _code(F.col("status")).alias("_start"))
    rest = [c for c in requests.columns if c not in ("order_id", "seq")]
    states = ordered_states(
        requests.withColumn("_fn", _step()), ["order_id"], "seq", "_fn", len(STATUSES), start, rest, light
    )
    names = F.array(*[F.lit(s) for s in STATUSES])
    before = F.get(names, F.col("state"))
    after = F.get(names, F.get(_step(), F.col("state")))
    return states.select(
        *requests.columns,
        before.alias("status_before"),
        F.coalesce(before != after, F.lit(False)).alias("accepted"),
        after.alias("status_after"),
    )


def apply_requests(orders: DataFrame, requests: DataFrame, outcome: DataFrame | None = None) -> DataFrame:
    """Orders after all requests: last status, last assignee and note given, last change."""
    done = outcome if outcome is not None else replay(orders, requests)
    accepted = done.filter("accepted")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    seq = F.col("seq")
    # assign, review and reopen carry an assignee; only review and close a note
    assignee = F.when(F.col("action") != "close", given("assignee"))
    note = F.when(F.col("action").isin("review", "close"), given("note"))
    changes = accepted.groupBy("order_id").agg(
        F.max_by("status_after", seq).alias("_status"),
        F.max_by(assignee, F.when(assignee.isNotNull(), seq)).alias("_assignee"),
        F.max_by(note, F.when(note.isNotNull(), seq)).alias("_note"),
        F.max_by("request_time", seq).alias("_time"),
    )
    joined = orders.join(changes, orders["id"] == changes["order_id"], "left")
    latest = {"status": "_status", "assignee": "_assignee", "reviewer_note": "_note", "update_time": "_time"}
    return joined.select(*[
        F.coalesce(latest[c], c).alias(c) if c in latest else F.col(c) for c in orders.columns
    ])


def assign_requests(rows: DataFrame, order: Column, assignee: Column, seq: Column, at: Column) -> DataFrame:
    """Assignments, one or many, as request rows."""
    return rows.select(
        order.alias("order_id"), seq.cast("bigint").alias("seq"), F.lit("assign").alias("action"),
        F.lit(None).cast("string").alias("status"), assignee.alias("assignee"),
        F.lit(None).cast("string").alias("note"), at.cast("timestamp").alias("request_time"),
    )


def batch_assign(orders: DataFrame, ids: DataFrame, assignee: str, at: datetime) -> DataFrame:
    """Orders assigned by one batch; ids that are unknown or not pending are skipped.

    ``ids`` has a column ``order_id``; a repeated id counts once.
    """
    wanted = ids.select(F.col("order_id").alias("id")).distinct()
    return (
        orders.filter(F.col("status") == "pending").join(wanted, "id", "left_semi")
        .withColumn("status", F.lit("in_review"))
        .withColumn("assignee", F.lit(assignee))
        .withColumn("update_time", F.lit(at).cast("timestamp"))
    )


def delete_orders(orders: DataFrame, ids: DataFrame) -> DataFrame:
    return orders.join(ids.select(F.col("order_id").alias("id")), "id", "left_anti")


def by_id(orders: DataFrame, order: str) -> DataFrame:
    return orders.filter(F.col("id") == order)


def level_order(lexical: bool = False) -> Column:
    """Most severe level first; ``lexical`` sorts the names as text instead."""
    return F.desc("audit_level") if lexical else ranked(F.col("audit_level"), schema.AUDIT_LEVELS).desc()


def _listed(orders: DataFrame, status: str | None, assignee: str | None, user_id: str | None) -> DataFrame:
    for name, value in {"status": status, "assignee": assignee, "user_id": user_id}.items():
        if value:
            orders = orders.filter(F.col(name) == value)
    return orders


def list_page(orders: DataFrame, status: str | None = None, assignee: str | None = None,
              user_id: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """Newest first."""
    return page(_listed(orders, status, assignee, user_id),
                [F.desc("create_time"), F.asc("id")], number, size)


def list_total(orders: DataFrame, status: str | None = None, assignee: str | None = None,
               user_id: str | None = None) -> DataFrame:
    return _listed(orders, status, assignee, user_id).agg(F.count(F.lit(1)).alias("total"))


def todo(orders: DataFrame, assignee: str, lexical: bool = False) -> DataFrame:
    """A reviewer's open orders: most severe first, then oldest."""
    mine = orders.filter((F.col("assignee") == assignee) & F.col("status").isin(*OPEN_STATUSES))
    return mine.orderBy(level_order(lexical), "create_time", "id")


def unassigned(orders: DataFrame, lexical: bool = False) -> DataFrame:
    free = orders.filter((F.col("status") == "pending") & F.col("assignee").isNull())
    return free.orderBy(level_order(lexical), "create_time", "id")


def by_level(orders: DataFrame, level: str | None = None, sort: str = "time") -> DataFrame:
    """Orders of one level (or all), by time or by severity."""
    if level and level.lower() != "all":
        orders = orders.filter(F.col("audit_level") == level.upper())
    order = [F.desc("create_time"), F.asc("id")]
    return orders.orderBy(*([level_order(), *order] if sort == "level" else order))


def _zero_filled(spark: SparkSession, counts: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    every = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return every.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("order_count"))


def status_counts(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return _zero_filled(orders.sparkSession, counts, "status", STATUSES)


def open_level_counts(orders: DataFrame) -> DataFrame:
    counts = (
        orders.filter(F.col("status").isin(*OPEN_STATUSES))
        .groupBy("audit_level").agg(F.count(F.lit(1)).alias("n"))
    )
    return _zero_filled(orders.sparkSession, counts, "audit_level", schema.AUDIT_LEVELS)


def created_today(orders: DataFrame, as_of: datetime) -> DataFrame:
    midnight = F.date_trunc("day", F.lit(as_of))
    return orders.filter(F.col("create_time") >= midnight).agg(F.count(F.lit(1)).alias("today_count"))
