"""Registry, inputs and the tables derived from the event table.

The benchmark has events only. Tag changes, profiles, orders and review requests
are derived from all of its rows by fixed expressions, once in Spark and once in
SQL, so that both sides start from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import audit, tags
from tidewatch.plans.rules import Action, Rule
from tidewatch.sources.events import load_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(2024, 1, 31)
MID = datetime(2024, 1, 15)

EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
         ts AS "timestamp", value,
         CASE WHEN event_type = 'purchase' THEN value END AS amount,
         json_extract_string(props, '$.k') AS product_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(user_id AS VARCHAR) || '_' || CAST(hour(ts) AS VARCHAR) AS session_id,
         '/item/' || json_extract_string(props, '$.k') AS page_url, props,
         epoch_us(ts) AS us
  FROM events)"""


def query(name: str, sql: str | None = None):
    """Registers a query; its timestamps come out without a zone, as the SQL side has them."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return zoneless(build(spark, folder))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


def zoneless(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def ev(spark: SparkSession, folder: str) -> DataFrame:
    return load_events(spark, folder)


def item() -> Column:
    return F.col("product_id").cast("bigint")


def failed() -> Column:
    """The benchmark has no logins; its error events stand in for failed ones."""
    return F.col("event_type") == "error"


# --- tags -------------------------------------------------------------------

def tag_changes(events: DataFrame) -> DataFrame:
    k, kind = item(), F.col("event_type")
    return tags.change_rows(
        events, F.col("user_id"), F.concat(F.lit("pref_"), (k % 7).cast("string")),
        kind, F.col("timestamp"),
        source=F.when(kind == "purchase", F.lit("RULE")).otherwise(F.lit("AUTO")),
        confidence=(k + 1) / F.lit(100.0),
        expire_at=F.when(k % 2 == 0, F.timestamp_micros(F.unix_micros("timestamp") + (k % 5) * F.lit(86_400_000_000))),
        deleted=k % 11 == 0,
    )


TAGS = EV + """, changes AS (
  SELECT user_id, 'pref_' || CAST(k % 7 AS VARCHAR) AS tag_name, event_type AS value,
         CASE WHEN event_type = 'purchase' THEN 'RULE' ELSE 'AUTO' END AS source,
         (k + 1) / 100.0 AS confidence,
         CASE WHEN k % 2 = 0 THEN "timestamp" + to_days(CAST(k % 5 AS INTEGER)) END AS expire_at,
         "timestamp" AS ts, k % 11 = 0 AS deleted
  FROM ev), tags AS (
  SELECT * EXCLUDE (rn, deleted) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, tag_name ORDER BY ts DESC) AS rn FROM changes)
  WHERE rn = 1 AND NOT deleted)"""


def present_tags(spark: SparkSession, folder: str) -> DataFrame:
    return tags.current_tags(tag_changes(ev(spark, folder)))


# --- profiles ---------------------------------------------------------------

def profile_versions(events: DataFrame) -> DataFrame:
    """Every sign-up event stores a whole profile."""
    value = F.col("value")
    return events.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("properties").alias("basic_info"),
        F.array(F.concat(F.lit("item_"), F.col("product_id"))).alias("behavior_tags"),
        F.lit("{}").alias("stat_tags"), F.lit("{}").alias("predict_tags"),
        F.when(value <= 10, F.lit("low")).when(value <= 30, F.lit("medium")).otherwise(F.lit("high")).alias("risk_level"),
        F.col("timestamp").alias("create_time"), F.col("timestamp").alias("update_time"),
    )


def profile_updates(events: DataFrame) -> DataFrame:
    """Every error event sets one or two fields."""
    k = item()
    return events.filter(F.col("event_type") == "error").select(
        "user_id", F.lit(None).cast("string").alias("basic_info"),
        F.lit(None).cast("array<string>").alias("behavior_tags"),
        F.when(k % 3 == 0, F.col("properties")).alias("stat_tags"),
        F.lit(None).cast("string").alias("predict_tags"),
        F.when(k % 2 == 0, F.lit("high")).alias("risk_level"),
        F.col("timestamp").alias("update_time"),
    )


PROFILES = EV + """, versions AS (
  SELECT user_id, props AS basic_info, 'item_' || product_id AS behavior_tags,
         CASE WHEN value <= 10 THEN 'low' WHEN value <= 30 THEN 'medium' ELSE 'high' END AS risk_level,
         "timestamp" AS t
  FROM ev WHERE event_type = 'signup'), profiles AS (
  SELECT user_id, arg_max(basic_info, t) AS basic_info, arg_max(behavior_tags, t) AS behavior_tags,
         '{}' AS stat_tags, '{}' AS predict_tags, arg_max(risk_level, t) AS risk_level,
         min(t) AS create_time, max(t) AS update_time
  FROM versions GROUP BY user_id)"""


# --- orders -----------------------------------------------------------------

def review_orders(events: DataFrame) -> DataFrame:
    """Every purchase opens an order; some are already taken or decided."""
    k = item()
    level = F.get(F.array(*[F.lit(v) for v in ("LOW", "MEDIUM", "HIGH", "CRITICAL", "odd")]), (k % 5).cast("int"))
    fresh = audit.create_orders(
        events.filter(F.col("event_type") == "purchase").withColumn("_k", k),
        F.col("user_id"), F.concat(F.lit("r"), (k % 5).cast("string")), F.col("properties"), level,
        F.col("timestamp"), order_key=F.concat(F.lit("o"), F.col("event_id")),
        assignee=F.when(k % 4 != 0, F.concat(F.lit("rev"), (k % 3).cast("string"))),
    )
    number = F.get_json_object("trigger_data", "$.k").cast("bigint")
    state = F.get(F.array(*[F.lit(s) for s in audit.STATUSES]), F.when(number % 4 == 0, F.lit(0)).otherwise((number % 5).cast("int")))
    return fresh.withColumn("status", state)


ORDERS = EV + """, orders_r AS (
  SELECT 'o' || event_id AS id, user_id, 'r' || CAST(k % 5 AS VARCHAR) AS rule_id, props AS trigger_data,
         CASE k % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL'
              ELSE 'MEDIUM' END AS audit_level,
         CASE WHEN k % 4 = 0 THEN 'pending' ELSE CASE k % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_review'
              WHEN 2 THEN 'approved' WHEN 3 THEN 'rejected' ELSE 'closed' END END AS status,
         CASE WHEN k % 4 <> 0 THEN 'rev' || CAST(k % 3 AS VARCHAR) END AS assignee,
         "timestamp" AS create_time, k,
         CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 2 END AS severity
  FROM ev WHERE event_type = 'purchase')"""


def user_orders(events: DataFrame) -> DataFrame:
    """One pending order per user who bought, for the replay of that user's events as requests."""
    first = events.filter(F.col("event_type") == "purchase").groupBy("user_id").agg(F.min("timestamp").alias("at"))
    return audit.create_orders(
        first, F.col("user_id"), F.lit("r"), F.lit("{}"), F.lit("HIGH"), F.col("at"),
        order_key=F.concat(F.lit("u"), F.col("user_id")),
    )


def review_requests(events: DataFrame) -> DataFrame:
    """Every event as a request on its user's order."""
    k = item()
    part = k % 10
    status = F.get(
        F.array(*[F.lit(s) for s in ("in_review", "approved", "rejected", "pending", "odd")]),
        F.call_function("div", k, F.lit(10).cast("bigint")).cast("int") % 5,
    )
    action = (
        F.when(k == 0, F.lit("close")).when(part < 3, F.lit("assign"))
        .when(part < 8, F.lit("review")).otherwise(F.lit("reopen"))
    )
    return events.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("order_id"),
        F.col("event_id").cast("bigint").alias("seq"), action.alias("action"),
        F.when(action == "review", status).alias("status"),
        F.when(part != 4, F.concat(F.lit("rev"), (k % 3).cast("string"))).alias("assignee"),
        F.when(part != 5, F.concat(F.lit("n"), k.cast("string"))).alias("note"),
        F.col("timestamp").alias("request_time"),
    )


REQUESTS = """requests AS (
  SELECT 'u' || user_id AS order_id, CAST(event_id AS BIGINT) AS seq,
         CASE WHEN k = 0 THEN 'close' WHEN k % 10 < 3 THEN 'assign' WHEN k % 10 < 8 THEN 'review'
              ELSE 'reopen' END AS action,
         CASE (k // 10) % 5 WHEN 0 THEN 'in_review' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected'
              WHEN 3 THEN 'pending' ELSE 'odd' END AS wanted,
         CASE WHEN k % 10 <> 4 THEN 'rev' || CAST(k % 3 AS VARCHAR) END AS assignee,
         CASE WHEN k % 10 <> 5 THEN 'n' || CAST(k AS VARCHAR) END AS note,
         "timestamp" AS request_time
  FROM ev), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS rn FROM requests
  WHERE order_id IN (SELECT 'u' || user_id FROM ev WHERE event_type = 'purchase')), walk AS (
  SELECT order_id, CAST(0 AS BIGINT) AS rn, 'pending' AS before, 'pending' AS after
  FROM (SELECT DISTINCT order_id FROM numbered)
  UNION ALL
  SELECT n.order_id, n.rn, w.after,
    CASE WHEN n.action = 'assign' THEN CASE WHEN w.after = 'pending' THEN 'in_review' ELSE w.after END
         WHEN n.action = 'reopen' THEN CASE WHEN w.after = 'rejected' THEN 'in_review' ELSE w.after END
         ELSE CASE WHEN w.after || '>' || CASE WHEN n.action = 'close' THEN 'closed' ELSE n.wanted END IN (
                'pending>in_review', 'pending>closed', 'in_review>approved', 'in_review>rejected',
                'in_review>pending', 'approved>closed', 'rejected>closed', 'rejected>in_review')
              THEN CASE WHEN n.action = 'close' THEN 'closed' ELSE n.wanted END ELSE w.after END END
  FROM walk w JOIN numbered n ON n.order_id = w.order_id AND n.rn = w.rn + 1), outcome AS (
  SELECT n.order_id, n.seq, n.action, n.assignee, n.note, n.request_time,
         w.before AS status_before, w.before <> w.after AS accepted, w.after AS status_after
  FROM walk w JOIN numbered n ON n.order_id = w.order_id AND n.rn = w.rn)"""


# --- rules ------------------------------------------------------------------

# sample rules with limits that fit the benchmark's users
RULES = [
    Rule("spend_per_event", "Spends much per event", "total_amount > 20 * event_count", 0,
         actions=(Action("TAG_USER", {"tags": ["good_margin"]}),), tags=("sales",)),
    Rule("error_share", "One event in five fails", "login_fail_count * 5 > event_count", 4,
         actions=(Action("TAG_USER", {"tags": ["many_errors"], "ttl": 86400}),
                  Action("TRIGGER_AUDIT", {"level": "LOW", "reason": "one event in five fails"})),
         tags=("operations",)),
    Rule("looks_only", "Looks, seldom buys", "view_count > 2 * purchase_count and click_count > purchase_count", 1,
         actions=(Action("ALERT", {}), Action("TAG_USER", {"tags": ["window_shopper", "no_checkout"], "source": "rule"}),
                  Action("TRIGGER_AUDIT", {"level": "critical"})),
         tags=("sales", "funnel")),
    Rule("gone_quiet", "Quiet lately", "days_since_last_visit >= 2 or event_count < 55", 2,
         actions=(Action("TAG_USER", {"tags": ["quiet"], "action": "add"}),), tags=("operations",)),
    Rule("click_share", "Clicks much", "click_count / (view_count - 12) > 1.5 or total_amount // 7 % 3 == 1", 1,
         description="Ratio that fails for some users", actions=(Action("TAG_USER", {"tags": []}),),
         tags=("funnel",)),
    Rule("odd_users", "Odd users", "int(user_id) % 2 == 1 and (1 if event_count > 60 else 0)", 0,
         description="Casts and a choice", tags=("test",)),
    Rule("broken", "Broken", "event_count > and", 3, description="Cannot be read", tags=("test",)),
    Rule("unknown_variable", "Unknown", "event_count > 0 or no_such_variable", 3, tags=("test",)),
    Rule("switched_off", "Off", "event_count > 0", 9, enabled=False, tags=("test",)),
]

CONTEXTS = EV + """, contexts AS (
  SELECT user_id, count(*) AS event_count, count(*) FILTER (event_type = 'view') AS view_count,
         count(*) FILTER (event_type = 'click') AS click_count,
         count(*) FILTER (event_type = 'purchase') AS purchase_count,
         CAST(coalesce(sum(CAST(amount AS DECIMAL(28, 6))), 0) AS DOUBLE) AS total_amount,
         count(*) FILTER (event_type = 'error') AS login_fail_count,
         date_diff('day', CAST(max("timestamp") AS DATE), DATE '2024-01-31') AS days_since_last_visit
  FROM ev GROUP BY user_id)"""
# each rule as (id, priority, place in the list, holds, evaluates)
HITS = CONTEXTS + """, held AS (
  SELECT *, unnest([
    {'rule_id': 'spend_per_event', 'priority': 0, 'pos': 0, 'hit': total_amount > 20 * event_count, 'ok': true},
    {'rule_id': 'error_share', 'priority': 4, 'pos': 1, 'hit': login_fail_count * 5 > event_count, 'ok': true},
    {'rule_id': 'looks_only', 'priority': 1, 'pos': 2,
     'hit': view_count > 2 * purchase_count AND click_count > purchase_count, 'ok': true},
    {'rule_id': 'gone_quiet', 'priority': 2, 'pos': 3, 'hit': days_since_last_visit >= 2 OR event_count < 55, 'ok': true},
    {'rule_id': 'click_share', 'priority': 1, 'pos': 4,
     'hit': coalesce(view_count <> 12 AND (click_count / nullif(view_count - 12, 0) > 1.5 OR floor(total_amount / 7) % 3 = 1), false),
     'ok': view_count <> 12},
    {'rule_id': 'odd_users', 'priority': 0, 'pos': 5, 'hit': CAST(user_id AS BIGINT) % 2 = 1 AND event_count > 60, 'ok': true},
    {'rule_id': 'broken', 'priority': 3, 'pos': 6, 'hit': false, 'ok': false},
    {'rule_id': 'unknown_variable', 'priority': 3, 'pos': 7, 'hit': false, 'ok': false}]) AS r
  FROM contexts), matches AS (
  SELECT user_id, r.rule_id AS rule_id, r.priority AS priority,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY r.priority DESC, r.pos) - 1 AS INTEGER) AS rank
  FROM held WHERE r.hit)"""
