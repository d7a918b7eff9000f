"""Per-user statistics, rules and what they lead to."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.catalog.base import (
    AS_OF, CONTEXTS, EV, HITS, MID, RULES, TAGS, ev, failed, query, tag_changes,
)
from tidewatch.operators import stats, tags
from tidewatch.operators.user_table import UserTable
from tidewatch.plans import actions, match, rules
from tidewatch.plans.conditions import field_condition as fc
from tidewatch.schema import RULES as RULE_COLUMNS
from tidewatch.session import ensure_checkpoint_dir
from tidewatch.sources.rules import read_rule_table

COUNTS_SQL = """count(*) AS event_count, count(*) FILTER (event_type = 'view') AS view_count,
  count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'purchase') AS purchase_count"""
SPENT_SQL = "CAST(coalesce(sum(CAST({} AS DECIMAL(28, 6))), 0) AS DOUBLE)"
AT_SQL = "TIMESTAMP '2024-01-31'"


@query("user_minute_agg", f"""WITH {EV} SELECT user_id, date_trunc('minute', "timestamp") AS window_start,
  date_trunc('minute', "timestamp") + INTERVAL 1 MINUTE AS window_end, {COUNTS_SQL},
  {SPENT_SQL.format('amount')} AS total_amount, count(DISTINCT session_id) AS unique_sessions FROM ev GROUP BY ALL""")
def user_minute_agg(spark, d):
    return stats.minute_totals(ev(spark, d))


@query("user_running_stats", f"""WITH {EV} SELECT user_id, count(*) AS total_events, max("timestamp") AS last_event_time,
  arg_max(event_type, "timestamp") AS last_event_type FROM ev GROUP BY user_id""")
def user_running_stats(spark, d):
    return stats.running_totals(ev(spark, d))


PERIODS_SQL = ", ".join(
    f"""count(*) FILTER ("timestamp" > {AT_SQL} - INTERVAL {n} DAY) AS events_{n}d,
  count(*) FILTER ("timestamp" > {AT_SQL} - INTERVAL {n} DAY AND event_type = 'purchase') AS purchases_{n}d,
  {SPENT_SQL.format(f'CASE WHEN "timestamp" > {AT_SQL} - INTERVAL {n} DAY THEN amount END')} AS amount_{n}d"""
    for n in stats.PERIOD_DAYS
)


@query("user_stat", f"""WITH {EV} SELECT user_id, count(*) AS total_events, count(DISTINCT session_id) AS total_sessions,
  count(*) FILTER (event_type = 'purchase') AS total_purchases, {SPENT_SQL.format('amount')} AS total_amount,
  {PERIODS_SQL}, max("timestamp") AS last_event_time,
  max("timestamp") FILTER (event_type = 'purchase') AS last_purchase_time,
  max("timestamp") FILTER (event_type = 'signup') AS last_login_time, {AT_SQL} AS update_time FROM ev GROUP BY user_id""")
def user_stat(spark, d):
    return stats.user_stats(ev(spark, d), AS_OF, login=F.col("event_type") == "signup")


STORED_COLS = ["user_id", "total_events", "total_purchases", "total_amount", "last_event_time", "update_time"]
_STATS_SQL = f"""SELECT user_id, count(*) AS total_events, count(*) FILTER (event_type = 'purchase') AS total_purchases,
  {SPENT_SQL.format('amount')} AS total_amount, max("timestamp") AS last_event_time, {{0}} AS update_time FROM ev
  WHERE "timestamp" <= {{0}} GROUP BY user_id"""
STORED = EV + f""", earlier AS ({_STATS_SQL.format("TIMESTAMP '2024-01-15'")}), later AS (
  SELECT * FROM ({_STATS_SQL.format(AT_SQL)}) WHERE last_event_time > TIMESTAMP '2024-01-29'),
  stored AS (SELECT * FROM later UNION ALL SELECT * FROM earlier WHERE user_id NOT IN (SELECT user_id FROM later))"""
RECENT = datetime(2024, 1, 29)


def _stored(spark, d):
    """Statistics of the middle of the month, brought up to date for users seen lately."""
    events = ev(spark, d)
    first, last = (
        stats.user_stats(events, at, login=F.col("event_type") == "signup").select(*STORED_COLS) for at in (MID, AS_OF)
    )
    path = f"{ensure_checkpoint_dir(spark)}/tidewatch-{uuid.uuid4().hex}/user_stats"
    table = UserTable(spark, path, first.schema, 16)
    table.upsert(first)
    table.upsert(last.filter(F.col("last_event_time") > F.lit(RECENT)))
    return table


@query("stat_table_upsert", f"WITH {STORED} SELECT * FROM stored")
def stat_table_upsert(spark, d):
    return _stored(spark, d).read()


@query("stat_table_deletion", f"WITH {STORED} SELECT * FROM stored WHERE total_purchases <= 10")
def stat_table_deletion(spark, d):
    table = _stored(spark, d)
    table.delete(table.read().filter("total_purchases > 10"))
    return table.read()


@query("stat_of_user", f"WITH {STORED} SELECT * FROM stored WHERE user_id = '7'")
def stat_of_user(spark, d):
    return _stored(spark, d).of("7")


CONTEXT_COLS = """user_id, event_count, view_count, click_count, purchase_count, total_amount, login_fail_count,
  days_since_last_visit"""


def contexts(spark, d):
    return stats.rule_contexts(ev(spark, d), AS_OF, failed())


@query("rule_context", f"WITH {CONTEXTS} SELECT {CONTEXT_COLS} FROM contexts")
def rule_context(spark, d):
    return contexts(spark, d)


def matches(spark, d):
    return match.match(contexts(spark, d), RULES, executed_at=AS_OF)


@query("rule_matches", f"WITH {HITS} SELECT user_id, rule_id, priority, rank FROM matches")
def rule_matches(spark, d):
    return matches(spark, d).select("user_id", "rule_id", "priority", "rank")


@query("rule_matches_chosen", f"""WITH {HITS} SELECT user_id, rule_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) - 1 AS INTEGER) AS rank FROM matches WHERE rule_id IN ('error_share', 'odd_users')""")
def rule_matches_chosen(spark, d):
    rows = match.dry_run(contexts(spark, d), RULES, ["odd_users", "error_share", "none"], AS_OF)
    return rows.select("user_id", "rule_id", "rank")


#: Rules of the same few forms with limits of their own, one for each number.
MANY_RULES = 1_000
MANY_FORMS = (
    "event_count >= {a} and total_amount < {b}",
    "view_count == {c} or click_count in [{c}, {d}]",
    "not (purchase_count > {d} or login_fail_count < {e}) and {a} < event_count <= {a_more}",
    "user_id >= '{f}' and days_since_last_visit != {e} and login_fail_count > {e}.5",
)


def many_rules() -> list[rules.Rule]:
    out = []
    for i in range(MANY_RULES):
        a = 40 + i * 7 % 90
        limits = {"a": a, "a_more": a + 5, "b": 100 + i * 31 % 900, "c": 5 + i * 3 % 25, "d": i * 11 % 30, "e": i * 5 % 17, "f": i * 13 % 997}
        out.append(rules.Rule(f"rule_{i}", f"Rule {i}", MANY_FORMS[i % len(MANY_FORMS)].format(**limits), i % 7))
    return out


_MANY_SQL = f"""WITH {CONTEXTS}, rules AS (
  SELECT i, i % 7 AS priority, 40 + i * 7 % 90 AS a, 100 + i * 31 % 900 AS b, 5 + i * 3 % 25 AS c, i * 11 % 30 AS d,
         i * 5 % 17 AS e, CAST(i * 13 % 997 AS VARCHAR) AS f FROM range({MANY_RULES}) AS r(i)),
matches AS (
  SELECT user_id, i, priority FROM contexts, rules WHERE CASE i % 4
    WHEN 0 THEN event_count >= a AND total_amount < b
    WHEN 1 THEN view_count = c OR click_count IN (c, d)
    WHEN 2 THEN NOT (purchase_count > d OR login_fail_count < e) AND event_count > a AND event_count <= a + 5
    ELSE user_id >= f AND days_since_last_visit <> e AND login_fail_count > e + 0.5 END)"""


@query("rule_index_matches", f"""{_MANY_SQL} SELECT user_id, 'rule_' || CAST(i AS VARCHAR) AS rule_id, CAST(priority AS INTEGER) AS priority,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, i) - 1 AS INTEGER) AS rank FROM matches""")
def rule_index_matches(spark, d):
    found = match.match(contexts(spark, d), many_rules(), executed_at=AS_OF)
    return found.select("user_id", "rule_id", "priority", "rank")


@query("rule_index_validation", f"""{_MANY_SQL}, found AS (SELECT i, count(*) AS n FROM matches GROUP BY i)
SELECT 'rule_' || CAST(r.i AS VARCHAR) AS rule_id, true AS valid, (SELECT count(*) FROM contexts) AS valid_contexts,
  coalesce(n, 0) AS matched_contexts, CAST(NULL AS VARCHAR) AS error FROM rules r LEFT JOIN found f ON f.i = r.i""")
def rule_index_validation(spark, d):
    checked = match.validate(contexts(spark, d), many_rules())
    return checked.select("rule_id", "valid", "valid_contexts", "matched_contexts", "error")


def stored_rules(spark, d):
    """A rule for each product, some of them off, with limits from its sales."""
    k = F.col("k")
    sold = ev(spark, d).groupBy(F.col("product_id").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    given = {
        "id": F.concat(F.lit("item_"), k.cast("string")), "name": F.concat(F.lit("Item "), k.cast("string")),
        "condition": F.format_string("event_count > %d and (purchase_count >= %d or len(user_id) == 1)", 45 + k % 30, F.col("n") % 25),
        "priority": k % 5, "enabled": k % 4 != 0, "version": F.lit(1), "load_order": k,
    }
    return sold.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RULE_COLUMNS.fields])


@query("stored_rule_matches", f"""WITH {CONTEXTS}, rules AS (SELECT k, count(*) AS n FROM ev GROUP BY k)
  SELECT user_id, 'item_' || CAST(k AS VARCHAR) AS rule_id, CAST(k % 5 AS INTEGER) AS priority,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY k % 5 DESC, k) - 1 AS INTEGER) AS rank
  FROM contexts, rules WHERE k % 4 <> 0 AND event_count > 45 + k % 30 AND (purchase_count >= n % 25 OR length(user_id) = 1)""")
def stored_rule_matches(spark, d):
    # rules are written as a table, read back and compiled
    path = f"{ensure_checkpoint_dir(spark)}/tidewatch-{uuid.uuid4().hex}/rules"
    stored_rules(spark, d).write.parquet(path)
    found = match.match(contexts(spark, d), read_rule_table(spark, path), executed_at=AS_OF)
    return found.select("user_id", "rule_id", "priority", "rank")


@query("rule_match_counts", f"WITH {HITS} SELECT rule_id, count(*) AS match_count FROM matches GROUP BY rule_id")
def rule_match_counts(spark, d):
    return match.match_counts(matches(spark, d))


@query("rule_validation", f"""WITH {HITS} SELECT r.rule_id AS rule_id, bool_and(r.ok) AS valid,
  count(*) FILTER (r.ok) AS valid_contexts, count(*) FILTER (r.hit) AS matched_contexts,
  NOT bool_and(r.ok) AS has_error FROM held GROUP BY 1
  UNION ALL SELECT 'switched_off', true, count(*), count(*) FILTER (event_count > 0), false FROM contexts""")
def rule_validation(spark, d):
    rows = match.validate(contexts(spark, d), RULES)
    return rows.select("rule_id", "valid", "valid_contexts", "matched_contexts", F.col("error").isNotNull().alias("has_error"))


def _conditions_sql() -> str:
    return """SELECT c.name AS condition, count(*) FILTER (c.hit) AS matched FROM (SELECT *, unnest([
    {'name': 'ge', 'hit': purchase_count >= 14}, {'name': 'lt', 'hit': total_amount < 300},
    {'name': 'eq', 'hit': view_count = 12}, {'name': 'ne', 'hit': click_count <> 12},
    {'name': 'in', 'hit': event_count IN (60, 61, 62)}, {'name': 'not_in', 'hit': event_count NOT IN (60, 61, 62)},
    {'name': 'contains', 'hit': contains(user_id, '1')}]) AS c FROM contexts) GROUP BY 1"""


@query("structured_conditions", f"WITH {CONTEXTS} {_conditions_sql()}")
def structured_conditions(spark, d):
    texts = {
        "ge": fc("purchase_count", ">=", 14), "lt": fc("total_amount", "<", 300),
        "eq": fc("view_count", "==", 12), "ne": fc("click_count", "!=", 12),
        "in": fc("event_count", "in", [60, 61, 62]), "not_in": fc("event_count", "not_in", [60, 61, 62]),
        "contains": fc("user_id", "contains", "1"),
    }
    rows = match.validate(contexts(spark, d), [rules.Rule(n, n, t) for n, t in texts.items()])
    return rows.select(F.col("rule_id").alias("condition"), F.col("matched_contexts").alias("matched"))


# --- actions ----------------------------------------------------------------

ACTION_SQL = HITS + """, acts AS (
  SELECT user_id, rule_id, unnest(CASE rule_id
    WHEN 'spend_per_event' THEN [{'n': 0, 'type': 'TAG_USER', 'tags': ['good_margin'], 'level': NULL, 'error': NULL}]
    WHEN 'error_share' THEN [{'n': 0, 'type': 'TAG_USER', 'tags': ['many_errors'], 'level': NULL, 'error': NULL},
                             {'n': 1, 'type': 'TRIGGER_AUDIT', 'tags': NULL, 'level': 'LOW', 'error': NULL}]
    WHEN 'looks_only' THEN [{'n': 0, 'type': 'ALERT', 'tags': NULL, 'level': NULL, 'error': 'No handler registered for action type: ALERT'},
                            {'n': 1, 'type': 'TAG_USER', 'tags': ['window_shopper', 'no_checkout'], 'level': NULL, 'error': NULL},
                            {'n': 2, 'type': 'TRIGGER_AUDIT', 'tags': NULL, 'level': 'CRITICAL', 'error': NULL}]
    WHEN 'gone_quiet' THEN [{'n': 0, 'type': 'TAG_USER', 'tags': ['quiet'], 'level': NULL, 'error': NULL}]
    WHEN 'click_share' THEN [{'n': 0, 'type': 'TAG_USER', 'tags': NULL, 'level': NULL, 'error': 'Missing tags parameter'}]
    END) AS a FROM matches)"""


@query("action_results", f"""WITH {ACTION_SQL} SELECT user_id, rule_id, a.n AS action_no, a.type AS type,
  a.error IS NULL AS success, a.error AS error FROM acts""")
def action_results(spark, d):
    rows = actions.default_registry().rows(matches(spark, d))
    return rows.select(
        "user_id", "rule_id", "action.action_no", "action.type", F.col("error").isNull().alias("success"), "error"
    )


@query("match_results", f"""WITH {ACTION_SQL}, done AS (
  SELECT user_id, rule_id, count(*) AS actions, count(*) FILTER (a.error IS NULL) AS succeeded,
    max('Action execution failed: ' || a.error) FILTER (a.type <> 'ALERT') AS error FROM acts GROUP BY ALL)
  SELECT m.user_id, m.rule_id, coalesce(actions, 0) AS actions, coalesce(succeeded, 0) AS succeeded, error
  FROM matches m LEFT JOIN done USING (user_id, rule_id)""")
def match_results(spark, d):
    rows = actions.default_registry().results(matches(spark, d))
    done = F.col("actions_executed")
    return rows.select(
        "user_id", "rule_id", F.size(done).cast("bigint").alias("actions"),
        F.size(F.filter(done, lambda a: a["success"])).cast("bigint").alias("succeeded"), "error",
    )


@query("tag_actions", f"""WITH {ACTION_SQL} SELECT user_id, unnest(a.tags) AS tag_name, 'true' AS value, 'RULE' AS source, 1.0::DOUBLE AS confidence,
  CASE WHEN rule_id = 'error_share' THEN {AT_SQL} + INTERVAL 1 DAY END AS expire_at, {AT_SQL} AS ts, false AS deleted
  FROM acts WHERE a.type = 'TAG_USER' AND a.error IS NULL""")
def tag_actions(spark, d):
    return actions.default_registry().run(matches(spark, d), "TAG_USER").drop("seq")


@query("audit_actions", f"""WITH {ACTION_SQL} SELECT user_id, rule_id, a.level AS audit_level, 'pending' AS status,
  CASE WHEN rule_id = 'error_share' THEN 'one event in five fails' ELSE 'Rule triggered audit' END AS reason,
  event_count AS context_events, {AT_SQL} AS create_time
  FROM acts JOIN contexts USING (user_id) WHERE a.type = 'TRIGGER_AUDIT'""")
def audit_actions(spark, d):
    rows = actions.default_registry().run(matches(spark, d), "TRIGGER_AUDIT")
    data = F.col("trigger_data")
    return rows.select(
        "user_id", "rule_id", "audit_level", "status", F.get_json_object(data, "$.reason").alias("reason"),
        F.get_json_object(data, "$.context.event_count").cast("bigint").alias("context_events"), "create_time",
    )


@query("tags_set_by_rule", f"""WITH {CONTEXTS}{TAGS[len(EV):]}, users AS (SELECT user_id FROM contexts WHERE event_count > 70)
  SELECT user_id, tag_name, value, source, ts FROM tags WHERE user_id NOT IN (SELECT user_id FROM users)
  UNION ALL SELECT user_id, unnest(['pref_1', 'fresh']), 'true', 'RULE', {AT_SQL} FROM users""")
def tags_set_by_rule(spark, d):
    rule = rules.Rule("reset", "Reset", "event_count > 70",
                      actions=(rules.Action("TAG_USER", {"tags": ["pref_1", "fresh"], "action": "set"}),))
    hits = match.match(contexts(spark, d), [rule], executed_at=AS_OF)
    done = actions.default_registry().run(hits, "TAG_USER")
    now = tags.current_tags(tag_changes(ev(spark, d)).unionByName(done))
    return now.select("user_id", "tag_name", "value", "source", "ts")


@query("tags_by_order", f"""WITH {CONTEXTS} SELECT user_id, 'watched' AS tag_name, {AT_SQL} AS ts FROM contexts WHERE event_count > 60
  UNION ALL SELECT user_id, 'last', {AT_SQL} FROM contexts WHERE event_count > 60""")
def tags_by_order(spark, d):
    """Several rules and actions change one user's tags at one instant; the last by place holds."""
    act = lambda kind, *names: rules.Action("TAG_USER", {"tags": names, "action": kind})
    chosen = [
        rules.Rule("late", "Late", "event_count > 60", 1, actions=(act("add", "watched"), act("set", "first"), act("set", "watched"), act("add", "last"))),
        rules.Rule("early", "Early", "event_count > 50", 2, actions=(act("add", "watched"), act("remove", "watched"))),
    ]
    hits = match.match(contexts(spark, d), chosen, executed_at=AS_OF)
    return tags.current_tags(actions.default_registry().run(hits, "TAG_USER")).select("user_id", "tag_name", "ts")


BATCH_SQL = EV + """, asked AS (SELECT CASE WHEN k % 9 = 0 THEN '' ELSE user_id END AS user_id, k, "timestamp" FROM ev)"""


def _batch(spark, d):
    k = F.col("product_id").cast("bigint")
    return ev(spark, d).select(
        F.when(k % 9 == 0, F.lit("")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("b1"), F.lit("b2"))).alias("tags"),
        F.when(k % 3 == 0, F.lit("HIGH")).when(k % 3 == 1, F.lit("high")).alias("level"),
        F.concat(F.lit("r"), (k % 3).cast("string")).alias("rule_id"), "timestamp",
    )


@query("batch_tagging", f"""WITH {BATCH_SQL} SELECT user_id, CASE WHEN user_id = '' OR k % 5 = 0 THEN 'error' ELSE 'success' END AS status,
  count(*) AS requests FROM asked GROUP BY ALL""")
def batch_tagging(spark, d):
    rows = actions.batch_tag_status(_batch(spark, d))
    return rows.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("requests"))


@query("batch_tag_changes", f"""WITH {BATCH_SQL} SELECT user_id, unnest(['b1', 'b2']) AS tag_name, 'true' AS value, 'RULE' AS source,
  1.0::DOUBLE AS confidence, CAST(NULL AS TIMESTAMP) AS expire_at, "timestamp" AS ts, false AS deleted FROM asked WHERE user_id <> '' AND k % 5 <> 0""")
def batch_tag_changes(spark, d):
    return actions.batch_tag_changes(_batch(spark, d), F.col("timestamp")).drop("seq")


@query("batch_audit", f"""WITH {BATCH_SQL} SELECT user_id, 'r' || CAST(k % 3 AS VARCHAR) AS rule_id,
  CASE WHEN k % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS audit_level, "timestamp" AS create_time FROM asked WHERE user_id <> ''""")
def batch_audit(spark, d):
    rows = actions.batch_audit_orders(_batch(spark, d), F.col("timestamp"))
    return rows.select("user_id", "rule_id", "audit_level", "create_time")


# --- the rule table, derived from the events as a log of changes --------------

RULE_LOG = EV + """, log AS (
  SELECT 'rule_' || user_id AS id, "timestamp" AS ts, event_type, k,
    CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' AND k % 4 = 0 THEN 'delete' ELSE 'update' END AS op
  FROM ev), births AS (
  SELECT id, max(ts) AS born, arg_max(op, ts) AS op FROM log WHERE op <> 'update' GROUP BY id), live AS (
  SELECT l.* FROM log l JOIN births b USING (id) WHERE b.op = 'create' AND l.ts >= b.born), rules_r AS (
  SELECT id, arg_max('Rule ' || CAST(k AS VARCHAR), ts) FILTER (op = 'create' OR event_type = 'view') AS name,
    arg_max(k % 4, ts) FILTER (op = 'create' OR event_type = 'click') AS priority,
    arg_max(k % 3 <> 0, ts) FILTER (op = 'create' OR event_type = 'purchase') AS enabled,
    arg_max(CASE WHEN k % 2 = 0 THEN ['even', 'all'] ELSE ['all'] END, ts) FILTER (op = 'create' OR event_type = 'error') AS tags,
    CAST(count(*) FILTER (op = 'update') + 1 AS INTEGER) AS version, min(ts) AS created_at, max(ts) AS updated_at
  FROM live GROUP BY id)"""


def rule_table(spark, d):
    k, kind = F.col("product_id").cast("bigint"), F.col("event_type")
    op = F.when(kind == "signup", "create").when((kind == "error") & (k % 4 == 0), "delete").otherwise("update")
    given = lambda t, c: F.when((kind == "signup") | (kind == t), c)
    marks = F.when(k % 2 == 0, F.array(F.lit("even"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    log = ev(spark, d).select(
        F.concat(F.lit("rule_"), F.col("user_id")).alias("id"), F.col("timestamp").alias("ts"), op.alias("op"),
        given("view", F.concat(F.lit("Rule "), k.cast("string"))).alias("name"),
        F.lit(None).cast("string").alias("description"), given("view", F.lit("event_count > 0")).alias("condition"),
        given("click", (k % 4).cast("int")).alias("priority"), given("purchase", k % 3 != 0).alias("enabled"),
        F.lit(None).cast("string").alias("actions"), given("error", marks).alias("tags"),
        F.lit(None).cast("string").alias("created_by"),
    )
    return rules.rule_changes_applied(log)


@query("rule_upkeep", f"""WITH {RULE_LOG} SELECT id, name, CAST(priority AS INTEGER) AS priority, enabled,
  array_to_string(tags, ',') AS tags, version, created_at, updated_at FROM rules_r""")
def rule_upkeep(spark, d):
    return rule_table(spark, d).select(
        "id", "name", "priority", "enabled", F.array_join("tags", ",").alias("tags"), "version", "created_at", "updated_at"
    )


@query("rule_list", f"""WITH {RULE_LOG} SELECT id, name, CAST(priority AS INTEGER) AS priority FROM rules_r
  WHERE enabled AND list_contains(tags, 'even') ORDER BY rules_r.priority DESC, id LIMIT 20 OFFSET 5""")
def rule_list(spark, d):
    return rules.list_rules(rule_table(spark, d), True, "even", 20, 5).select("id", "name", "priority")


@query("rule_search", f"""WITH {RULE_LOG} SELECT id, name FROM rules_r WHERE lower(name) LIKE '%rule 1%' AND priority = 1""")
def rule_search(spark, d):
    return rules.search_rules(rule_table(spark, d), "rULE 1", 1).select("id", "name")


@query("rule_by_id", f"WITH {RULE_LOG} SELECT id, name, version FROM rules_r WHERE id = 'rule_1'")
def rule_by_id(spark, d):
    return rules.rule_of(rule_table(spark, d), "rule_1").select("id", "name", "version")


@query("rule_stats", f"""WITH {RULE_LOG} SELECT count(*) AS total_rules, count(*) FILTER (enabled) AS enabled_rules,
  count(*) FILTER (NOT enabled) AS disabled_rules FROM rules_r""")
def rule_stats(spark, d):
    return rules.rule_stats(rule_table(spark, d))


@query("rules_by_tag", f"""WITH {RULE_LOG} SELECT tag, count(*) AS rule_count
  FROM (SELECT unnest(tags) AS tag FROM rules_r) GROUP BY tag""")
def rules_by_tag(spark, d):
    return rules.rules_by_tag(rule_table(spark, d))


@query("rules_by_priority", f"WITH {RULE_LOG} SELECT CAST(priority AS INTEGER) AS priority, count(*) AS rule_count FROM rules_r GROUP BY 1")
def rules_by_priority(spark, d):
    return rules.rules_by_priority(rule_table(spark, d))


# --- every construct of a condition, as text and as SQL -------------------------

CONSTRUCTS = {
    "chain": ("60 <= event_count < 70", "event_count >= 60 AND event_count < 70"),
    "arithmetic": ("view_count + click_count * 2 - 1 > 40", "view_count + click_count * 2 - 1 > 40"),
    "division": ("total_amount / (purchase_count - 10) > 100", "purchase_count <> 10 AND total_amount / nullif(purchase_count - 10, 0) > 100"),
    "floor_division": ("(view_count - 15) // 4 == -1", "floor((view_count - 15) / 4.0) = -1"),
    "modulo": ("(view_count - 15) % 4 == 3", "(((view_count - 15) % 4) + 4) % 4 = 3"),
    "power": ("view_count ** 2 > 150", "view_count * view_count > 150"),
    "negation": ("not -click_count < -12", "NOT (-click_count < -12)"),
    "membership": ("view_count in [10, 12, 14] and user_id not in ('3', '5')", "view_count IN (10, 12, 14) AND user_id NOT IN ('3', '5')"),
    "text": ("'1' in user_id and len(user_id) == 2", "contains(user_id, '1') AND length(user_id) = 2"),
    "text_parts": ("user_id[0] == '1' or user_id[-1] == '9'", "user_id[1] = '1' OR user_id[-1] = '9'"),
    "concatenation": ("'u' + user_id == 'u7'", "user_id = '7'"),
    "choice": ("(total_amount if purchase_count > 12 else event_count) > 70", "CASE WHEN purchase_count > 12 THEN total_amount ELSE event_count END > 70"),
    "mixed_choice": ("('many' if event_count > 66 else 0) == 'many'", "event_count > 66"),
    "list_part": ("[10, 'x', view_count][2] == 12", "view_count = 12"),
    "dict_part": ("{'7': 1, '8': 2}[user_id] == 2", "user_id = '8'"),
    "casts": ("int(user_id) % 10 == 3 and float(user_id) > 20 and str(view_count) == '12'", "CAST(user_id AS BIGINT) % 10 = 3 AND CAST(user_id AS DOUBLE) > 20 AND view_count = 12"),
    "extremes": ("max(view_count, click_count) - min(view_count, click_count) > 6", "abs(view_count - click_count) > 6"),
    "sums": ("sum([view_count, click_count, purchase_count]) > 42 and abs(view_count - 12) < 3", "view_count + click_count + purchase_count > 42 AND abs(view_count - 12) < 3"),
    "quantifiers": ("any([view_count > 18, click_count > 18]) or all([view_count < 10, click_count < 10])", "view_count > 18 OR click_count > 18 OR (view_count < 10 AND click_count < 10)"),
    "truth": ("bool(click_count - 12) and user_id and not None", "click_count <> 12"),
    "equal_types": ("user_id == 7 or view_count == '12'", "false"),
    "lists": ("[view_count, click_count] == [12, 12] or len(set([view_count, click_count])) == 1", "view_count = click_count"),
    "eager_error": ("event_count > 0 or 1 / 0", "false"),
    "lazy_chain": ("event_count < 0 < missing or event_count > 66", "event_count > 66"),
    "large_powers": ("event_count ** 12 % 7 == 1 and event_count ** 20 > 60 ** 20", "event_count % 7 <> 0 AND event_count > 60"),
    "large_products": ("view_count * 10**18 == 12 * 10**18 or click_count * 10**19 // 10**18 > 180", "view_count = 12 OR click_count * 10 > 180"),
    "repeated_length": ("len(user_id * 5000000) > 10000000", "length(user_id) > 2"),
    "filled_text": ("'%s-%d%%' % (user_id, view_count) == '7-%s%%' % view_count", "user_id = '7'"),
    "equal_dicts": ("{'v': view_count, 'c': click_count} == {'c': 12, 'v': click_count}", "click_count = 12 AND view_count = 12"),
    "refused": ("(lambda: 1)() or event_count.real", "false"),
}


@query("condition_constructs", f"""WITH {CONTEXTS} SELECT c.name AS construct, count(*) FILTER (c.hit) AS matched FROM (
  SELECT unnest([{", ".join(f"{{'name': '{n}', 'hit': coalesce({sql}, false)}}" for n, (_, sql) in CONSTRUCTS.items())}]) AS c
  FROM contexts) GROUP BY 1""")
def condition_constructs(spark, d):
    rows = match.validate(contexts(spark, d), [rules.Rule(n, n, text) for n, (text, _) in CONSTRUCTS.items()])
    return rows.select(F.col("rule_id").alias("construct"), F.col("matched_contexts").alias("matched"))


@query("batch_audit_status", f"""WITH {BATCH_SQL} SELECT user_id, CASE WHEN user_id = '' THEN 'error' ELSE 'success' END AS status,
  count(*) AS requests FROM asked GROUP BY ALL""")
def batch_audit_status(spark, d):
    rows = actions.batch_audit_status(_batch(spark, d))
    return rows.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("requests"))
