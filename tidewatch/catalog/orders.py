"""Review orders and activity."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.catalog.base import (
    EV, HITS, MID, ORDERS, REQUESTS, TAGS, ev, query, review_orders, review_requests, tag_changes,
    user_orders,
)
from tidewatch.catalog.users import matches
from tidewatch.functions.values import trigger_summary
from tidewatch.operators import activity, audit

COLS = ["id", "user_id", "rule_id", "audit_level", "status", "assignee", "create_time"]
COLS_SQL = ", ".join(COLS)
FAR = 'TIMESTAMP \'2024-01-15\''


def _orders(spark, d):
    return review_orders(ev(spark, d))


@query("audit_orders", f"WITH {ORDERS} SELECT {COLS_SQL}, trigger_data FROM orders_r")
def audit_orders(spark, d):
    return _orders(spark, d).select(*COLS, "trigger_data")


@query("audit_list_page", f"""WITH {ORDERS} SELECT {COLS_SQL} FROM orders_r WHERE status = 'pending' AND assignee = 'rev1'
  ORDER BY create_time DESC, id LIMIT 20 OFFSET 20""")
def audit_list_page(spark, d):
    return audit.list_page(_orders(spark, d), status="pending", assignee="rev1", number=2).select(*COLS)


@query("audit_list_total", f"WITH {ORDERS} SELECT count(*) AS total FROM orders_r WHERE status = 'pending' AND assignee = 'rev1'")
def audit_list_total(spark, d):
    return audit.list_total(_orders(spark, d), status="pending", assignee="rev1")


@query("audit_list_user", f"WITH {ORDERS} SELECT {COLS_SQL} FROM orders_r WHERE user_id = '7' ORDER BY create_time DESC, id LIMIT 20")
def audit_list_user(spark, d):
    return audit.list_page(_orders(spark, d), user_id="7").select(*COLS)


@query("audit_todo", f"""WITH {ORDERS} SELECT {COLS_SQL} FROM orders_r
  WHERE assignee = 'rev2' AND status IN ('pending', 'in_review')""")
def audit_todo(spark, d):
    return audit.todo(_orders(spark, d), "rev2").select(*COLS)


@query("audit_todo_lexical", f"""WITH {ORDERS} SELECT {COLS_SQL} FROM orders_r
  WHERE assignee = 'rev2' AND status IN ('pending', 'in_review') """)
def audit_todo_lexical(spark, d):
    return audit.todo(_orders(spark, d), "rev2", lexical=True).select(*COLS)


@query("audit_unassigned", f"""WITH {ORDERS} SELECT {COLS_SQL} FROM orders_r
  WHERE status = 'pending' AND assignee IS NULL""")
def audit_unassigned(spark, d):
    return audit.unassigned(_orders(spark, d)).select(*COLS)


@query("audit_by_level", f"WITH {ORDERS} SELECT {COLS_SQL} FROM orders_r WHERE audit_level = 'HIGH'")
def audit_by_level(spark, d):
    return audit.by_level(_orders(spark, d), "high", "level").select(*COLS)


@query("audit_by_id", f"WITH {ORDERS} SELECT {COLS_SQL} FROM orders_r WHERE id = (SELECT min(id) FROM orders_r WHERE user_id = '7')")
def audit_by_id(spark, d):
    orders = _orders(spark, d)
    order = orders.filter(F.col("user_id") == "7").agg(F.min("id")).first()[0]
    return audit.by_id(orders, order).select(*COLS)


@query("audit_next_statuses", f"""WITH {ORDERS} SELECT id, status, CASE status WHEN 'pending' THEN 'in_review,closed'
  WHEN 'in_review' THEN 'approved,rejected,pending' WHEN 'approved' THEN 'closed' WHEN 'rejected' THEN 'closed,in_review'
  ELSE '' END AS next_statuses, status IN ('pending', 'approved', 'rejected') AS can_close FROM orders_r""")
def audit_next_statuses(spark, d):
    status = F.col("status")
    return _orders(spark, d).select(
        "id", "status", F.array_join(audit.next_statuses(status), ",").alias("next_statuses"),
        audit.can_move(status, F.lit("closed")).alias("can_close"),
    )


@query("audit_todo_top", f"""WITH {ORDERS} SELECT {COLS_SQL} FROM orders_r
  WHERE assignee = 'rev2' AND status IN ('pending', 'in_review') ORDER BY severity DESC, create_time, id LIMIT 25""")
def audit_todo_top(spark, d):
    return audit.todo(_orders(spark, d), "rev2").limit(25).select(*COLS)


@query("audit_replay", f"""WITH RECURSIVE {EV}, {REQUESTS}
  SELECT order_id, seq, action, status_before, accepted, status_after FROM outcome""")
def audit_replay(spark, d):
    events = ev(spark, d)
    done = audit.replay(user_orders(events), review_requests(events)).filter("status_before is not null")
    return done.select("order_id", "seq", "action", "status_before", "accepted", "status_after")


@query("audit_replayed_orders", f"""WITH RECURSIVE {EV}, {REQUESTS}, firsts AS (
  SELECT 'u' || user_id AS id, min("timestamp") AS at FROM ev WHERE event_type = 'purchase' GROUP BY user_id), ends AS (
  SELECT order_id, arg_max(status_after, seq) AS status, arg_max(assignee, seq) FILTER (assignee IS NOT NULL AND action <> 'close') AS assignee,
    arg_max(note, seq) FILTER (note IS NOT NULL AND action IN ('review', 'close')) AS note, max(request_time) AS at
  FROM outcome WHERE accepted GROUP BY order_id)
  SELECT id, coalesce(status, 'pending') AS status, assignee, note AS reviewer_note, coalesce(ends.at, firsts.at) AS update_time
  FROM firsts LEFT JOIN ends ON order_id = id""")
def audit_replayed_orders(spark, d):
    events = ev(spark, d)
    done = audit.apply_requests(user_orders(events), review_requests(events))
    return done.select("id", "status", "assignee", "reviewer_note", "update_time")


@query("audit_batch_assign", f"""WITH {ORDERS} SELECT id, 'in_review' AS status, 'lead' AS assignee, {FAR} AS update_time
  FROM orders_r WHERE status = 'pending' AND k < 30""")
def audit_batch_assign(spark, d):
    events = ev(spark, d)
    ids = events.filter(F.col("product_id").cast("int") < 30).select(F.concat(F.lit("o"), F.col("event_id")).alias("order_id"))
    done = audit.batch_assign(review_orders(events), ids, "lead", MID)
    return done.select("id", "status", "assignee", "update_time")


@query("audit_delete", f"WITH {ORDERS} SELECT id, status FROM orders_r WHERE k >= 30")
def audit_delete(spark, d):
    events = ev(spark, d)
    ids = events.filter(F.col("product_id").cast("int") < 30).select(F.concat(F.lit("o"), F.col("event_id")).alias("order_id"))
    return audit.delete_orders(review_orders(events), ids).select("id", "status")


@query("audit_status_counts", f"""WITH {ORDERS}, names AS (SELECT unnest(['pending', 'in_review', 'approved', 'rejected', 'closed']) AS status)
  SELECT status, count(id) AS order_count FROM names LEFT JOIN orders_r USING (status) GROUP BY status""")
def audit_status_counts(spark, d):
    return audit.status_counts(_orders(spark, d))


@query("audit_level_counts", f"""WITH {ORDERS}, names AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS audit_level),
  open AS (SELECT * FROM orders_r WHERE status IN ('pending', 'in_review'))
  SELECT audit_level, count(id) AS order_count FROM names LEFT JOIN open USING (audit_level) GROUP BY audit_level""")
def audit_level_counts(spark, d):
    return audit.open_level_counts(_orders(spark, d))


@query("audit_today", f"WITH {ORDERS} SELECT count(*) AS today_count FROM orders_r WHERE create_time >= TIMESTAMP '2024-01-20'")
def audit_today(spark, d):
    return audit.created_today(_orders(spark, d), datetime(2024, 1, 20, 15, 30))


@query("trigger_summaries", f"WITH {ORDERS} SELECT id, 'k: ' || CAST(k AS VARCHAR) AS summary FROM orders_r")
def trigger_summaries(spark, d):
    return _orders(spark, d).select("id", trigger_summary(F.col("trigger_data")).alias("summary"))


HITS_REST = HITS[len(EV):]
TAGS_REST = TAGS[len(EV):]
FEED = ORDERS + HITS_REST + TAGS_REST + """, feed AS (
  SELECT id, 'audit_complete' AS type, 'Audit ' || status AS title, 'Order for ' || user_id || ' - ' || audit_level AS description,
         create_time AS "timestamp" FROM orders_r
  UNION ALL SELECT rule_id || ':' || user_id, 'rule_trigger', 'Rule triggered', rule_id || ' for ' || user_id, TIMESTAMP '2024-01-30 12:00:00' FROM matches
  UNION ALL SELECT user_id || ':' || tag_name, 'tag_update', 'Tag updated',
         tag_name || CASE WHEN deleted THEN ' tag removed from ' ELSE ' tag added to ' END || user_id, ts FROM changes)"""


def _parts(spark, d):
    events = ev(spark, d)
    hits = matches(spark, d).withColumn("executed_at", F.lit(datetime(2024, 1, 30, 12)).cast("timestamp"))
    return review_orders(events), hits, tag_changes(events)


@query("recent_activity", f"""WITH {FEED} SELECT * FROM feed ORDER BY "timestamp" DESC, type, id LIMIT 8""")
def recent_activity(spark, d):
    return activity.recent_activity(*_parts(spark, d))


@query("activity_counters", f"""WITH {FEED}
  SELECT 'events' AS counter, event_type AS label, 'log' AS detail, count(*) AS total FROM ev GROUP BY 1, 2, 3
  UNION ALL SELECT 'rule_matches', rule_id, '', count(*) FROM matches GROUP BY 1, 2, 3
  UNION ALL SELECT 'orders', status, audit_level, count(*) FROM orders_r GROUP BY 1, 2, 3
  UNION ALL SELECT 'tag_changes', CASE WHEN deleted THEN 'remove' ELSE 'add' END, source, count(*) FROM changes GROUP BY 1, 2, 3""")
def activity_counters(spark, d):
    orders, hits, changes = _parts(spark, d)
    return activity.activity_counters(ev(spark, d), hits, orders, changes)
