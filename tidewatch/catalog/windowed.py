"""Windows, sessions and burst detection."""

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.catalog.base import EV, MID, ev, failed, query
from tidewatch.operators import detect, windows
from tidewatch.session import ensure_checkpoint_dir

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
SESSION_GAP, SESSION_MAX = timedelta(hours=6), timedelta(hours=10)
# detector limits that the sparse benchmark events reach


def bursts():
    kind = F.col("event_type")
    return [
        detect.Burst("high_frequency_operation", "medium", 6, DAY, F.lit(True)),
        detect.Burst("rapid_click", "low", 3, 2 * DAY, kind == "click"),
        detect.Burst("unusual_purchase_pattern", "medium", 1, 10 * DAY, kind == "purchase", "product_id"),
    ]


@query("tumbling_offset_counts", f"""WITH {EV} SELECT user_id,
  time_bucket(INTERVAL 1 HOUR, "timestamp", TIMESTAMP '1970-01-01 00:30:00') AS window_start,
  time_bucket(INTERVAL 1 HOUR, "timestamp", TIMESTAMP '1970-01-01 00:30:00') + INTERVAL 1 HOUR AS window_end,
  count(*) AS event_count FROM ev GROUP BY ALL""")
def tumbling_offset_counts(spark, d):
    rows = windows.tumbling(ev(spark, d), HOUR, timedelta(minutes=30))
    return rows.groupBy("user_id", "window_start", "window_end").agg(F.count(F.lit(1)).alias("event_count"))


SLIDES = """spread AS (
  SELECT ev.*, time_bucket(INTERVAL 1 HOUR, "timestamp") - to_hours(CAST(i AS INTEGER)) AS window_start
  FROM ev, range(6) r(i))"""


@query("sliding_counts", f"""WITH {EV}, {SLIDES} SELECT user_id, window_start,
  window_start + INTERVAL 6 HOUR AS window_end, count(*) AS event_count,
  round(sum(value), 2) AS value FROM spread GROUP BY ALL""")
def sliding_counts(spark, d):
    rows = windows.sliding_totals(ev(spark, d), ["user_id"], 6 * HOUR, HOUR, ("value",))
    return rows.withColumn("value", F.round("value", 2))


@query("sliding_assignment", f"""WITH {EV}, {SLIDES} SELECT event_id, window_start,
  window_start + INTERVAL 6 HOUR AS window_end FROM spread""")
def sliding_assignment(spark, d):
    return windows.sliding(ev(spark, d), 6 * HOUR, HOUR).select("event_id", "window_start", "window_end")


@query("window_aggregates", f"""WITH {EV} SELECT user_id, time_bucket(INTERVAL 1 DAY, "timestamp", TIMESTAMP '1970-01-01') AS window_start,
  count(*) AS event_count, round(sum(coalesce(amount, 0)), 2) AS amount_sum, round(avg(coalesce(amount, 0)), 8) AS amount_avg,
  min(coalesce(amount, 0)) AS amount_min, max(coalesce(amount, 0)) AS amount_max, count(DISTINCT amount) AS amount_distinct
  FROM ev GROUP BY ALL""")
def window_aggregates(spark, d):
    rows = windows.tumbling(ev(spark, d), DAY)
    out = rows.groupBy("user_id", "window_start").agg(*windows.field_aggregates("amount"))
    return out.withColumns({"amount_sum": F.round("amount_sum", 2), "amount_avg": F.round("amount_avg", 8)})


@query("window_content_runs", f"""WITH {EV}, w AS (
  SELECT user_id, event_id, us, time_bucket(INTERVAL 10 DAY, "timestamp", TIMESTAMP '1970-01-01') AS window_start FROM ev),
  placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY us, event_id) - 1 AS position FROM w)
  SELECT user_id, window_start, position // 5 AS run, string_agg(event_id, ',' ORDER BY position) AS event_ids FROM placed GROUP BY ALL""")
def window_content_runs(spark, d):
    rows = windows.tumbling(ev(spark, d).select("user_id", "event_id", "timestamp"), 10 * DAY)
    runs = windows.content_runs(windows.ordered_contents(rows, ["user_id"]), ["user_id"], 5)
    return runs.select("user_id", "window_start", "run", F.concat_ws(",", "values.event_id").alias("event_ids"))


@query("sliding_distinct_users", f"""WITH {EV}, {SLIDES} SELECT window_start, count(*) AS event_count,
  count(DISTINCT user_id) AS users, true AS within_bound FROM spread GROUP BY window_start""")
def sliding_distinct_users(spark, d):
    # the estimate stands beside the exact number, which it has to be near
    events = ev(spark, d)
    guess = windows.sliding_distinct(events, [], "user_id", 6 * HOUR, HOUR)
    exact = windows.sliding(events, 6 * HOUR, HOUR).groupBy("window_start").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("distinct_count") - F.col("users")) <= windows.distinct_error() * F.col("users")
    return guess.join(exact, "window_start").select("window_start", "event_count", "users", near.alias("within_bound"))


@query("distinct_users_of_range", f"""WITH {EV} SELECT event_type, count(*) AS event_count, count(DISTINCT user_id) AS users,
  true AS within_bound FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-08' AND "timestamp" < TIMESTAMP '2024-01-22' GROUP BY event_type""")
def distinct_users_of_range(spark, d):
    # two weeks from a stored table of one sketch an hour and type
    events = ev(spark, d)
    path = f"{ensure_checkpoint_dir(spark)}/tidewatch-{uuid.uuid4().hex}/sketches"
    windows.distinct_sketches(events, ["event_type"], "user_id", HOUR).write.parquet(path)
    weeks = [(F.col(c) >= F.lit(MID - 7 * DAY)) & (F.col(c) < F.lit(MID + 7 * DAY)) for c in ("window_start", "timestamp")]
    guess = windows.merged_distinct(spark.read.parquet(path).filter(weeks[0]), ["event_type"])
    exact = events.filter(weeks[1]).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("distinct_count") - F.col("users")) <= windows.distinct_error() * F.col("users")
    return guess.join(exact, "event_type").select("event_type", "event_count", "users", near.alias("within_bound"))


@query("late_events_dropped", f"""WITH {EV}, w AS (
  SELECT event_id, time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR AS window_end FROM ev)
  SELECT event_id, window_end FROM w WHERE TIMESTAMP '2024-01-15' - window_end <= INTERVAL 36 HOUR""")
def late_events_dropped(spark, d):
    rows = windows.on_time(windows.tumbling(ev(spark, d), HOUR), MID, timedelta(hours=36))
    return rows.select("event_id", "window_end")


@query("expired_windows", f"""WITH {EV}, w AS (
  SELECT user_id, time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR AS window_end, count(*) AS event_count
  FROM ev GROUP BY ALL)
  SELECT * FROM w WHERE TIMESTAMP '2024-01-15' > window_end + INTERVAL 30 MINUTE""")
def expired_windows(spark, d):
    rows = windows.tumbling(ev(spark, d), HOUR).groupBy("user_id", "window_end").agg(F.count(F.lit(1)).alias("event_count"))
    return windows.expired(rows, MID, timedelta(minutes=30))


@query("triggered_window", f"""WITH {EV}, one AS (
  SELECT user_id, time_bucket(INTERVAL 1 DAY, max("timestamp")) AS window_start FROM ev WHERE user_id = (SELECT min(user_id) FROM ev) GROUP BY user_id)
  SELECT user_id, window_start, count(*) AS event_count FROM ev JOIN one USING (user_id)
  WHERE "timestamp" >= window_start AND "timestamp" < window_start + INTERVAL 1 DAY GROUP BY ALL""")
def triggered_window(spark, d):
    # the last window of a user, taken before its time
    events = ev(spark, d)
    user, last = events.groupBy("user_id").agg(F.max("timestamp")).orderBy("user_id").first()
    start = datetime(last.year, last.month, last.day)
    rows = windows.tumbling(events, DAY).groupBy("user_id", "window_start", "window_end").agg(
        F.count(F.lit(1)).alias("event_count"))
    return windows.one_window(rows, F.col("user_id") == user, start, start + DAY).select("user_id", "window_start", "event_count")


SESSIONS = EV + """, gaps AS (
  SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 21600000000, true) AS is_new FROM ev),
  numbered AS (SELECT *, sum(CAST(is_new AS BIGINT)) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session_no FROM gaps),
  sessions AS (SELECT user_id, session_no, min("timestamp") AS session_start,
    max("timestamp") + INTERVAL 6 HOUR AS session_end, count(*) AS event_count, round(sum(value), 2) AS value
    FROM numbered GROUP BY user_id, session_no)"""


@query("session_counts", f"""WITH {SESSIONS}
  SELECT user_id, session_start, session_end, event_count, value FROM sessions""")
def session_counts(spark, d):
    rows = windows.session_windows(ev(spark, d), "user_id", SESSION_GAP, ("value",))
    return rows.withColumn("value", F.round("value", 2))


@query("new_session_flags", f"""WITH {SESSIONS} SELECT event_id, user_id, is_new AS is_new_session FROM numbered""")
def new_session_flags(spark, d):
    return windows.new_session_flags(ev(spark, d), "user_id", SESSION_GAP).select("event_id", "user_id", "is_new_session")


@query("inactive_sessions", f"""WITH {SESSIONS} SELECT user_id, session_start, session_end, event_count FROM sessions
  WHERE TIMESTAMP '2024-01-15' - session_end > INTERVAL 12 HOUR""")
def inactive_sessions(spark, d):
    rows = windows.session_windows(ev(spark, d), "user_id", SESSION_GAP)
    return windows.inactive_sessions(rows, MID, timedelta(hours=12))


@query("sessions_closed_by_hand", f"""WITH {EV}, marks AS (
  SELECT user_id, us, event_id, value, event_type = 'signup' AS is_close FROM ev), marked AS (
  SELECT *, lag(us) OVER w AS before_us, lag(is_close) OVER w AS before_close FROM marks
  WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
  SELECT event_id, user_id, coalesce(us - before_us > 21600000000 OR before_close, true) AS is_new_session
  FROM marked WHERE NOT is_close""")
def sessions_closed_by_hand(spark, d):
    rows = ev(spark, d)
    closes = rows.filter(F.col("event_type") == "signup")
    kept = rows.filter(F.col("event_type") != "signup")
    out = windows.new_session_flags(kept, "user_id", SESSION_GAP, closes=closes)
    return out.select("event_id", "user_id", "is_new_session")


CAPPED = EV + """, numbered AS (
  SELECT event_id, user_id, us, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM ev), walk AS (
  SELECT event_id, user_id, us, value, rn, us AS start_us, true AS is_new FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.event_id, n.user_id, n.us, n.value, n.rn,
    CASE WHEN n.us - w.us > 21600000000 OR n.us - w.start_us > 36000000000 THEN n.us ELSE w.start_us END,
    n.us - w.us > 21600000000 OR n.us - w.start_us > 36000000000
  FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.rn = w.rn + 1)"""


@query("session_max_length", f"""WITH RECURSIVE {CAPPED} SELECT user_id, make_timestamp(start_us) AS session_start,
  make_timestamp(max(us) + 21600000000) AS session_end, count(*) AS event_count FROM walk GROUP BY user_id, start_us""")
def session_max_length(spark, d):
    return windows.capped_session_windows(ev(spark, d), "user_id", SESSION_GAP, SESSION_MAX)


ALERT_COLS = ["alert_type", "user_id", "event_id", "severity", "message", "trigger_data", "timestamp", "resolved"]


def _burst_sql(name, severity, where, by, micros, limit, field, message):
    partition = "user_id" + (f", {by}" if by else "")
    lead = f"""'{{"{by}":"' || {by} || '",' ||""" if by else "'{' ||"
    return f"""SELECT '{name}' AS alert_type, user_id, event_id, '{severity}' AS severity, {message} AS message,
    {lead} '"{field}":' || n || ',"threshold":{limit}}}' AS trigger_data, "timestamp", false AS resolved
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY us, event_id)
      - count(*) OVER (PARTITION BY {partition} ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {micros} PRECEDING) AS VARCHAR) AS n
    FROM ev WHERE {where}) WHERE CAST(n AS BIGINT) > {limit}"""


FREQUENT = _burst_sql("high_frequency_operation", "medium", "true", None, 86400000000, 6, "event_count",
                      "'检测到高频操作: 1天内 ' || n || ' 次事件'")
CLICKS = _burst_sql("rapid_click", "low", "event_type = 'click'", None, 172800000000, 3, "click_count",
                    "'检测到快速点击: 2天内 ' || n || ' 次点击'")
PURCHASES = _burst_sql("unusual_purchase_pattern", "medium", "event_type = 'purchase'", "product_id", 864000000000, 1,
                       "purchase_count", "'检测到异常购买: 10天内购买商品 ' || product_id || ' 共 ' || n || ' 次'")
FAIL_WALK = EV + """, numbered AS (
  SELECT event_id, user_id, us, "timestamp", row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn
  FROM ev WHERE event_type = 'error'), walk AS (
  SELECT event_id, user_id, "timestamp", rn, [us] AS recent, false AS fired FROM numbered WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, "timestamp", rn, CASE WHEN len(kept) >= 3 THEN [] ELSE kept END, len(kept) >= 3
  FROM (SELECT n.*, list_append(list_filter(w.recent, lambda x: x > n.us - 172800000000), n.us) AS kept
        FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.rn = w.rn + 1))"""
FAILURES = """SELECT 'login_failure_brute_force' AS alert_type, user_id, event_id, 'high' AS severity,
    '检测到暴力破解尝试: 2天内登录失败 3 次' AS message,
    '{"fail_count":3,"window_minutes":2880,"threshold":3}' AS trigger_data, "timestamp", false AS resolved
  FROM walk WHERE fired"""


@query("detect_high_frequency", f"WITH {EV} {FREQUENT}")
def detect_high_frequency(spark, d):
    return detect.burst_alerts(ev(spark, d), bursts()[:1]).select(*ALERT_COLS)


@query("detect_rapid_click", f"WITH {EV} {CLICKS}")
def detect_rapid_click(spark, d):
    return detect.burst_alerts(ev(spark, d), bursts()[1:2]).select(*ALERT_COLS)


@query("detect_unusual_purchase", f"WITH {EV} {PURCHASES}")
def detect_unusual_purchase(spark, d):
    return detect.burst_alerts(ev(spark, d), bursts()[2:]).select(*ALERT_COLS)


@query("detect_login_failure", f"WITH RECURSIVE {FAIL_WALK} {FAILURES}")
def detect_login_failure(spark, d):
    return detect.login_failure_alerts(ev(spark, d), failed(), 3, 2 * DAY).select(*ALERT_COLS)


@query("all_alerts", f"""WITH RECURSIVE {FAIL_WALK}, every AS (
  {FREQUENT} UNION ALL {CLICKS} UNION ALL {PURCHASES} UNION ALL {FAILURES})
  SELECT sha256(alert_type || ':' || user_id || ':' || event_id) AS alert_id, * FROM every""")
def all_alerts(spark, d):
    rows = detect.all_alerts(ev(spark, d), bursts(), failed(), 3, 2 * DAY)
    return rows.select("alert_id", *ALERT_COLS)


# the same events under three users and within minutes, where the usual limits are reached
DENSE = EV.replace("ev AS", "raw AS", 1) + """, ev AS (
  SELECT * REPLACE (CAST(CAST(user_id AS BIGINT) % 3 AS VARCHAR) AS user_id, us // 20000 AS us,
    make_timestamp(us // 20000) AS "timestamp") FROM raw)""" + FAIL_WALK[len(EV):].replace(">= 3", ">= 5").replace("172800000000", "600000000")
USUAL = " UNION ALL ".join((
    FREQUENT.replace("86400000000", "60000000").replace("> 6", "> 100").replace('"threshold":6', '"threshold":100').replace("1天内", "每分钟"),
    CLICKS.replace("172800000000", "10000000").replace("> 3", "> 20").replace('"threshold":3', '"threshold":20').replace("2天内", "10秒内"),
    PURCHASES.replace("864000000000", "3600000000").replace("> 1", "> 5").replace('"threshold":1', '"threshold":5').replace("10天内", "1小时内"),
    FAILURES.replace("2天内登录失败 3", "10分钟内登录失败 5").replace('"fail_count":3', '"fail_count":5').replace("2880", "10").replace('"threshold":3', '"threshold":5'),
))


@query("default_alerts", f"WITH RECURSIVE {DENSE} {USUAL}")
def default_alerts(spark, d):
    us = F.call_function("div", F.unix_micros("timestamp"), F.lit(20000).cast("bigint"))
    dense = ev(spark, d).withColumn("timestamp", F.timestamp_micros(us)).withColumn(
        "user_id", (F.col("user_id").cast("bigint") % 3).cast("string"))
    return detect.all_alerts(dense, failed=failed()).select(*ALERT_COLS)
