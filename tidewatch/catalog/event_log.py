"""Event-log queries."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.catalog.base import EV, MID, ev, query
from tidewatch.functions import timeutil as tu
from tidewatch.functions import values
from tidewatch.operators import logs
from tidewatch.sources import events as src

LOW, HIGH = datetime(2024, 1, 5), datetime(2024, 1, 25)
RANGE_SQL = """"timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-25'"""
COLS = ["event_id", "user_id", "event_type", "timestamp", "session_id", "page_url"]
COLS_SQL = 'event_id, user_id, event_type, "timestamp", session_id, page_url'


@query("log_search", f"""WITH {EV} SELECT {COLS_SQL} FROM ev
  WHERE event_type = 'view' AND page_url LIKE '%/item/1%' AND {RANGE_SQL}
  ORDER BY "timestamp" DESC, event_id DESC LIMIT 50 OFFSET 50""")
def log_search(spark, d):
    return logs.search_page(
        ev(spark, d), 2, 50, event_type="view", page_url="/item/1", start=LOW, end=HIGH
    ).select(*COLS)


@query("log_search_all", f"""WITH {EV} SELECT {COLS_SQL} FROM ev
  WHERE event_type = 'click' AND page_url LIKE '%/item/_2%' AND {RANGE_SQL}""")
def log_search_all(spark, d):
    return logs.search(ev(spark, d), event_type="click", page_url="/item/_2", start=LOW, end=HIGH).select(*COLS)


@query("log_search_total", f"""WITH {EV} SELECT count(*) AS total FROM ev
  WHERE event_type = 'view' AND page_url LIKE '%/item/1%' AND {RANGE_SQL}""")
def log_search_total(spark, d):
    return logs.search_total(ev(spark, d), event_type="view", page_url="/item/1", start=LOW, end=HIGH)


@query("log_user_session", f"""WITH {EV} SELECT {COLS_SQL} FROM ev
  WHERE user_id = '7' AND session_id = '7_10'""")
def log_user_session(spark, d):
    return logs.search(ev(spark, d), user_id="7", session_id="7_10").select(*COLS)


@query("event_by_id", f"WITH {EV} SELECT {COLS_SQL} FROM ev WHERE event_id = '42'")
def event_by_id(spark, d):
    return logs.by_id(ev(spark, d), "42").select(*COLS)


@query("live_feed", f"""WITH {EV} SELECT {COLS_SQL} FROM ev WHERE event_type = 'purchase'
  ORDER BY "timestamp" DESC, event_id DESC LIMIT 500""")
def live_feed(spark, d):
    return logs.live_feed(ev(spark, d), "purchase").select(*COLS)


@query("event_type_counts", f"""WITH {EV} SELECT event_type, count(*) AS event_count FROM ev
  WHERE {RANGE_SQL} GROUP BY event_type""")
def event_type_counts(spark, d):
    return logs.type_counts(ev(spark, d), LOW, HIGH)


@query("event_totals", f"""WITH {EV} SELECT count(*) AS total_events,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions
  FROM ev WHERE {RANGE_SQL}""")
def event_totals(spark, d):
    return logs.totals(ev(spark, d), LOW, HIGH)


@query("top_event_type", f"""WITH {EV} SELECT event_type, count(*) AS event_count FROM ev
  GROUP BY event_type ORDER BY event_count DESC, event_type LIMIT 1""")
def top_event_type(spark, d):
    return logs.top_type(ev(spark, d))


@query("hourly_stats", f"""WITH {EV} SELECT date_trunc('hour', "timestamp") AS hour, event_type,
  count(*) AS event_count, count(DISTINCT user_id) AS unique_users FROM ev GROUP BY 1, 2""")
def hourly_stats(spark, d):
    return logs.hourly_stats(ev(spark, d))


@query("event_trend", f"""WITH {EV}, buckets AS (
  SELECT unnest(generate_series(TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-15', INTERVAL 1 DAY)) AS bucket_start)
  SELECT bucket_start, count(event_id) AS event_count FROM buckets LEFT JOIN ev
    ON "timestamp" >= bucket_start AND "timestamp" < bucket_start + INTERVAL 1 DAY
    AND "timestamp" <= TIMESTAMP '2024-01-15' GROUP BY bucket_start""")
def event_trend(spark, d):
    return logs.event_trend(ev(spark, d), "7d", MID)


@query("event_trend_hour", f"""WITH {EV}, buckets AS (
  SELECT unnest(generate_series(TIMESTAMP '2024-01-14 23:05', TIMESTAMP '2024-01-15', INTERVAL 5 MINUTE)) AS bucket_start)
  SELECT bucket_start, count(event_id) AS event_count FROM buckets LEFT JOIN ev
    ON "timestamp" >= bucket_start AND "timestamp" < bucket_start + INTERVAL 5 MINUTE
    AND "timestamp" <= TIMESTAMP '2024-01-15' GROUP BY bucket_start""")
def event_trend_hour(spark, d):
    return logs.event_trend(ev(spark, d), "1h", MID)


@query("retention", f"""WITH {EV} SELECT {COLS_SQL} FROM ev
  WHERE CAST("timestamp" AS DATE) >= DATE '2024-01-21'""")
def retention(spark, d):
    return src.retained(ev(spark, d), date(2024, 1, 31), 10).select(*COLS)


@query("log_rows", f"""WITH {EV} SELECT event_id, user_id, event_type, session_id,
  strftime("timestamp", '%Y-%m-%d') AS event_date, strftime("timestamp", '%Y-%m') AS event_month, props AS properties
  FROM ev""")
def log_rows(spark, d):
    rows = src.log_rows(ev(spark, d)).withColumn("event_date", F.col("event_date").cast("string"))
    return rows.select("event_id", "user_id", "event_type", "session_id", "event_date", "event_month", "properties")


# every event as a message; some made invalid, so that each reason occurs
MESSAGE_SQL = """messages AS (
  SELECT event_id, k, CASE WHEN k % 20 IN (1, 6) THEN 'malformed' WHEN k % 20 = 2 THEN 'missing user_id'
    WHEN k % 20 = 4 THEN 'bad user_id' WHEN event_type IN ('signup', 'error') THEN 'unknown event_type'
    WHEN k % 20 = 3 THEN 'bad timestamp' WHEN k % 20 = 5 THEN 'bad properties' END AS reason, user_id, event_type, "timestamp" FROM ev)"""


def _messages(events):
    k = F.col("product_id").cast("bigint")
    body = F.to_json(F.struct(
        "event_id", F.when(k % 20 != 2, F.col("user_id")).alias("user_id"), "event_type",
        F.when(k % 20 == 3, F.lit("yesterday")).otherwise(tu.format_iso(F.col("timestamp"))).alias("timestamp"),
        F.from_json("properties", "k int").alias("properties"),
    ))
    user = F.concat(F.lit('"user_id":"'), F.col("user_id"), F.lit('"'))
    return events.select(
        F.when(k % 20 == 1, F.concat(F.lit("{"), body))
        .when(k % 20 == 4, F.replace(body, user, F.lit('"user_id":5')))
        .when(k % 20 == 5, F.regexp_replace(body, r'"properties":\{[^}]*\}', '"properties":[1]'))
        .when(k % 20 == 6, F.concat(body, F.lit(" {}"))).otherwise(body).alias("value")
    )


@query("parsed_events", f"""WITH {EV}, {MESSAGE_SQL} SELECT event_id, user_id, event_type, "timestamp"
  FROM messages WHERE reason IS NULL""")
def parsed_events(spark, d):
    valid = src.valid_events(src.parse_messages(_messages(ev(spark, d))))
    return valid.select("event_id", "user_id", "event_type", "timestamp")


@query("rejected_messages", f"""WITH {EV}, {MESSAGE_SQL} SELECT reason, count(*) AS message_count
  FROM messages WHERE reason IS NOT NULL GROUP BY reason""")
def rejected_messages(spark, d):
    bad = src.rejected_messages(src.parse_messages(_messages(ev(spark, d))))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("message_count"))


@query("time_conversions", f"""WITH {EV} SELECT event_id, us // 1000 AS millis,
  make_timestamp(us // 1000 * 1000) AS from_millis,
  strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso,
  "timestamp" AS parsed FROM ev""")
def time_conversions(spark, d):
    t = F.col("timestamp")
    return ev(spark, d).select(
        "event_id", tu.epoch_millis(t).alias("millis"),
        tu.from_epoch_millis(tu.epoch_millis(t)).alias("from_millis"),
        tu.format_iso(t).alias("iso"), tu.parse_iso(tu.format_iso(t)).alias("parsed"),
    )


@query("time_in_window", f"""WITH {EV} SELECT event_id, "timestamp" AS utc,
  "timestamp" >= TIMESTAMP '2024-01-10' AND "timestamp" < TIMESTAMP '2024-01-15' AS inside FROM ev""")
def time_in_window(spark, d):
    # zone-less instants, as the table may have them
    utc = tu.to_utc(F.col("timestamp").cast("timestamp_ntz"))
    inside = tu.in_window(utc, F.lit(MID - timedelta(days=5)), F.lit(MID))
    return ev(spark, d).select("event_id", utc.alias("utc"), inside.alias("inside"))


@query("time_buckets", f"""WITH {EV}, spans AS (
  SELECT user_id, min("timestamp") AS s, max("timestamp") AS e FROM ev GROUP BY user_id), starts AS (
  SELECT user_id, e, unnest(generate_series(time_bucket(INTERVAL 1 DAY, s), e - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS bucket_start
  FROM spans)
  SELECT user_id, bucket_start, least(bucket_start + INTERVAL 1 DAY, e) AS bucket_end FROM starts""")
def time_buckets(spark, d):
    spans = ev(spark, d).groupBy("user_id").agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"))
    return spans.select("user_id", F.inline(tu.time_buckets(F.col("s"), F.col("e"), timedelta(days=1))))


@query("interval_overlap", f"""WITH {EV}, spans AS (
  SELECT user_id, min("timestamp") FILTER (event_type = 'view') AS a, max("timestamp") FILTER (event_type = 'view') AS b,
         min("timestamp") FILTER (event_type = 'click') AS c, max("timestamp") FILTER (event_type = 'click') AS d
  FROM ev GROUP BY user_id)
  SELECT user_id, a < d AND c < b AS overlaps, greatest(epoch_us(least(b, d)) - epoch_us(greatest(a, c)), 0) AS overlap_us,
         epoch_us(b) - epoch_us(a) AS view_us FROM spans WHERE a IS NOT NULL AND c IS NOT NULL""")
def interval_overlap(spark, d):
    def edge(f, kind):
        return f(F.when(F.col("event_type") == kind, F.col("timestamp")))

    spans = ev(spark, d).groupBy("user_id").agg(
        edge(F.min, "view").alias("a"), edge(F.max, "view").alias("b"),
        edge(F.min, "click").alias("c"), edge(F.max, "click").alias("d"),
    ).filter("a is not null and c is not null")
    ends = [F.col(x) for x in "abcd"]
    return spans.select(
        "user_id", tu.overlaps(*ends).alias("overlaps"), tu.overlap_micros(*ends).alias("overlap_us"),
        tu.duration_micros(F.col("a"), F.col("b")).alias("view_us"),
    )


@query("humanized_gaps", f"""WITH {EV}, spans AS (
  SELECT user_id, event_type, (max(us) - min(us)) // 1000000 AS s FROM ev GROUP BY user_id, event_type)
  SELECT user_id, event_type, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || '秒'
    WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || '分钟' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || '小时'
    ELSE CAST(s // 86400 AS VARCHAR) || '天' END AS active_for FROM spans""")
def humanized_gaps(spark, d):
    spans = ev(spark, d).groupBy("user_id", "event_type").agg(
        F.min("timestamp").alias("s"), F.max("timestamp").alias("e")
    )
    return spans.select("user_id", "event_type", tu.humanize(tu.duration_micros(F.col("s"), F.col("e"))).alias("active_for"))


@query("risk_levels", f"""WITH {EV} SELECT event_id, CASE WHEN value <= 30 THEN 'LOW'
  WHEN value <= 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM ev""")
def risk_levels(spark, d):
    return ev(spark, d).select("event_id", values.risk_level(F.col("value")).alias("risk"))


@query("json_properties", f"""WITH {EV} SELECT event_id, CAST(k AS DOUBLE) AS number, 0.0::DOUBLE AS absent,
  product_id AS text FROM ev""")
def json_properties(spark, d):
    props = F.col("properties")
    return ev(spark, d).select(
        "event_id", values.json_number(props, "k").alias("number"),
        values.json_number(props, "amount").alias("absent"), values.json_text(props, "k").alias("text"),
    )
