"""Streaming jobs run over the event table as a bounded stream."""

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from tidewatch.catalog.base import EV, REQUESTS, TAGS, ev, failed, query, review_requests, tag_changes, user_orders
from tidewatch.catalog.users import COUNTS_SQL, SPENT_SQL
from tidewatch.catalog.windowed import (
    ALERT_COLS, CAPPED, CLICKS, FAIL_WALK, FAILURES, FREQUENT, PURCHASES, SESSION_GAP, SESSION_MAX, SESSIONS, bursts,
)
from tidewatch.operators import logs
from tidewatch.plans.rules import Action, Rule
from tidewatch.schema import TAG_CHANGES
from tidewatch.session import ROCKSDB, ensure_checkpoint_dir
from tidewatch.sources.events import BENCH_EVENTS, append_log, events_std, read_log
from tidewatch.streaming import jobs, stateful

#: Micro-batches of the streams that are written for a query.
PARTS = 4


def _events(spark, folder):
    # as a pattern the path may be one file or a folder of files
    return events_std(jobs.table_stream(spark, f"{folder}/events.parque[t]", BENCH_EVENTS))


def _finished(spark, stream):
    """Runs the stream over what is there, into a table of its own, and reads the table."""
    base = _base(spark)
    schema = stream.schema
    jobs.append_table(stream, f"{base}/rows", f"{base}/progress", every=None).awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows")


def _base(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return f"{ensure_checkpoint_dir(spark)}/tidewatch-{uuid.uuid4().hex}"


def _whole(spark, folder, windowed, size):
    """As ``_finished``, with the last windows too."""
    base = _base(spark)
    rows = windowed(jobs.with_end_markers(_events(spark, folder), f"{base}/markers"))
    jobs.run_to_end(
        spark, lambda: jobs.append_table(rows, f"{base}/rows", f"{base}/progress", every=None), f"{base}/markers", size + 2 * jobs.FLUSH_DELAY
    )
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def _in_parts(spark, rows, at, path, write):
    """Rows written in the order of an instant, part by part, as a stream finds them."""
    low, high = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    for part in range(PARTS):
        begin, end = (low + (high + 1 - low) * k // PARTS for k in (part, part + 1))
        us = F.unix_micros(at)
        write(rows.filter((us >= begin) & (us < end)).coalesce(1), path)


@query("stream_messages", f"""WITH {EV} SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'login' ELSE event_type END AS event_type,
  "timestamp", session_id, page_url FROM ev""")
def stream_messages(spark, d):
    # the event types of messages are a closed list
    kind = F.col("event_type")
    named = F.when(kind == "signup", F.lit("register")).when(kind == "error", F.lit("login")).otherwise(kind)
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = ev(spark, d)
    message = F.to_json(F.struct("event_id", "user_id", named.alias("event_type"), at.alias("timestamp"), "session_id", "page_url"))
    base = _base(spark)
    _in_parts(spark, rows.select(message.alias("value"), "timestamp"), "timestamp", f"{base}/messages", lambda part, path: part.select("value").write.mode("append").text(path))
    live = jobs.event_stream(jobs.message_stream(spark, f"{base}/messages", files_per_batch=1))
    return _finished(spark, live.select("event_id", "user_id", "event_type", "timestamp", "session_id", "page_url"))


@query("stream_minute_totals", f"""WITH {EV}, w AS (SELECT user_id, date_trunc('minute', "timestamp") AS window_start,
  date_trunc('minute', "timestamp") + INTERVAL 1 MINUTE AS window_end, {COUNTS_SQL},
  {SPENT_SQL.format('amount')} AS total_amount, count(DISTINCT session_id) AS unique_sessions FROM ev GROUP BY ALL)
  SELECT * FROM w""")
def stream_minute_totals(spark, d):
    return _whole(spark, d, jobs.minute_totals_stream, timedelta(minutes=2))


@query("stream_sliding_counts", f"""WITH {EV}, spread AS (
  SELECT user_id, time_bucket(INTERVAL 1 HOUR, "timestamp") - to_hours(CAST(i AS INTEGER)) AS window_start FROM ev, range(6) r(i)), w AS (
  SELECT user_id, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS event_count FROM spread GROUP BY ALL)
  SELECT * FROM w""")
def stream_sliding_counts(spark, d):
    size, slide = timedelta(hours=6), timedelta(hours=1)
    return _whole(spark, d, lambda rows: jobs.windowed_counts_stream(rows, ["user_id"], size, slide), size)


@query("stream_session_counts", f"""WITH {SESSIONS} SELECT user_id, session_start, session_end, event_count FROM sessions""")
def stream_session_counts(spark, d):
    return _whole(spark, d, lambda rows: jobs.session_counts_stream(rows, "user_id", SESSION_GAP), SESSION_GAP)


@query("stream_capped_sessions", f"""WITH RECURSIVE {CAPPED} SELECT event_id, user_id,
  make_timestamp(start_us) AS session_start, is_new AS is_new_session FROM walk""")
def stream_capped_sessions(spark, d):
    rows = stateful.session_stream(_events(spark, d), "user_id", SESSION_GAP, SESSION_MAX)
    return _finished(spark, rows).select("event_id", "user_id", "session_start", "is_new_session")


@query("stream_alerts", f"""WITH RECURSIVE {FAIL_WALK}, every AS (
  {FREQUENT} UNION ALL {CLICKS} UNION ALL {PURCHASES} UNION ALL {FAILURES}) SELECT * FROM every""")
def stream_alerts(spark, d):
    rows = stateful.alert_stream(_events(spark, d), bursts(), failed(), 3, timedelta(days=2))
    return _finished(spark, rows).select(*ALERT_COLS)


@query("stream_deduplicated", f'WITH {EV} SELECT event_id, event_type, "timestamp" FROM ev')
def stream_deduplicated(spark, d):
    rows = _events(spark, d)
    return _finished(spark, jobs.without_replays(rows.unionByName(rows)).select("event_id", "event_type", "timestamp"))


@query("stream_order_replay", f"""WITH RECURSIVE {EV}, {REQUESTS}
  SELECT order_id, seq, action, status_before, accepted, status_after FROM outcome
  UNION ALL SELECT order_id, seq, action, NULL, false, NULL FROM requests WHERE order_id NOT IN (SELECT order_id FROM numbered)""")
def stream_order_replay(spark, d):
    # requests arrive in several micro-batches; users who never bought have no order
    base = _base(spark)
    requests = review_requests(ev(spark, d))
    _in_parts(spark, requests, "request_time", f"{base}/requests", lambda part, path: part.write.mode("append").parquet(path))
    live = jobs.table_stream(spark, f"{base}/requests", requests.schema, files_per_batch=1)
    return _finished(spark, stateful.replay_stream(live, user_orders(ev(spark, d)), timedelta(days=365)))


@query("stream_tag_feed", f"""WITH {TAGS.partition(', tags AS')[0]}, steps AS (
  SELECT *, lag(value) OVER w AS before, coalesce(NOT lag(deleted) OVER w, false) AS held
  FROM changes WINDOW w AS (PARTITION BY user_id, tag_name ORDER BY ts))
  SELECT user_id, CASE WHEN deleted THEN 'delete' ELSE 'update' END AS change, tag_name, CASE WHEN NOT deleted THEN value END AS value,
    CASE WHEN held THEN before END AS old_value, source, ts FROM steps WHERE held OR NOT deleted""")
def stream_tag_feed(spark, d):
    base = _base(spark)
    changes = tag_changes(ev(spark, d))
    _in_parts(spark, changes, "ts", f"{base}/changes", lambda part, path: part.write.mode("append").parquet(path))
    return _finished(spark, stateful.tag_feed(jobs.table_stream(spark, f"{base}/changes", changes.schema, files_per_batch=1)))


@query("stream_event_log", f"""WITH {EV} SELECT event_id, user_id, event_type, "timestamp", session_id, page_url, props AS properties,
  strftime("timestamp", '%Y-%m') AS event_month FROM ev""")
def stream_event_log(spark, d):
    base = _base(spark)
    rows = _events(spark, d).select("event_id", "user_id", "event_type", "timestamp", "session_id", "page_url", "properties")
    jobs.append_log_stream(rows, f"{base}/log", f"{base}/progress", every=None).awaitTermination()
    return read_log(spark, f"{base}/log").select(
        "event_id", "user_id", "event_type", "timestamp", "session_id", "page_url", "properties", "event_month"
    )


@query("event_by_id_in_log", f"""WITH {EV} SELECT event_id, user_id, event_type, "timestamp", session_id FROM ev
  WHERE event_id = (SELECT max(event_id) FROM ev)""")
def event_by_id_in_log(spark, d):
    # the look-up of one id in a written log
    path = f"{_base(spark)}/log"
    rows = ev(spark, d)
    append_log(rows.select("event_id", "user_id", "event_type", "timestamp", "session_id", "page_url", "properties"), path, files_per_month=8)
    wanted = rows.agg(F.max("event_id")).first()[0]
    return logs.by_id(read_log(spark, path), wanted).select("event_id", "user_id", "event_type", "timestamp", "session_id")


@query("stream_rule_tags", f"""WITH {EV}, big AS (SELECT * FROM ev WHERE event_type = 'purchase' AND value > 100)
  SELECT user_id, t.tag_name AS tag_name, 'RULE' AS source, 1.0::DOUBLE AS confidence, false AS deleted
  FROM big, (VALUES ('big_spender'), ('seen')) AS t(tag_name)""")
def stream_rule_tags(spark, d):
    # each event is a context of its own
    contexts = _events(spark, d).select("event_id", "user_id", "event_type", "value")
    rule = Rule("spender", "Spender", "event_type == 'purchase' and value > 100",
                actions=(Action("TAG_USER", {"tags": ["big_spender", "seen"]}),))
    base = _base(spark)
    jobs.rule_job(
        contexts, lambda: [rule], f"{base}/tags", f"{base}/orders", f"{base}/matches", f"{base}/progress", every=None
    ).awaitTermination()
    changes = spark.read.schema(TAG_CHANGES).parquet(f"{base}/tags")
    return changes.select("user_id", "tag_name", "source", "confidence", "deleted")
