"""Streams over several micro-batches give what the batch operators give."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import audit, detect, stats, windows
from tidewatch.plans.rules import Action, Rule
from tidewatch.sources import events as src
from tidewatch.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)
MIN = timedelta(minutes=1)


def messages(seed, n=400, span=3600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + timedelta(seconds=span * i / n)
        kind = rnd.choice(["view", "click", "click", "purchase", "login"])
        out.append({
            "event_id": f"e{i:04d}", "user_id": rnd.choice(["hot"] * 4 + ["b", "c:1"]), "event_type": kind,
            "timestamp": at.isoformat() + "Z", "session_id": f"s{rnd.randint(0, 3)}",
            "properties": {"amount": rnd.randint(1, 9), "product_id": rnd.choice("pq"), "status": "fail"},
        })
    return out


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Four files in order of time, then one far-off event that moves the watermark on."""
    folder = tmp_path_factory.mktemp("feed")
    rows = messages(1)
    for part in range(4):
        lines = [json.dumps(m) for m in rows[part * 100:(part + 1) * 100]]
        if part == 1:
            lines += ["{broken", json.dumps({"user_id": "x", "event_type": "strange"})]
        (folder / f"{part}.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    last = {**rows[-1], "event_id": "z", "user_id": "end", "event_type": "share", "timestamp": "2024-02-01T00:00:00Z"}
    (folder / "9.json").write_text(json.dumps(last) + "\n", encoding="utf-8")
    # the file source goes by modification time; files written at once would tie
    for place, file in enumerate(sorted(folder.glob("*.json"))):
        os.utime(file, (1_700_000_000 + place, 1_700_000_000 + place))
    return str(folder)


def stream(spark, feed):
    return jobs.event_stream(jobs.message_stream(spark, feed, files_per_batch=1))


def batch(spark, feed):
    return src.valid_events(src.parse_messages(spark.read.text(feed)))


def finished(spark, rows, tmp_path):
    columns = rows.schema
    jobs.append_table(rows, str(tmp_path / "rows"), str(tmp_path / "progress"), every=None).awaitTermination()
    return spark.read.schema(columns).parquet(str(tmp_path / "rows"))


def same(left, right):
    columns = sorted(left.columns)
    assert sorted(right.columns) == columns
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(left) == key(right)


def test_parse_and_reject(spark, feed):
    parsed = src.parse_messages(spark.read.text(feed))
    assert src.valid_events(parsed).count() == 401
    assert sorted(r["reason"] for r in src.rejected_messages(parsed).collect()) == ["malformed", "unknown event_type"]
    standard = src.standard_events(src.valid_events(parsed), T0).first()
    assert standard["tags"] == [] and standard["processed_at"] == T0
    assert src.valid_events(parsed).columns == [f.name for f in schema.EVENTS.fields]


@pytest.mark.parametrize("body,reason", [
    ('{"user_id": "u", "event_type": "view", "timestamp": "2024-01-01T00:00:00Z"}', None),
    ('{"user_id": "u", "event_type": "view"}', None),
    ('{"user_id": "u", "event_type": "view", "timestamp": 1704067200}', None),
    ('{"event_type": "view"}', "missing user_id"),
    ('{"user_id": "u"}', "unknown event_type"),
    ('{"user_id": "u", "event_type": "view", "timestamp": "soon"}', "bad timestamp"),
    ("", "malformed"), ("[1]", "malformed"), ("7", "malformed"),
])
def test_reasons(spark, body, reason):
    rows = spark.createDataFrame([(body,)], "value string")
    assert src.parse_messages(rows).first()["_reject"] == reason


@pytest.mark.parametrize("text", ["2024-01-01T01:00:00+01:00", "2024-01-01T00:00:00", "1704067200", "1704067200000"])
def test_forms_of_an_instant(spark, text):
    body = json.dumps({"user_id": "u", "event_type": "view", "timestamp": text})
    assert src.parse_messages(spark.createDataFrame([(body,)], "value string")).first()["timestamp"] == T0


def test_minute_totals(spark, feed, tmp_path):
    got = finished(spark, jobs.minute_totals_stream(stats.with_amount(stream(spark, feed))), tmp_path)
    want = stats.minute_totals(stats.with_amount(batch(spark, feed))).filter("user_id <> 'end'")
    same(got, want)


def test_alerts(spark, feed, tmp_path):
    kind = F.col("event_type")
    bursts = [
        detect.Burst("high_frequency_operation", "medium", 6, MIN, F.lit(True)),
        detect.Burst("rapid_click", "low", 3, MIN, kind == "click"),
        detect.Burst("unusual_purchase_pattern", "medium", 2, 3 * MIN, kind == "purchase", "product_id"),
    ]
    live = stateful.alert_stream(detect.with_product(stream(spark, feed)), bursts, threshold=4, window=4 * MIN)
    want = detect.all_alerts(detect.with_product(batch(spark, feed)), bursts, threshold=4, window=4 * MIN)
    assert want.select("alert_type").distinct().count() == 4
    same(finished(spark, live, tmp_path), want)


def test_capped_sessions(spark, feed, tmp_path):
    gap, limit = timedelta(seconds=25), timedelta(seconds=70)
    close = F.col("event_type") == "login"
    live = stateful.session_stream(stream(spark, feed), "user_id", gap, limit)
    want = windows.capped_sessions(batch(spark, feed), "user_id", gap, limit)
    same(finished(spark, live, tmp_path), want.select("user_id", "event_id", "timestamp", "session_start", "is_new_session"))
    closing = stateful.session_stream(stream(spark, feed), "user_id", gap, close=close)
    rows = batch(spark, feed)
    flags = windows.new_session_flags(rows.filter(~close), "user_id", gap, closes=rows.filter(close))
    got = finished(spark, closing, tmp_path / "closing")
    same(got.select("event_id", "is_new_session"), flags.select("event_id", "is_new_session"))


def test_session_and_sliding_counts(spark, feed, tmp_path):
    got = finished(spark, jobs.session_counts_stream(stream(spark, feed), "user_id", timedelta(seconds=25)), tmp_path / "a")
    want = windows.session_windows(batch(spark, feed), "user_id", timedelta(seconds=25)).filter("user_id <> 'end'")
    same(got, want)
    live = jobs.windowed_counts_stream(stream(spark, feed), ["user_id"], 5 * MIN, MIN)
    totals = windows.sliding_totals(batch(spark, feed), ["user_id"], 5 * MIN, MIN).filter("user_id <> 'end'")
    same(finished(spark, live, tmp_path / "b"), totals)
    with pytest.raises(ValueError):
        jobs.windowed_counts_stream(stream(spark, feed), ["user_id"], MIN, 5 * MIN)


def test_replays_and_log(spark, feed, tmp_path):
    rows = stream(spark, feed)
    once = finished(spark, jobs.without_replays(rows.unionByName(stream(spark, feed))), tmp_path)
    assert once.count() == 401
    jobs.append_log_stream(rows, str(tmp_path / "log"), str(tmp_path / "log-progress"), every=None).awaitTermination()
    log = src.read_log(spark, str(tmp_path / "log"))
    assert {(r[0], r[1]) for r in log.groupBy("event_month").count().collect()} == {("2024-01", 400), ("2024-02", 1)}
    message = jobs.keyed_messages(once).filter("key = 'end'").first()
    assert json.loads(message["value"])["event_id"] == "z"


def in_files(spark, folder, frames):
    """One file a frame, in this order for the file source."""
    for part, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        for file in folder.glob("part-*"):
            if file.stat().st_mtime > 1_700_000_100:
                os.utime(file, (1_700_000_000 + part, 1_700_000_000 + part))


def test_order_replay(spark, tmp_path):
    rnd = random.Random(2)
    rows = [
        (rnd.choice(["hot", "hot", "b", "taken", "done", "odd", "nobody's"]), i, *rnd.choice([("assign", None), ("review", "approved"),
         ("review", "rejected"), ("review", "pending"), ("reopen", None), ("review", "odd"), ("close", None)]), "x", "n", T0 + i * MIN) for i in range(180)
    ]
    in_files(spark, tmp_path / "requests", [spark.createDataFrame(rows[part * 60:(part + 1) * 60], schema.REQUESTS) for part in range(3)])
    orders = audit.create_orders(
        spark.createDataFrame([(i,) for i in ("hot", "b", "taken", "done", "odd", "idle")], "id string"), F.lit("u"), F.lit("r"), F.lit("{}"),
        F.lit("LOW"), F.lit(T0), order_key=F.col("id"))
    status = F.when(F.col("id") == "taken", "in_review").when(F.col("id") == "done", "closed").when(F.col("id") == "odd", "strange")
    orders = orders.withColumn("status", F.coalesce(status, "status"))
    live = stateful.replay_stream(jobs.table_stream(spark, str(tmp_path / "requests"), schema.REQUESTS, 1), orders)
    got = finished(spark, live, tmp_path)
    want = audit.replay(orders, spark.createDataFrame(rows, schema.REQUESTS))
    assert want.filter("status_before is null").count() > 20 and want.filter("status_before = 'closed'").count() > 20
    same(got, want.select("order_id", "seq", "action", "status_before", "status_after", "accepted"))


def test_closed_orders_expire(spark, tmp_path):
    ask = lambda seq, at, order="o": (order, seq, "close", None, None, None, T0 + at)
    day = timedelta(days=1)
    # the second file's other order moves the watermark past the closed one's time; timers run after a micro-batch's rows
    batches = [[ask(1, 0 * day), ask(2, MIN)], [ask(3, 9 * day, "p")], [ask(4, 10 * day)], [ask(5, 11 * day)]]
    in_files(spark, tmp_path / "requests", [spark.createDataFrame(rows, schema.REQUESTS) for rows in batches])
    orders = audit.create_orders(
        spark.createDataFrame([("o",), ("p",)], "id string"), F.lit("u"), F.lit("r"), F.lit("{}"), F.lit("LOW"), F.lit(T0), order_key=F.col("id"))
    live = stateful.replay_stream(
        jobs.table_stream(spark, str(tmp_path / "requests"), schema.REQUESTS, 1), orders, keep_closed=2 * day, lateness=MIN)
    got = {r["seq"]: r["status_before"] for r in finished(spark, live, tmp_path).collect()}
    assert got == {1: "pending", 2: "closed", 3: "pending", 4: "closed", 5: None}


def feed_events(rows):
    """What a plain loop makes of change rows in the order they come: (user, tag, value, source, ts, deleted, seq)."""
    held, cleared, out = {}, {}, []
    for user, tag, value, source, ts, deleted, seq in rows:
        at = (ts, seq or 0)
        if tag is None:
            if at > cleared.get(user, (T0 - timedelta(days=99), 0)):
                cleared[user] = at
                for key in sorted(k for k in held if k[0] == user):
                    if not held[key][1] and held[key][0] < at:
                        out.append((user, "delete", key[1], None, held[key][2], ts))
                        held[key] = (at, True, None)
            continue
        old = held.get((user, tag))
        if at < cleared.get(user, at) or old and (at, deleted, value or "") < (old[0], old[1], old[2] or ""):
            continue
        before = old[2] if old and not old[1] else None
        if not deleted:
            out.append((user, "update", tag, value, before, ts))
        elif old and not old[1]:
            out.append((user, "delete", tag, None, before, ts))
        held[user, tag] = (at, deleted, None if deleted else value)
    return sorted(out, key=repr)


def test_tag_feed(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        # some changes come late, in a later micro-batch than newer ones
        late = timedelta(minutes=rnd.choice([0, 0, 0, 70]))
        rows.append((rnd.choice(["hot", "hot", "b"]), rnd.choice(["x", "y", "z", "x", None]) if i % 9 == 0 else rnd.choice("xyz"), rnd.choice("pqr"),
                     "RULE", T0 + i * MIN - late, rnd.random() < 0.3, rnd.choice([None, 0, 1])))
    rows = [(u, t, None if d or t is None else v, s, ts, d or t is None, seq) for u, t, v, s, ts, d, seq in rows]
    parts = [rows[k * 80:(k + 1) * 80] for k in range(3)]
    order = lambda r: (r[4], r[6] or 0, r[5], r[2] or "")
    columns = "user_id string, tag_name string, value string, source string, ts timestamp, deleted boolean, seq bigint"
    frames = [spark.createDataFrame(p, columns) for p in parts]
    in_files(spark, tmp_path / "changes", frames)
    live = stateful.tag_feed(jobs.table_stream(spark, str(tmp_path / "changes"), frames[0].schema, 1))
    got = finished(spark, live, tmp_path).select("user_id", "change", "tag_name", "value", "old_value", "ts").collect()
    want = feed_events([r for p in parts for r in sorted(p, key=order)])
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {w[1] for w in want} == {"update", "delete"} and any(w[4] for w in want)


def test_last_windows_of_an_ended_stream(spark, tmp_path):
    """Without any later event, all windows come out; a second run to the end adds nothing."""
    rows = [(f"e{i}", "u", "click", T0 + i * timedelta(seconds=40), "s", "{}") for i in range(30)]
    columns = "event_id string, user_id string, event_type string, timestamp timestamp, session_id string, properties string"
    frames = [spark.createDataFrame(rows[k * 10:(k + 1) * 10], columns) for k in range(3)]
    in_files(spark, tmp_path / "events", frames)
    every = spark.createDataFrame(rows, columns)

    def run(name, windowed, reach):
        live = windowed(jobs.with_end_markers(
            jobs.table_stream(spark, str(tmp_path / "events"), frames[0].schema, 1), str(tmp_path / name / "markers")))
        start = lambda: jobs.append_table(live, str(tmp_path / name / "rows"), str(tmp_path / name / "progress"), every=None)
        for _ in range(2):
            jobs.run_to_end(spark, start, str(tmp_path / name / "markers"), reach + 2 * jobs.FLUSH_DELAY)
        return spark.read.schema(live.schema).parquet(str(tmp_path / name / "rows"))

    amounts = lambda df: stats.with_amount(df)
    same(run("minutes", lambda df: jobs.minute_totals_stream(amounts(df)), 2 * MIN), stats.minute_totals(amounts(every)))
    same(run("sliding", lambda df: jobs.windowed_counts_stream(df, ["user_id"], 5 * MIN, MIN), 5 * MIN),
         windows.sliding_totals(every, ["user_id"], 5 * MIN, MIN))
    same(run("sessions", lambda df: jobs.session_counts_stream(df, "user_id", MIN), MIN), windows.session_windows(every, "user_id", MIN))


def test_log_stream_is_sorted_and_repeats(spark, feed, tmp_path):
    rows = stream(spark, feed)
    path, progress = str(tmp_path / "log"), str(tmp_path / "progress")
    jobs.append_log_stream(rows, path, progress, every=None).awaitTermination()
    # the last micro-batch once more, as after a crash before its commit
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        file.unlink(missing_ok=True)
    jobs.append_log_stream(rows, path, progress, every=None).awaitTermination()
    log = src.read_log(spark, path)
    assert log.count() == 401 and log.select("event_id").distinct().count() == 401
    for file in sorted((tmp_path / "log").rglob("*.parquet")):
        keys = [(r["event_date"], r["event_type"], r["timestamp"], r["event_id"]) for r in spark.read.parquet(str(file)).collect()]
        assert keys == sorted(keys)


def test_rule_job_takes_new_rules(spark, tmp_path):
    columns = "user_id string, event_count long"
    folder = tmp_path / "contexts"
    for part, user in enumerate(("a", "b")):
        spark.createDataFrame([(user, 5)], columns).coalesce(1).write.mode("append").parquet(str(folder))
    calls = []

    def load():
        calls.append(1)
        name = f"tag{len(calls)}"
        return [Rule("r", "R", "event_count > 1", actions=(Action("TAG_USER", {"tags": [name]}), Action("TRIGGER_AUDIT"), Action("ALERT")))]

    paths = {k: str(tmp_path / k) for k in ("tags", "orders", "matches", "progress")}
    contexts = jobs.table_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, 1)
    jobs.rule_job(contexts, load, paths["tags"], paths["orders"], paths["matches"], paths["progress"], every=None).awaitTermination()
    assert {r["tag_name"] for r in spark.read.parquet(paths["tags"]).collect()} == {"tag1", "tag2"}
    assert spark.read.parquet(paths["orders"]).count() == 2
    matches = spark.read.parquet(paths["matches"]).collect()
    assert len(matches) == 2 and all(not m["actions_executed"][2]["success"] for m in matches)


def test_rule_job_repeats_a_micro_batch(spark, tmp_path):
    spark.createDataFrame([("a", 5)], "user_id string, event_count long").coalesce(1).write.parquet(str(tmp_path / "contexts"))
    rule = Rule("r", "R", "event_count > 1", actions=(Action("TRIGGER_AUDIT"),))

    def run():
        contexts = jobs.table_stream(spark, str(tmp_path / "contexts"), spark.read.parquet(str(tmp_path / "contexts")).schema)
        paths = [str(tmp_path / k) for k in ("tags", "orders", "matches", "progress")]
        jobs.rule_job(contexts, lambda: [rule], *paths, every=None).awaitTermination()
        return spark.read.parquet(paths[1]).first()["id"]

    first = run()
    for file in (tmp_path / "progress" / "commits").glob("*0*"):
        file.unlink()
    assert run() == first
