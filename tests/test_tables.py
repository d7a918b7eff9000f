"""Tags, profiles, orders, statistics and log queries on small tables."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions import timeutil as tu
from tidewatch.functions import values
from tidewatch.operators import activity, audit, logs, profiles, stats, tags
from tidewatch.sources import events as src

T0 = datetime(2024, 1, 1)
MIN, HOUR, DAY = timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


# --- time and values --------------------------------------------------------

def test_time_helpers(spark):
    c = F.col("t")
    row = one(spark, t=datetime(2024, 1, 1, 12, 35, 30, 500_000)).select(
        tu.epoch_millis(c).alias("ms"), tu.format_iso(c).alias("iso"),
        tu.parse_iso(F.lit("2024-01-01T12:00:00Z")).alias("z"), tu.parse_iso(F.lit("2024-01-01T14:00:00+02:00")).alias("off"),
        tu.parse_iso(F.lit("never")).alias("bad"), tu.window_end(c, HOUR).alias("end"),
        tu.in_window(c, c, c + F.expr("INTERVAL 1 HOUR")).alias("at_start"),
        tu.in_window(c, c - F.expr("INTERVAL 1 HOUR"), c).alias("at_end"),
        tu.from_epoch_millis(F.lit(1000)).alias("ts"), tu.to_utc(F.lit("2024-01-01 00:00:00")).alias("utc"),
    ).first()
    assert row["ms"] == 1704112530500 and row["iso"] == "2024-01-01T12:35:30.500000+00:00"
    assert row["z"] == row["off"] == datetime(2024, 1, 1, 12) and row["bad"] is None
    assert row["end"] == datetime(2024, 1, 1, 13) and row["at_start"] is True and row["at_end"] is False
    assert row["ts"] == datetime(1970, 1, 1, 0, 0, 1) and row["utc"] == T0
    assert one(spark, t=T0).select(tu.format_iso(c)).first()[0] == "2024-01-01T00:00:00+00:00"


def test_buckets_and_overlap(spark):
    got = tu.bucket_table(spark, T0, T0 + 3 * HOUR, HOUR).collect()
    assert [(r[0], r[1]) for r in got] == [(T0 + i * HOUR, T0 + (i + 1) * HOUR) for i in range(3)]
    clipped = tu.bucket_table(spark, T0 + 30 * MIN, T0 + 90 * MIN, HOUR).collect()
    assert [(r[0], r[1]) for r in clipped] == [(T0, T0 + HOUR), (T0 + HOUR, T0 + 90 * MIN)]
    assert tu.bucket_table(spark, T0, T0, HOUR).count() == 0
    ends = one(spark, a=T0 + 12 * HOUR, b=T0 + 14 * HOUR, c=T0 + 13 * HOUR, d=T0 + 15 * HOUR)
    cols = [F.col(x) for x in "abcd"]
    row = ends.select(tu.overlap_micros(*cols), tu.overlaps(*cols), tu.overlap(*cols)).first()
    assert row[0] == 3_600_000_000 and row[1] is True and row[2]["start"] == T0 + 13 * HOUR
    touching = ends.select(tu.overlap(cols[0], cols[1], cols[1], cols[3]), tu.overlap_micros(cols[0], cols[1], cols[1], cols[3])).first()
    assert touching[0] is None and touching[1] == 0


@pytest.mark.parametrize("seconds,text", [
    (30, "30秒"), (59, "59秒"), (60, "1分钟"), (300, "5分钟"), (7200, "2小时"), (86399, "23小时"), (3 * 86400, "3天"),
])
def test_humanize(spark, seconds, text):
    assert one(spark, us=seconds * 1_000_000).select(tu.humanize(F.col("us").cast("bigint"))).first()[0] == text


@pytest.mark.parametrize("body,amount", [
    ('{"amount": 12.5}', 12.5), ('{"amount": 3}', 3.0), ('{"amount": "12.5"}', 0.0), ('{"amount": true}', 1.0),
    ('{"amount": null}', 0.0), ("{}", 0.0), ("not json", 0.0), ('{"amount": [1]}', 0.0), ('{"amount": 1e3}', 1000.0),
])
def test_only_numbers_are_amounts(spark, body, amount):
    assert one(spark, p=body).select(values.json_number(F.col("p"), "amount")).first()[0] == amount


def test_risk_and_summary(spark):
    levels = spark.createDataFrame([(s,) for s in (0, 30, 31, 70, 71)], "s int")
    assert [r[0] for r in levels.select(values.risk_level(F.col("s"))).collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]
    body = '{"ruleName": "x", "count": 3, "why": "spam", "ruleId": 1}'
    assert one(spark, j=body).select(values.trigger_summary(F.col("j"))).first()[0] == "count: 3, why: spam"
    assert one(spark, j='{"ruleId": 1}').select(values.trigger_summary(F.col("j"))).first()[0] == "No trigger data available"


# --- event log and statistics -------------------------------------------------

EVENTS = "event_id string, user_id string, event_type string, timestamp timestamp, session_id string, page_url string, ip_address string, properties string"


def events(spark):
    rows = [
        ("1", "u:1", "view", T0, "s1", "/item/a_b", "10.0.0.1", "{}"),
        ("2", "u:1", "purchase", T0 + 30 * MIN, "s1", "/cart", None, '{"amount": 10}'),
        ("3", "u:1", "purchase", T0 + 30 * MIN + timedelta(seconds=1), "", None, None, '{"amount": "5"}'),
        ("4", "v", "click", T0 + HOUR, None, "/item/axb", None, '{"amount": 99}'),
        ("5", "v", "login", T0 + 2 * DAY, "s2", "/", None, "{}"),
    ]
    return spark.createDataFrame(rows, EVENTS)


def ids(df):
    return [r["event_id"] for r in df.collect()]


def test_search(spark):
    e = events(spark)
    assert ids(logs.search_page(e)) == ["5", "4", "3", "2", "1"]
    assert ids(logs.search_page(e, direction="asc", size=2)) == ["1", "2"]
    assert ids(logs.search_page(e, 2, 2)) == ["3", "2"]
    assert ids(logs.search_page(e, direction="sideways", size=1)) == ["5"]
    assert ids(logs.search_page(e, page_url="a_b", direction="asc")) == ["1", "4"]
    assert ids(logs.search_page(e, start=T0 + 30 * MIN, end=T0 + HOUR, direction="asc")) == ["2", "3", "4"]
    assert ids(logs.search_page(e, user_id="u:1", event_type="view", session_id="s1", ip_address="10.0.0.1")) == ["1"]
    assert logs.search_total(e, user_id="v").first()["total"] == 2
    assert ids(logs.by_id(e, "3")) == ["3"] and ids(logs.by_id(e, "9")) == []
    assert ids(logs.live_feed(e, "purchase", 1)) == ["3"]
    for bad in ((0, 20), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            logs.search_page(e, *bad)


def test_filters_reach_the_scan(spark, tmp_path):
    """Predicates are pushed to the files and other months are not opened."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    src.append_log(events(spark), str(tmp_path / "log"), files_per_month=2)
    log = src.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 5 and log.filter("session_id = ''").count() == 0
    found = logs.search(log, user_id="u:1", start=T0, end=T0 + DAY).select("event_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(user_id,u:1)" in plan
    assert "event_month" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "page_url" not in plan.split("ReadSchema")[1]
    assert found.count() == 3
    assert src.retained(log, date(2024, 1, 3), 1).count() == 1
    row = log.filter("event_id = '5'").first()
    assert row["event_date"] == date(2024, 1, 3) and row["ingested_at"] is not None


def test_totals_and_trend(spark):
    e = events(spark)
    assert [tuple(r) for r in logs.type_counts(e).collect()][0] == ("purchase", 2)
    assert logs.top_type(e).first()["event_type"] == "purchase"
    row = logs.totals(e).first()
    assert (row["total_events"], row["unique_users"]) == (5, 2)
    trend = logs.event_trend(e, "1h", T0 + 59 * MIN).collect()
    assert len(trend) == 12 and sum(r["event_count"] for r in trend) == 3
    assert trend[0]["bucket_start"] == T0
    assert logs.totals(e.limit(0)).first()["total_events"] == 0
    hours = {(r["hour"], r["event_type"]): (r["event_count"], r["unique_users"]) for r in logs.hourly_stats(e).collect()}
    assert hours[(T0, "purchase")] == (2, 1)


def test_minute_totals_and_stats(spark):
    e = stats.with_amount(events(spark))
    rows = {(r["user_id"], r["window_start"]): r for r in stats.minute_totals(e).collect()}
    busy = rows[("u:1", T0 + 30 * MIN)]
    assert (busy["event_count"], busy["purchase_count"], busy["total_amount"], busy["unique_sessions"]) == (2, 2, 10.0, 1)
    assert rows[("v", T0 + HOUR)]["total_amount"] == 0.0
    last = {r["user_id"]: r for r in stats.running_totals(e).collect()}
    assert last["v"]["last_event_type"] == "login" and last["u:1"]["total_events"] == 3
    got = {r["user_id"]: r for r in stats.user_stats(e, T0 + 2 * DAY).collect()}
    assert got["v"]["events_1d"] == 1 and got["v"]["last_login_time"] == T0 + 2 * DAY
    assert (got["u:1"]["events_1d"], got["u:1"]["events_7d"], got["u:1"]["amount_7d"], got["u:1"]["total_sessions"]) == (0, 3, 10.0, 1)
    context = {r["user_id"]: r for r in stats.rule_contexts(e, T0 + 5 * DAY, F.col("event_type") == "login").collect()}
    assert context["v"]["login_fail_count"] == 1 and context["u:1"]["days_since_last_visit"] == 5


def test_any_amount_is_summed(spark):
    rows = [(str(i), "u", "purchase", T0, f'{{"amount": {a}}}') for i, a in enumerate(("1e30", "0.1", "0.2", "-1e18"))]
    df = stats.with_amount(spark.createDataFrame(rows, "event_id string, user_id string, event_type string, timestamp timestamp, properties string"))
    df = df.withColumn("session_id", F.lit("s"))
    assert stats.minute_totals(df).first()["total_amount"] == pytest.approx(1e30)
    assert stats.minute_totals(df.filter("event_id in ('1', '2')")).first()["total_amount"] == 0.3


# --- tags -------------------------------------------------------------------

def changes(spark):
    rows = [
        ("u", "level", "new", "AUTO", 0.5, None, T0, False, None),
        ("u", "level", "vip", "RULE", 0.9, T0 + 5 * DAY, T0 + DAY, False, None),
        ("u", "risk", "high", "AUDIT", 1.0, None, T0, False, None),
        ("u", "risk", None, "AUTO", 1.0, None, T0 + DAY, True, None),
        ("v", "level", "vip", "MANUAL", 1.0, None, T0, False, None),
    ]
    return spark.createDataFrame(rows, schema.TAG_CHANGES)


def test_tags(spark):
    log = changes(spark)
    now = {(r["user_id"], r["tag_name"]): r["value"] for r in tags.current_tags(log).collect()}
    assert now == {("u", "level"): "vip", ("v", "level"): "vip"}
    early = {(r["user_id"], r["tag_name"]): r["value"] for r in tags.current_tags(log, T0).collect()}
    assert early == {("u", "level"): "new", ("u", "risk"): "high", ("v", "level"): "vip"}
    assert tags.current_tags(log, T0 + 5 * DAY).count() == 1
    current = tags.current_tags(log)
    assert {r[0] for r in tags.users_with_tag(current, "level", "vip").collect()} == {"u", "v"}
    assert tags.users_with_tag(current, "level", "new").count() == 0
    assert {tuple(r) for r in tags.tag_statistics(current).collect()} == {("level", 2)}
    assert tags.batch_tags(current, ["u", "x"], ["level"]).count() == 1
    many = [*map(str, range(200)), "u"]
    assert tags.batch_tags(current, many, ["level"]).count() == tags.batch_tags(current, ["u"], ["level"]).count()
    held = tags.tag_maps(current).filter("user_id = 'u'").first()["tags"]
    assert held["level"]["value"] == "vip" and held["level"]["confidence"] == 0.9
    again = tags.current_tags(tags.compact(log))
    assert again.exceptAll(current).isEmpty() and current.exceptAll(again).isEmpty()


def test_replacing_tags(spark):
    log = changes(spark)
    wanted = tags.change_rows(
        one(spark, u="u", t="fresh"), F.col("u"), F.col("t"), F.lit("1"), F.lit(T0 + 2 * DAY), source=F.lit("odd")
    )
    done = tags.current_tags(log.unionByName(tags.replace_tags(tags.current_tags(log), wanted)))
    assert {(r["user_id"], r["tag_name"], r["source"]) for r in done.collect()} == {("u", "fresh", "AUTO"), ("v", "level", "MANUAL")}


# --- profiles ---------------------------------------------------------------

def test_partial_update(spark):
    stored = spark.createDataFrame(
        [("a", '{"age": 1}', ["x"], "{}", "{}", "low", T0, T0), ("b", "{}", [], "{}", "{}", "high", T0, T0)], schema.PROFILES
    )
    fields = "user_id string, basic_info string, behavior_tags array<string>, stat_tags string, predict_tags string, risk_level string, update_time timestamp"
    updates = spark.createDataFrame([
        ("a", None, None, None, None, "medium", T0 + DAY), ("a", None, [], None, None, None, T0 + 2 * DAY),
        ("new", '{"n": 1}', None, None, None, None, T0 + DAY),
    ], fields)
    got = {r["user_id"]: r for r in profiles.partial_update(stored, profiles.merge_updates(updates)).collect()}
    assert (got["a"]["basic_info"], got["a"]["behavior_tags"], got["a"]["risk_level"]) == ('{"age": 1}', [], "medium")
    assert got["a"]["update_time"] == T0 + 2 * DAY and got["a"]["create_time"] == T0
    assert got["b"]["update_time"] == T0 and got["b"]["risk_level"] == "high"
    assert (got["new"]["basic_info"], got["new"]["risk_level"], got["new"]["create_time"]) == ('{"n": 1}', "low", T0 + DAY)
    assert [r[0] for r in profiles.users_by_risk(stored, "high").collect()] == ["b"]
    assert profiles.count_users(stored).first()[0] == 2
    left, = profiles.delete_users([stored], one(spark, user_id="a"))
    assert [r["user_id"] for r in left.collect()] == ["b"]


# --- review orders ----------------------------------------------------------

def test_levels_and_transitions(spark):
    rows = spark.createDataFrame([("HIGH",), ("high",), ("odd",), (None,)], "l string")
    assert [r[0] for r in rows.select(audit.audit_level(F.col("l"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM"]
    assert [r[0] for r in rows.select(audit.audit_level(F.col("l"), True)).collect()] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM"]
    pairs = spark.createDataFrame([(a, b) for a in audit.STATUSES for b in audit.STATUSES], "a string, b string")
    legal = {(r["a"], r["b"]) for r in pairs.filter(audit.can_move(F.col("a"), F.col("b"))).collect()}
    assert legal == {(a, b) for a, allowed in audit.TRANSITIONS.items() for b in allowed}


def plain_replay(requests):
    """One order's requests, one after the other."""
    order, out = {"status": "pending", "assignee": None, "note": None}, []
    for _, seq, action, status, assignee, note, _ in sorted(requests, key=lambda r: r[1]):
        before = order["status"]
        if action == "assign" and before == "pending":
            order.update(status="in_review", assignee=assignee)
        elif action == "reopen" and before == "rejected":
            order["status"] = "in_review"
            order["assignee"] = assignee or order["assignee"]
        elif action in ("review", "close"):
            wanted = "closed" if action == "close" else status
            if wanted in audit.TRANSITIONS[before]:
                order["status"] = wanted
                order["note"] = note or order["note"]
                if action == "review":
                    order["assignee"] = assignee or order["assignee"]
        out.append((seq, before, before != order["status"], order["status"]))
    return order, out


@pytest.mark.parametrize("light", [1000, 50])
def test_replay_equals_loop(spark, light):
    rnd = random.Random(3)
    requests = []
    for order, n in (("hot", 700), ("b", 12), ("c", 1)):
        for seq in range(n):
            action = rnd.choice(["assign", "review", "review", "reopen", "close" if rnd.random() < 0.01 else "review"])
            status = rnd.choice(["in_review", "approved", "rejected", "pending", "strange"]) if action == "review" else None
            requests.append((order, seq * 3, action, status, rnd.choice(["x", "y", "z"]), rnd.choice(["n", "m", "", None]), T0 + seq * MIN))
    frame = spark.createDataFrame(requests + [("ghost", 1, "assign", None, "x", None, T0)], schema.REQUESTS)
    orders = audit.create_orders(
        spark.createDataFrame([("hot",), ("b",), ("c",), ("quiet",)], "id string"), F.lit("u"), F.lit("r"), F.lit("{}"),
        F.lit("HIGH"), F.lit(T0), order_key=F.col("id"),
    )
    done = audit.replay(orders, frame, light).collect()
    after = {r["id"]: r for r in audit.apply_requests(orders, frame).collect()}
    for order in ("hot", "b", "c"):
        final, outcome = plain_replay([r for r in requests if r[0] == order])
        assert sorted((r["seq"], r["status_before"], r["accepted"], r["status_after"]) for r in done if r["order_id"] == order) == outcome
        assert (after[order]["status"], after[order]["assignee"], after[order]["reviewer_note"]) == (final["status"], final["assignee"], final["note"])
    (ghost,) = [r for r in done if r["order_id"] == "ghost"]
    assert ghost["status_before"] is None and ghost["accepted"] is False
    assert after["quiet"]["status"] == "pending" and after["quiet"]["update_time"] == T0


def orders(spark):
    rows = [
        ("1", "u", "r", "{}", "LOW", "pending", None, None, T0, T0),
        ("2", "u", "r", "{}", "CRITICAL", "pending", "ann", None, T0 + HOUR, T0),
        ("3", "v", "r", "{}", "HIGH", "in_review", "ann", None, T0 + DAY, T0),
        ("4", "v", "r", "{}", "MEDIUM", "closed", "ann", None, T0 + DAY, T0),
        ("5", "v", "r", "{}", "CRITICAL", "in_review", "ann", None, T0, T0),
    ]
    return spark.createDataFrame(rows, schema.ORDERS)


def test_order_lists(spark):
    o = orders(spark)
    get = lambda df: [r["id"] for r in df.collect()]
    assert get(audit.todo(o, "ann")) == ["5", "2", "3"]
    assert get(audit.todo(o, "ann", lexical=True)) == ["3", "5", "2"]
    assert get(audit.unassigned(o)) == ["1"]
    assert get(audit.list_page(o, assignee="ann", size=2)) == ["3", "4"]
    assert get(audit.list_page(o, status="pending")) == ["2", "1"]
    assert audit.list_total(o, user_id="v").first()[0] == 3
    assert get(audit.by_level(o, "critical")) == ["2", "5"]
    assert get(audit.by_level(o, sort="level")) == ["2", "5", "3", "4", "1"]
    assert dict(map(tuple, audit.status_counts(o).collect())) == {"pending": 2, "in_review": 2, "closed": 1, "approved": 0, "rejected": 0}
    assert dict(map(tuple, audit.open_level_counts(o).collect())) == {"LOW": 1, "MEDIUM": 0, "HIGH": 1, "CRITICAL": 2}
    assert audit.created_today(o, T0 + DAY + HOUR).first()[0] == 2
    wanted = spark.createDataFrame([("1",), ("1",), ("3",), ("none",)], "order_id string")
    assert [(r["id"], r["status"], r["assignee"]) for r in audit.batch_assign(o, wanted, "bob", T0).collect()] == [("1", "in_review", "bob")]
    assert sorted(get(audit.delete_orders(o, wanted))) == ["2", "4", "5"]
    assert get(audit.by_id(o, "4")) == ["4"]
    asked = audit.assign_requests(wanted, F.col("order_id"), F.lit("bob"), F.lit(1), F.lit(T0))
    assert set(asked.columns) == set(schema.REQUESTS.fieldNames())


def test_activity(spark):
    matches = spark.createDataFrame([("u", "r1", T0 + 3 * DAY)], "user_id string, rule_id string, executed_at timestamp")
    feed = activity.recent_activity(orders(spark), matches, changes(spark), 3).collect()
    assert [r["type"] for r in feed] == ["rule_trigger", "audit_complete", "audit_complete"]
    counted = activity.activity_counters(events(spark), matches, orders(spark), changes(spark))
    totals = {(r["counter"], r["label"], r["detail"]): r["total"] for r in counted.collect()}
    assert totals[("events", "purchase", "log")] == 2 and totals[("tag_changes", "remove", "AUTO")] == 1
    assert totals[("orders", "pending", "LOW")] == 1 and totals[("rule_matches", "r1", "")] == 1


def test_messages_are_strict(spark):
    good = '"user_id":"u","event_type":"view"'
    cases = {
        f"{{{good}}}": None, f'{{{good},"session_id":null,"timestamp":1700000000}}': None, f'{{{good},"properties":{{}}}}': None,
        f"{{{good}}} x": "malformed", f"{{{good}}}{{}}": "malformed", f"{{{good}}},{{}}": "malformed", f"{{{good}}}] x": "malformed",
        "": "malformed", "[1]": "malformed", "5": "malformed", None: "malformed", '{"event_type":"view"}': "missing user_id",
        '{"user_id":null,"event_type":"view"}': "missing user_id", '{"user_id":5,"event_type":"view"}': "bad user_id",
        '{"user_id":{"a":1},"event_type":"view"}': "bad user_id", '{"user_id":"u"}': "unknown event_type",
        '{"user_id":"u","event_type":7}': "unknown event_type", f'{{{good},"timestamp":null}}': "bad timestamp",
        f'{{{good},"timestamp":true}}': "bad timestamp", f'{{{good},"session_id":12}}': "bad session_id",
        f'{{{good},"event_id":null}}': "bad event_id",
        **{f'{{{good},"properties":{p}}}': "bad properties" for p in ("[1]", '"{}"', "7", "null")},
    }
    rows = src.parse_messages(spark.createDataFrame([(c,) for c in cases], "value string")).collect()
    assert {r["_raw"]: r["_reject"] for r in rows} == cases
