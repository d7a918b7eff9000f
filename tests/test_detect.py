"""Detectors at and around their limits, and against plain loops."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detect

T0 = datetime(2024, 1, 1)
SEC, MIN, HOUR = timedelta(seconds=1), timedelta(minutes=1), timedelta(hours=1)
SCHEMA = "event_id string, user_id string, event_type string, timestamp timestamp, properties string"


def frame(spark, rows):
    return detect.with_product(spark.createDataFrame(rows, SCHEMA))


def burst(n, kind, step, props="{}", user="u:1", start=T0):
    return [(f"{kind}{i:04d}", user, kind, start + step * i, props) for i in range(n)]


def kinds(df):
    return [(r["alert_type"], r["event_id"]) for r in df.orderBy("event_id").collect()]


def test_high_frequency_limit(spark):
    rows = burst(102, "view", timedelta(milliseconds=500))
    got = detect.burst_alerts(frame(spark, rows)).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == ["view0100", "view0101"]
    first = got[0]
    assert first["alert_type"] == "high_frequency_operation" and first["severity"] == "medium"
    assert json.loads(first["trigger_data"]) == {"event_count": 101, "threshold": 100}
    assert "101" in first["message"] and first["user_id"] == "u:1" and first["resolved"] is False
    assert first["timestamp"] == rows[100][3]
    assert len(first["alert_id"]) == 64


def test_window_is_open_on_the_old_side(spark):
    """21 clicks, the first exactly ten seconds before the last: only 20 count."""
    rows = burst(1, "click", SEC) + [
        (f"x{i:02d}", "u:1", "click", T0 + timedelta(milliseconds=500 * (i + 1)), "{}") for i in range(20)
    ]
    rows[-1] = ("x19", "u:1", "click", T0 + 10 * SEC, "{}")
    assert kinds(detect.burst_alerts(frame(spark, rows))) == []
    rows[-1] = ("x19", "u:1", "click", T0 + 10 * SEC - timedelta(microseconds=1), "{}")
    assert kinds(detect.burst_alerts(frame(spark, rows))) == [("rapid_click", "x19")]


def test_purchases_count_per_product(spark):
    a, b = '{"product_id": "a"}', '{"product_id": "b"}'
    rows = burst(5, "purchase", MIN, a) + burst(5, "purchase", MIN, b, start=T0 + SEC)
    rows = [(f"{i}", *r[1:]) for i, r in enumerate(rows)]
    assert kinds(detect.burst_alerts(frame(spark, rows))) == []
    more = rows + [("z", "u:1", "purchase", T0 + 30 * MIN, a)]
    (alert,) = detect.burst_alerts(frame(spark, more)).collect()
    assert json.loads(alert["trigger_data"]) == {"product_id": "a", "purchase_count": 6, "threshold": 5}
    # a missing product counts as one product
    (unknown,) = detect.burst_alerts(frame(spark, burst(6, "purchase", MIN))).collect()
    assert "unknown" in unknown["message"]


def test_login_failures_clear_after_alert(spark):
    rows = burst(11, "login", MIN, '{"status": "failed"}')
    rows += burst(3, "login", SEC, '{"status": "ok"}', user="v") + burst(9, "view", SEC, '{"status": "fail"}')
    rows = [(f"{r[2]}{i:03d}", *r[1:]) for i, r in enumerate(rows)]
    got = detect.login_failure_alerts(frame(spark, rows)).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == ["login004", "login009"]
    assert json.loads(got[0]["trigger_data"]) == {"fail_count": 5, "window_minutes": 10, "threshold": 5}
    assert got[0]["severity"] == "high"
    # five failures two and a half minutes apart span exactly ten minutes: too slow
    slow = burst(5, "login", timedelta(minutes=2, seconds=30), '{"status": "error"}')
    assert detect.login_failure_alerts(frame(spark, slow)).count() == 0


def random_rows(seed, n=1500):
    rnd = random.Random(seed)
    return [
        (f"e{i:05d}", rnd.choice(["hot"] * 5 + ["b", "c"]), rnd.choice(["view", "click", "purchase", "login"]),
         T0 + timedelta(seconds=rnd.choice([rnd.randint(0, 20_000), rnd.randint(0, 1500)])),
         json.dumps({"product_id": rnd.choice("pq"), "status": "fail"}))
        for i in range(n)
    ]


@pytest.mark.parametrize("width", [None, 30 * SEC, SEC, HOUR])
def test_bursts_equal_loop(spark, width):
    rows = random_rows(1)
    kind = F.col("event_type")
    bursts = [
        detect.Burst("high_frequency_operation", "medium", 7, MIN, F.lit(True)),
        detect.Burst("rapid_click", "low", 2, 10 * SEC, kind == "click"),
        detect.Burst("unusual_purchase_pattern", "medium", 3, 3 * MIN, kind == "purchase", "product_id"),
    ]
    tests = [lambda r: True, lambda r: r[2] == "click", lambda r: r[2] == "purchase"]
    keys = [lambda r: r[1], lambda r: r[1], lambda r: (r[1], json.loads(r[4])["product_id"])]
    want, state = {}, [{}, {}, {}]
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        for i, b in enumerate(bursts):
            if tests[i](r):
                kept = [t for t in [*state[i].get(keys[i](r), []), r[3]] if t > r[3] - b.window]
                state[i][keys[i](r)] = kept
                if len(kept) > b.threshold:
                    want[(b.alert_type, r[0])] = len(kept)
    got = detect.burst_alerts(frame(spark, rows), bursts, width).collect()
    assert {
        (r["alert_type"], r["event_id"]): json.loads(r["trigger_data"])[detect.COUNT_FIELDS[r["alert_type"]]]
        for r in got
    } == want


@pytest.mark.parametrize("threshold,window", [
    (5, 2 * MIN), (1, MIN), (3, 20 * SEC), (5, 10 * MIN), (4, 3 * HOUR), (40, 10 * MIN), (2, SEC),
])
def test_failures_equal_loop(spark, threshold, window):
    rows = random_rows(2)
    want, state = set(), {}
    for r in sorted((r for r in rows if r[2] == "login"), key=lambda r: (r[3], r[0])):
        kept = [t for t in [*state.get(r[1], []), r[3]] if t > r[3] - window]
        if len(kept) >= threshold:
            want.add(r[0])
            kept = []
        state[r[1]] = kept
    got = detect.failure_bursts(frame(spark, rows), F.col("event_type") == "login", threshold, window).collect()
    assert {r["event_id"] for r in got} == want
    for width in (7 * SEC, 45 * SEC):
        got = detect.failure_bursts(frame(spark, rows), F.col("event_type") == "login", threshold, window, width).collect()
        assert sorted(r["event_id"] for r in got) == sorted(want)


def test_window_as_long_as_the_log_with_one_user_of_a_third(spark):
    """Largest task near the median: no step gathers the hot user."""
    n = 30_000
    user = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 997).cast("string")))
    events = spark.range(n).select(
        F.col("id").cast("string").alias("event_id"), user.alias("user_id"), F.lit("view").alias("event_type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("timestamp"), F.lit("{}").alias("properties"),
    )
    log = timedelta(seconds=20 * n)
    bursts = [detect.Burst("high_frequency_operation", "medium", 100, log, F.lit(True))]
    counted = detect.trailing_counts(events, bursts)
    per_user = counted.groupBy("user_id").agg(F.max("_n0").alias("most"), F.count("*").alias("n")).collect()
    assert all(r["most"] == r["n"] for r in per_user) and max(r["n"] for r in per_user) == n // 3
    rows = detect.prefix_counts(events, bursts, detect.SLICE)
    largest = rows.groupBy("user_id", "_slice").count().agg(F.max("count")).first()[0]
    assert largest <= 60
    hot = detect.failure_bursts(events, F.lit(True), 5, log).groupBy("user_id").count().filter("user_id = 'hot'").first()
    assert hot["count"] == n // 3 // 5


def test_all_alerts_and_one_shuffle(spark):
    rows = burst(21, "click", timedelta(milliseconds=100)) + burst(5, "login", SEC, '{"status": "fail"}')
    got = kinds(detect.all_alerts(frame(spark, rows)))
    assert got == [("rapid_click", "click0020"), ("login_failure_brute_force", "login0004")]
    plan = detect.burst_alerts(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
