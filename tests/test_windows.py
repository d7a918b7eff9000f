"""Windows and sessions: hand-made cases and a plain loop as the measure."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import timeutil as tu
from tidewatch.operators import windows as w

T0 = datetime(2024, 1, 1, 12)
MIN, HOUR = timedelta(minutes=1), timedelta(hours=1)
SCHEMA = "event_id string, user_id string, timestamp timestamp, amount double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def one(spark, at):
    return frame(spark, [("e", "u", at, 1.0)])


def test_tumbling(spark):
    row = w.tumbling(one(spark, T0 + 35 * MIN), HOUR).first()
    assert (row["window_start"], row["window_end"]) == (T0, T0 + HOUR)
    shifted = w.tumbling(one(spark, T0 + 45 * MIN), HOUR, 30 * MIN).first()
    assert shifted["window_start"] == T0 + 30 * MIN
    edge = w.tumbling(one(spark, T0 + HOUR), HOUR).first()
    assert edge["window_start"] == T0 + HOUR


def test_before_1970(spark):
    at = datetime(1969, 12, 31, 23, 30)
    assert w.tumbling(one(spark, at), HOUR).first()["window_start"] == datetime(1969, 12, 31, 23)
    row = one(spark, at).select(tu.window_start(F.col("timestamp"), HOUR).alias("s")).first()
    assert row["s"] == datetime(1969, 12, 31, 23)


def test_sliding(spark):
    rows = w.sliding(one(spark, T0 + timedelta(seconds=30)), 5 * MIN, MIN).collect()
    assert sorted(r["window_start"] for r in rows) == [T0 - i * MIN for i in (4, 3, 2, 1, 0)]
    with pytest.raises(ValueError):
        w.sliding(one(spark, T0), MIN, 2 * MIN)
    with pytest.raises(ValueError):
        w.sliding_totals(one(spark, T0), ["user_id"], MIN, 2 * MIN)


@pytest.mark.parametrize("slide", [timedelta(minutes=5), timedelta(minutes=4)])
def test_sliding_totals_equal_assignment(spark, slide):
    """Panes (slide divides size) and direct assignment give the same totals."""
    rnd = random.Random(3)
    df = frame(spark, [(f"e{i}", rnd.choice("ab"), T0 + timedelta(seconds=rnd.randint(0, 4000)), 1.0) for i in range(200)])
    plain = w.sliding(df, 15 * MIN, slide).groupBy("user_id", "window_start").count().collect()
    fast = w.sliding_totals(df, ["user_id"], 15 * MIN, slide, ("amount",)).collect()
    assert {(r[0], r[1]): r[2] for r in plain} == {(r["user_id"], r["window_start"]): r["event_count"] for r in fast}
    assert all(r["amount"] == r["event_count"] for r in fast)


def test_field_aggregates(spark):
    rows = [("1", "u", T0, 100.0), ("2", "u", T0, 200.0), ("3", "u", T0, 300.0), ("4", "u", T0, None)]
    got = frame(spark, rows[:3]).agg(*w.field_aggregates("amount")).first()
    assert tuple(got) == (3, 600.0, 200.0, 100.0, 300.0, 3)
    missing = frame(spark, rows).agg(*w.field_aggregates("amount")).first()
    assert tuple(missing) == (4, 600.0, 150.0, 0.0, 300.0, 3)
    assert tuple(frame(spark, []).agg(*w.field_aggregates("amount")).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0)
    users = spark.createDataFrame([("user_001",), ("user_002",), ("user_001",)], "user_id string")
    assert users.agg(w.approx_distinct("user_id")).first()[0] == 2


def test_lateness_and_expiry(spark):
    windowed = w.tumbling(one(spark, T0), HOUR)
    closed = T0 + HOUR
    assert w.on_time(windowed, closed).count() == 1
    assert w.on_time(windowed, closed + timedelta(microseconds=1)).count() == 0
    assert w.on_time(windowed, closed + HOUR, 2 * HOUR).count() == 1
    assert w.expired(windowed, closed).count() == 0 and w.open_windows(windowed, closed).count() == 1
    assert w.expired(windowed, closed + 2 * HOUR, HOUR).count() == 1
    assert w.one_window(windowed, F.col("user_id") == "u", T0, closed).count() == 1
    contents = w.window_contents(windowed, ["user_id"]).first()
    assert [v["event_id"] for v in contents["values"]] == ["e"]


def plain_sessions(rows, gap, limit=None, closes=()):
    """The session rule, one event after the other."""
    marks = [(r[2], 0, r[0], r[1]) for r in rows] + [(at, 1, "", user) for user, at in closes]
    state, out = {}, {}
    for at, close, event, user in sorted(marks):
        if close:
            state.pop(user, None)
            continue
        known = state.get(user)
        new = known is None or at - known[1] > gap or (limit is not None and at - known[0] > limit)
        state[user] = (at if new else known[0], at)
        out[event] = (state[user][0], new)
    return out


def random_rows(seed, n=400, span=20_000):
    rnd = random.Random(seed)
    # one user holds most events; instants repeat
    return [
        (f"e{i:04d}", rnd.choice(["hot"] * 6 + ["b", "c:1"]),
         T0 + timedelta(seconds=rnd.choice([rnd.randint(0, span), rnd.randint(0, 600)])), 1.0)
        for i in range(n)
    ]


def test_session_edges(spark):
    gap = 5 * MIN
    rows = [("1", "u", T0, 1.0), ("2", "u", T0 + 5 * MIN, 1.0), ("3", "u", T0 + 10 * MIN + timedelta(microseconds=1), 1.0)]
    got = w.session_windows(frame(spark, rows), "user_id", gap, ("amount",)).orderBy("session_start").collect()
    assert [(r["session_start"], r["session_end"], r["event_count"], r["amount"]) for r in got] == [
        (T0, T0 + 10 * MIN, 2, 2.0), (rows[2][2], rows[2][2] + gap, 1, 1.0),
    ]
    sessions = w.session_windows(frame(spark, rows), "user_id", gap)
    assert w.inactive_sessions(sessions, T0 + 15 * MIN, gap).count() == 0
    assert w.inactive_sessions(sessions, T0 + 16 * MIN, gap).count() == 1


@pytest.mark.parametrize("width", [timedelta(minutes=1), timedelta(hours=4)])
def test_sessions_equal_loop(spark, width):
    rows, gap = random_rows(1), timedelta(seconds=40)
    want = plain_sessions(rows, gap)
    df = frame(spark, rows)
    flags = w.new_session_flags(df, "user_id", gap, width=width).collect()
    assert {r["event_id"]: r["is_new_session"] for r in flags} == {k: v[1] for k, v in want.items()}
    users = {r[0]: r[1] for r in rows}
    totals = w.session_windows(df, "user_id", gap, width=width).collect()
    assert {(r["user_id"], r["session_start"]): r["event_count"] for r in totals} == dict(
        Counter((users[e], start) for e, (start, _) in want.items())
    )


def test_closing_by_hand(spark):
    rows, gap = random_rows(2, 200), timedelta(seconds=90)
    rnd = random.Random(7)
    closes = [("hot", T0 + timedelta(seconds=rnd.randint(0, 20_000))) for _ in range(30)] + [("hot", rows[0][2])]
    marks = spark.createDataFrame(closes, "user_id string, timestamp timestamp")
    got = w.new_session_flags(frame(spark, rows), "user_id", gap, closes=marks).collect()
    want = plain_sessions(rows, gap, closes=closes)
    assert {r["event_id"]: r["is_new_session"] for r in got} == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("fold_limit", [10_000, 5])
@pytest.mark.parametrize("gap,limit", [(300, 420), (60, 30)])
def test_capped_sessions_equal_loop(spark, fold_limit, gap, limit):
    """Both ways to walk long stretches; a small limit sends all of them the second way."""
    rows = random_rows(4, 300, 6000)
    gap, limit = timedelta(seconds=gap), timedelta(seconds=limit)
    want = plain_sessions(rows, gap, limit)
    options = {"fold_limit": fold_limit, "width": timedelta(minutes=10)}
    got = w.capped_sessions(frame(spark, rows), "user_id", gap, limit, **options).collect()
    assert {r["event_id"]: (r["session_start"], r["is_new_session"]) for r in got} == want
    users = {r[0]: r[1] for r in rows}
    totals = w.capped_session_windows(frame(spark, rows), "user_id", gap, limit, ("amount",), **options).collect()
    assert {(r["user_id"], r["session_start"]): (r["event_count"], r["amount"]) for r in totals} == {
        k: (n, float(n)) for k, n in Counter((users[e], start) for e, (start, _) in want.items()).items()
    }


def test_sessions_of_many_parts_and_null_keys(spark):
    """A hot key with a short timeout, sessions over many slices, and events without a key."""
    rnd = random.Random(9)
    rows = [(f"e{i:04d}", rnd.choice(["hot"] * 5 + [None]), T0 + timedelta(seconds=rnd.randint(0, 9000)), 1.0) for i in range(900)]
    # one session of the key "long" goes on through 600 slices, with another one behind it
    rows += [(f"l{i:04d}", "long", T0 + timedelta(seconds=20 * i), 1.0) for i in range(600)]
    rows += [("l9999", "long", T0 + timedelta(seconds=20 * 700), 1.0)]
    gap = timedelta(seconds=20)
    want = plain_sessions(rows, gap)
    got = w.session_windows(frame(spark, rows), "user_id", gap, ("amount",), width=timedelta(seconds=1)).collect()
    users = {r[0]: r[1] for r in rows}
    sizes = Counter((users[e], start) for e, (start, _) in want.items())
    assert {(r["user_id"], r["session_start"]): (r["event_count"], r["amount"]) for r in got} == {k: (n, float(n)) for k, n in sizes.items()}
    assert len(got) == len(sizes)


def test_no_window_holds_a_whole_key(spark):
    """Neither sessions nor ordered contents sort by the key alone, but for the top of a tree of blocks."""
    df = frame(spark, random_rows(1, 50))
    for out in (
        w.session_windows(df, "user_id", HOUR), w.ordered_contents(w.tumbling(df, HOUR), ["user_id"], width=MIN),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows
        whole = [line for line in windows if "_slice" not in line and "_block" not in line]
        assert not whole


@pytest.mark.parametrize("width", [MIN, 100 * HOUR])
def test_ordered_contents_equal_lists(spark, width):
    rows = [(e, None if u == "b" else u, at, None if e.endswith("3") else x) for e, u, at, x in random_rows(5, 300)]
    windowed = w.tumbling(frame(spark, rows), HOUR)
    placed = w.ordered_contents(windowed, ["user_id"], width=width)
    got = {}
    for r in placed.collect():
        got.setdefault((r["user_id"], r["window_start"]), {})[r["position"]] = (r["timestamp"], r["event_id"], r["amount"])
    want = {}
    for e, u, at, x in sorted(rows, key=lambda r: (r[2], r[0])):
        want.setdefault((u, at.replace(minute=0, second=0)), []).append((at, e, x))
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    runs = w.content_runs(placed, ["user_id"], 7).collect()
    assert max(len(r["values"]) for r in runs) == 7
    joined = {}
    for r in sorted(runs, key=lambda r: r["run"]):
        joined.setdefault((r["user_id"], r["window_start"]), []).extend(v["event_id"] for v in r["values"])
    assert joined == {k: [v[1] for v in vs] for k, vs in want.items()}
    assert w.ordered_contents(windowed.limit(0), ["user_id"]).count() == 0


def test_sketches_near_the_exact_count(spark):
    """Estimates of windows merged from panes, with nulls and a window of nothing but nulls."""
    at = F.timestamp_seconds(F.lit(1_704_110_400) + F.col("id") % 7200)
    df = spark.range(200_000).select(
        F.col("id").cast("string").alias("event_id"), (F.col("id") * 7 % 30_011).alias("v"), at.alias("timestamp"), F.lit("k").alias("k"),
    )
    df = df.unionByName(df.limit(3).withColumns({"v": F.lit(None).cast("bigint"), "timestamp": F.lit(T0 - 50 * HOUR).cast("timestamp")}))
    got = w.sliding_distinct(df, ["k"], "v", HOUR, 10 * MIN).collect()
    exact = {
        r["window_start"]: (r["n"], r["d"]) for r in w.sliding(df, HOUR, 10 * MIN).groupBy("window_start")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d")).collect()
    }
    assert len(got) == len(exact)
    for r in got:
        n, d = exact[r["window_start"]]
        assert r["event_count"] == n and r["window_end"] - r["window_start"] == HOUR
        assert abs(r["distinct_count"] - d) <= w.distinct_error() * d
    assert {0} == {r["distinct_count"] for r in got if r["window_start"] < T0 - 40 * HOUR}
    with pytest.raises(ValueError):
        w.sliding_distinct(df, ["k"], "v", HOUR, 7 * MIN)
