"""Burst detectors over the event log and the alert record.

All detectors order events by ``(timestamp, event_id)`` and look at the last
``W``: an event exactly ``W`` old has left the window.

A user's history is cut into slices of time. Windows up to ``SLICE`` long need only the events
just before a slice, which are copied into it. Longer ones are counted by prefix sums: an
event adds one when it comes and takes one off when it leaves the window, so the count at any
instant is the sum of all that came before, within the slice and, as one number, from the slices before it. Slices
are thus as narrow as ever, however long the window is.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions.timeutil import floor_div, micros
from tidewatch.functions.values import UNKNOWN_PRODUCT, json_text
from tidewatch.operators.skew import identity, prefix_states, sliced

# Detector names, severities, limits and message formats.
HIGH_FREQUENCY = ("high_frequency_operation", "medium", 100, timedelta(minutes=1))
RAPID_CLICK = ("rapid_click", "low", 20, timedelta(seconds=10))
UNUSUAL_PURCHASE = ("unusual_purchase_pattern", "medium", 5, timedelta(hours=1))
LOGIN_FAILURE = ("login_failure_brute_force", "high", 5, timedelta(minutes=10))
MESSAGES = {
    "high_frequency_operation": "检测到高频操作: {} %d 次事件",
    "rapid_click": "检测到快速点击: {} %d 次点击",
    "unusual_purchase_pattern": "检测到异常购买: {}购买商品 %s 共 %d 次",
    "login_failure_brute_force": "检测到暴力破解尝试: {}登录失败 %d 次",
}
COUNT_FIELDS = {
    "high_frequency_operation": "event_count",
    "rapid_click": "click_count",
    "unusual_purchase_pattern": "purchase_count",
    "login_failure_brute_force": "fail_count",
}
#: Width of slices where windows are longer.
SLICE = timedelta(hours=1)
PER_MINUTE, WITHIN = "每分钟", "内"
UNITS = (("天", timedelta(days=1)), ("小时", timedelta(hours=1)), ("分钟", timedelta(minutes=1)), ("秒", timedelta(seconds=1)))


def message_format(alert_type: str, window: timedelta) -> str:
    """The message of a detector, with its window in the largest unit that divides it."""
    if (alert_type, window) == (HIGH_FREQUENCY[0], HIGH_FREQUENCY[3]):
        return MESSAGES[alert_type].format(PER_MINUTE)
    name, unit = next((u for u in UNITS if not window % u[1]), UNITS[-1])
    return MESSAGES[alert_type].format(f"{window / unit:g}{name}{WITHIN}")


@dataclass(frozen=True)
class Burst:
    """More than ``threshold`` flagged events of one user (and ``by``) within ``window``."""

    alert_type: str
    severity: str
    threshold: int
    window: timedelta
    flag: Column
    by: str | None = None


def default_bursts() -> list[Burst]:
    """The three count detectors with their usual limits.

    Events need a ``product_id`` column; see ``with_product``.
    """
    kind = F.col("event_type")
    return [
        Burst(*HIGH_FREQUENCY, flag=F.lit(True)),
        Burst(*RAPID_CLICK, flag=kind == "click"),
        Burst(*UNUSUAL_PURCHASE, flag=kind == "purchase", by="product_id"),
    ]


def with_product(events: DataFrame) -> DataFrame:
    return events.withColumn("product_id", json_text(F.col("properties"), "product_id", UNKNOWN_PRODUCT))


def login_failed() -> Column:
    """Default predicate of a failed login, read from the properties."""
    status = F.get_json_object("properties", "$.status")
    return (F.col("event_type") == "login") & status.isin(*schema.LOGIN_FAILURE_STATUSES)


def trailing_counts(
    events: DataFrame, bursts: list[Burst], slice_width: timedelta | None = None
) -> DataFrame:
    """Flagged events in the trailing window of each detector, as columns ``_n<i>``
    next to ``event_id``, ``user_id``, ``timestamp`` and the detectors' own columns.

    Windows no longer than a slice take one shuffle by (user, time slice) for all detectors: an event is copied
    to the next slice only if a window it counts for reaches over the edge. Longer windows are counted by
    prefix sums. ``slice_width`` defaults to the longest window, ``SLICE`` at most.
    """
    longest = max(b.window for b in bursts)
    width = slice_width or min(longest, SLICE)
    if longest > width:
        return prefix_counts(events, bursts, width).drop("_us", "_slice")
    width = micros(width)
    flags = [b.flag.cast("int").alias(f"_f{i}") for i, b in enumerate(bursts)]
    # what only some events are counted by is not carried along with the others
    own = {b.by: F.when(b.flag, F.col(b.by)).alias(b.by) for b in bursts if b.by}
    marked = events.select("event_id", "user_id", F.unix_micros("timestamp").alias("_at"), *own.values(), *flags)
    reach = F.lit(0).cast("bigint")
    for i, burst in enumerate(bursts):
        reach = F.greatest(reach, F.when(F.col(f"_f{i}") == 1, F.lit(micros(burst.window))))
    rows = sliced(marked.withColumn("_reach", reach).filter("_reach > 0"), F.col("_at"), width, F.col("_reach"))
    rows = rows.drop("_at", "_reach")
    for i, burst in sorted(enumerate(bursts), key=lambda p: p[1].by is not None):
        keys = ["user_id", "_slice", *([burst.by] if burst.by else [])]
        upto = (
            Window.partitionBy(*keys).orderBy("_us", "event_id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        past = (
            Window.partitionBy(*keys).orderBy("_us")
            .rangeBetween(Window.unboundedPreceding, -micros(burst.window))
        )
        flag = F.col(f"_f{i}")
        rows = rows.withColumn(
            f"_n{i}", F.when(flag == 1, F.sum(flag).over(upto) - F.coalesce(F.sum(flag).over(past), F.lit(0)))
        )
    counted = rows.filter("_own").withColumn("timestamp", F.timestamp_micros("_us"))
    return counted.drop("_own", "_us", "_slice", *[f"_f{i}" for i in range(len(bursts))])


def prefix_counts(events: DataFrame, bursts: list[Burst], width: timedelta) -> DataFrame:
    """What ``trailing_counts`` gives, with ``_us`` and ``_slice``, for windows of any length.

    Rows are shuffled once, by (user, slice). What the slices before a slice sum up to is a
    row for each user and slice with a change, as many as the log has slices at most for any user.
    """
    own = {b.by: F.when(b.flag, F.col(b.by)).alias(b.by) for b in bursts if b.by}
    flags = [b.flag.cast("int").alias(f"_f{i}") for i, b in enumerate(bursts)]
    # an event, number -1, and its leaving of each window that it counts for
    leaving = [
        F.when(b.flag, F.struct(F.lit(i).alias("number"), (F.unix_micros("timestamp") + micros(b.window)).alias("at"))) for i, b in enumerate(bursts)
    ]
    counts_at_all = reduce(Column.__or__, [F.coalesce(b.flag, F.lit(False)) for b in bursts])
    changes = F.array_compact(F.array(F.struct(F.lit(-1).alias("number"), F.unix_micros("timestamp").alias("at")), *leaving))
    rows = events.filter(counts_at_all).select("event_id", "user_id", *own.values(), *flags, F.explode(changes).alias("_c"))
    rows = rows.select("*", F.col("_c.number").alias("_number"), F.col("_c.at").alias("_us")).drop("_c")
    rows = rows.withColumn("_slice", floor_div(F.col("_us"), micros(width)))

    def change(i: int) -> Column:
        return F.when(F.col("_number") == -1, F.col(f"_f{i}")).when(F.col("_number") == i, F.lit(-1))

    def earlier(*keys: str):
        return Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    # what the slices before a slice sum up to
    carried = []
    plain = [i for i, b in enumerate(bursts) if not b.by]
    if plain:
        totals = rows.groupBy("user_id", "_slice").agg(*[F.sum(change(i)).alias(f"_t{i}") for i in plain])
        sums = [F.coalesce(F.sum(f"_t{i}").over(earlier("user_id")), F.lit(0)).alias(f"_b{i}") for i in plain]
        carried.append(totals.select("user_id", "_slice", *sums))
    for i, b in enumerate(bursts):
        if b.by:
            totals = rows.filter(change(i) != 0).groupBy("user_id", b.by, "_slice").agg(F.sum(change(i)).alias("_t"))
            sums = totals.select("user_id", "_slice", F.struct(b.by).alias("group"), F.coalesce(F.sum("_t").over(earlier("user_id", b.by)), F.lit(0)).alias("before"))
            carried.append(sums.groupBy("user_id", "_slice").agg(F.map_from_entries(F.collect_list(F.struct("group", "before"))).alias(f"_b{i}")))
    for i, burst in sorted(enumerate(bursts), key=lambda p: p[1].by is not None):
        keys = ["user_id", "_slice", *([burst.by] if burst.by else [])]
        # what leaves at an instant has left for the events of that instant
        upto = Window.partitionBy(*keys).orderBy("_us", F.desc("_number"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(f"_n{i}", F.sum(change(i)).over(upto))
    counted = rows.filter("_number = -1")
    for sums in carried:
        counted = counted.join(sums, ["user_id", "_slice"], "left")
    for i, b in enumerate(bursts):
        before = F.try_element_at(f"_b{i}", F.struct(b.by)) if b.by else F.col(f"_b{i}")
        counted = counted.withColumn(f"_n{i}", F.when(F.col(f"_f{i}") == 1, F.col(f"_n{i}") + before))
    gone = [f"{c}{i}" for i in range(len(bursts)) for c in ("_f", "_b")]
    return counted.withColumn("timestamp", F.timestamp_micros("_us")).drop("_number", *gone)


def _alert(alert_type: str, severity: str, message: Column, data: list[Column]) -> Column:
    return F.struct(
        F.lit(alert_type).alias("alert_type"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        F.to_json(F.struct(*data)).alias("trigger_data"),
    )


def _alert_rows(hits: DataFrame, alert: str = "_alert") -> DataFrame:
    """Alert records; the id is a digest of what makes the alert unique."""
    return hits.select(
        F.sha2(F.concat_ws(":", f"{alert}.alert_type", "user_id", "event_id"), 256).alias("alert_id"),
        F.col(f"{alert}.alert_type"),
        "user_id",
        F.col(f"{alert}.severity"),
        F.col(f"{alert}.message"),
        F.col(f"{alert}.trigger_data"),
        "timestamp",
        F.lit(False).alias("resolved"),
        "event_id",
    )


def burst_alert(burst: Burst, count: Column) -> Column:
    data = [count.alias(COUNT_FIELDS[burst.alert_type]), F.lit(burst.threshold).alias("threshold")]
    if burst.by:
        data.insert(0, F.col(burst.by).alias(burst.by))
        message = F.format_string(message_format(burst.alert_type, burst.window), F.col(burst.by), count)
    else:
        message = F.format_string(message_format(burst.alert_type, burst.window), count)
    return _alert(burst.alert_type, burst.severity, message, data)


def burst_alerts(
    events: DataFrame, bursts: list[Burst] | None = None, slice_width: timedelta | None = None
) -> DataFrame:
    """Alerts of the count detectors: one per event over its limit."""
    bursts = bursts if bursts is not None else default_bursts()
    counted = trailing_counts(events, bursts, slice_width)
    hits = F.array(*[
        F.when(F.col(f"_n{i}") > b.threshold, burst_alert(b, F.col(f"_n{i}")))
        for i, b in enumerate(bursts)
    ])
    over = [F.col(f"_n{i}") > b.threshold for i, b in enumerate(bursts)]
    anything = reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in over])
    found = counted.filter(anything).withColumn(
        "_alert", F.explode(F.filter(hits, lambda a: a.isNotNull()))
    )
    return _alert_rows(found)


def _after(state: Column, dense: Column, events: Column, states: int) -> Column:
    """The failures since the last alert, capped, after so many dense or other events."""
    return F.when(dense, F.pmod(state + events, F.lit(states))).otherwise(F.least(state + events, F.lit(states - 1))).cast("int")


def _long_failure_bursts(events: DataFrame, failed: Column, threshold: int, window: timedelta, width: timedelta) -> DataFrame:
    """``failure_bursts`` with slices narrower than the window.

    Prefix sums tell the dense events. In a slice, neighbours that are all dense, or all not, are one
    step on the state; so a slice keeps its runs, not its events, and is a map of the states.
    """
    kind, severity = LOGIN_FAILURE[:2]
    counted = prefix_counts(events, [Burst(kind, severity, threshold, window, failed)], width)
    rows = counted.select("event_id", "user_id", "_slice", "_us", (F.col("_n0") >= threshold).alias("_dense"))
    in_slice = Window.partitionBy("user_id", "_slice").orderBy("_us", "event_id")
    rows = rows.withColumn("_pos", F.row_number().over(in_slice)).withColumn(
        "_first", F.when(F.col("_dense") == F.lag("_dense").over(in_slice), F.lit(None)).otherwise(F.col("_pos"))
    )
    # the place of its first event is a run's number
    rows = rows.withColumn("_run", F.last("_first", ignorenulls=True).over(in_slice)).drop("_first")
    runs = rows.groupBy("user_id", "_slice", "_run").agg(F.first("_dense").alias("_dense"), F.count("*").cast("int").alias("_length"))
    slices = runs.groupBy("user_id", "_slice").agg(
        F.sort_array(F.collect_list(F.struct("_run", "_dense", "_length"))).alias("_runs"), F.max("_dense").alias("_any")
    )
    # only users with a dense event somewhere can alert
    slices = slices.withColumn("_any", F.max("_any").over(Window.partitionBy("user_id"))).filter("_any")
    turned = F.aggregate(
        "_runs", identity(threshold), lambda acc, r: F.transform(acc, lambda s: _after(s, r["_dense"], r["_length"], threshold))
    )
    steps = slices.select("user_id", "_slice", turned.alias("_fn"))
    starts = prefix_states(steps, ["user_id"], "_slice", "_fn", threshold, threshold - 1, levels=1)
    # the state as each run begins
    begun = F.aggregate(
        "_runs", F.struct(F.col("state").cast("int").alias("state"), F.array().cast("array<struct<run:int,state:int>>").alias("out")),
        lambda acc, r: F.struct(
            _after(acc["state"], r["_dense"], r["_length"], threshold).alias("state"),
            F.when(r["_dense"], F.concat(acc["out"], F.array(F.struct(r["_run"].alias("run"), acc["state"].alias("state"))))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    entry = slices.join(starts, ["user_id", "_slice"]).select("user_id", "_slice", F.map_from_entries(begun).alias("_states"))
    state = F.try_element_at("_states", F.col("_run")) + F.col("_pos") - F.col("_run")
    return (
        rows.filter("_dense").join(entry, ["user_id", "_slice"])
        .filter(F.pmod(state, F.lit(threshold)) == threshold - 1)
        .select(
            "event_id", "user_id", F.timestamp_micros("_us").alias("timestamp"),
            F.lit(threshold).cast("bigint").alias("fail_count"),
        )
    )


def failure_bursts(
    events: DataFrame, failed: Column | None = None,
    threshold: int = LOGIN_FAILURE[2], window: timedelta = LOGIN_FAILURE[3], slice_width: timedelta | None = None,
) -> DataFrame:
    """Failed logins that complete a burst: the ``threshold``-th within ``window``
    since the user's previous alert, which clears what was counted.

    An event is *dense* if the ``threshold`` latest failures up to it lie within
    the window. It alerts if it is dense and at least ``threshold`` failures
    came since the last alert, so the only state is that number, capped: a
    dense event turns it round, any other raises it. In a slice as wide as
    the window only the first ``threshold - 1`` events can be not dense, hence a
    slice's effect on the state follows from these flags and its size. Where the window is longer
    than a slice, see ``_long_failure_bursts``.
    """
    chosen = failed if failed is not None else login_failed()
    slice_width = slice_width or min(window, SLICE)
    if window > slice_width:
        return _long_failure_bursts(events, chosen, threshold, window, slice_width)
    width, states = micros(window), threshold
    # both uses of the rows below need the same columns, so they share one shuffle
    kept = events.filter(chosen).select("event_id", "user_id", F.unix_micros("timestamp").alias("_at"))
    rows = sliced(kept, F.col("_at"), width, width).drop("_at")
    in_slice = Window.partitionBy("user_id", "_slice").orderBy("_us", "event_id")
    upto = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    oldest = F.lag("_us", threshold - 1).over(in_slice)
    rows = (
        rows.withColumn("_dense", F.coalesce(F.col("_us") - oldest < width, F.lit(False)))
        .withColumn("_pos", F.sum(F.col("_own").cast("int")).over(upto))
        .filter("_own")
    )

    head_len = threshold - 1
    step = lambda state, dense: _after(state, dense, F.lit(1), states)
    slices = rows.groupBy("user_id", "_slice").agg(
        F.sort_array(
            F.collect_list(F.when(F.col("_pos") <= head_len, F.struct("_pos", "_dense")))
        ).alias("_head"),
        F.count(F.lit(1)).alias("_size"),
        F.max("_dense").alias("_any"),
    )
    # only users with a dense event somewhere can alert
    anywhere = F.max("_any").over(Window.partitionBy("user_id"))
    slices = slices.withColumn("_any", anywhere).filter("_any").drop("_any")
    rest = F.greatest(F.col("_size") - head_len, F.lit(0)).cast("int")
    after_head = F.aggregate(
        "_head", identity(states), lambda acc, e: F.transform(acc, lambda s: step(s, e["_dense"]))
    )
    slices = slices.withColumn(
        "_fn", F.transform(after_head, lambda s: F.pmod(s + rest, F.lit(states)).cast("int"))
    )
    starts = prefix_states(
        slices.select("user_id", "_slice", "_fn"), ["user_id"], "_slice", "_fn", states, states - 1,
        levels=1,
    )
    entry = slices.drop("_fn", "_size").join(starts, ["user_id", "_slice"])
    before_head = F.slice("_head", F.lit(1), F.least(F.col("_pos") - 1, F.lit(head_len)).cast("int"))
    walked = F.aggregate(before_head, F.col("state"), lambda s, e: step(s, e["_dense"]).cast("int"))
    beyond = F.greatest(F.col("_pos") - threshold, F.lit(0)).cast("int")
    state = F.pmod(walked + beyond, F.lit(states))
    return (
        rows.filter("_dense").join(entry, ["user_id", "_slice"])
        .filter(state == states - 1)
        .select(
            "event_id", "user_id", F.timestamp_micros("_us").alias("timestamp"),
            F.lit(threshold).cast("bigint").alias("fail_count"),
        )
    )


def login_failure_alerts(
    events: DataFrame, failed: Column | None = None,
    threshold: int = LOGIN_FAILURE[2], window: timedelta = LOGIN_FAILURE[3],
) -> DataFrame:
    alert_type, severity = LOGIN_FAILURE[:2]
    count = F.col("fail_count")
    data = [
        count.alias(COUNT_FIELDS[alert_type]),
        F.lit(window // timedelta(minutes=1)).alias("window_minutes"),
        F.lit(threshold).alias("threshold"),
    ]
    hits = failure_bursts(events, failed, threshold, window).withColumn(
        "_alert", _alert(alert_type, severity, F.format_string(message_format(alert_type, window), count), data)
    )
    return _alert_rows(hits)


def all_alerts(
    events: DataFrame, bursts: list[Burst] | None = None, failed: Column | None = None,
    threshold: int = LOGIN_FAILURE[2], window: timedelta = LOGIN_FAILURE[3],
) -> DataFrame:
    """Alerts of all detectors; an event can raise several."""
    return burst_alerts(events, bursts).unionByName(
        login_failure_alerts(events, failed, threshold, window)
    )
