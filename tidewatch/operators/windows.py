"""Tumbling, sliding and session windows over keyed events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import floor_div, interval_text, micros
from tidewatch.operators.skew import before, carry_forward, null_safe_join, sliced
from tidewatch.session import ensure_checkpoint_dir

ZERO = timedelta(0)
HOUR = timedelta(hours=1)
FOLD_LIMIT = 2_000


def _spread_window(df: DataFrame, window: Column) -> DataFrame:
    named = df.withColumn("_w", window)
    return (
        named.withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .drop("_w")
    )


def tumbling(
    events: DataFrame, size: timedelta, offset: timedelta = ZERO, ts: str = "timestamp"
) -> DataFrame:
    """Each event with the ``[window_start, window_end)`` it falls in."""
    text = interval_text(size)
    return _spread_window(events, F.window(ts, text, text, interval_text(offset)))


def sliding(
    events: DataFrame, size: timedelta, slide: timedelta, offset: timedelta = ZERO,
    ts: str = "timestamp",
) -> DataFrame:
    """Each event once per window containing it."""
    if slide > size:
        raise ValueError("slide must not exceed the window size")
    window = F.window(ts, interval_text(size), interval_text(slide), interval_text(offset))
    return _spread_window(events, window)


def sliding_totals(
    events: DataFrame, keys: list[str], size: timedelta, slide: timedelta,
    sums: tuple[str, ...] = (), offset: timedelta = ZERO, ts: str = "timestamp",
) -> DataFrame:
    """Counts and sums per key and sliding window.

    When the slide divides the size, events are first totalled per slide-wide
    pane, and only the panes are repeated for the windows they belong to.
    """
    if slide > size:
        raise ValueError("slide must not exceed the window size")

    def totals(count: Column) -> list[Column]:
        return [count.alias("event_count"), *[F.sum(c).alias(c) for c in sums]]

    if micros(size) % micros(slide):
        rows = sliding(events, size, slide, offset, ts)
        return rows.groupBy(*keys, "window_start", "window_end").agg(*totals(F.count(F.lit(1))))
    panes = (
        tumbling(events, slide, offset, ts)
        .groupBy(*keys, F.col("window_start").alias("_pane"))
        .agg(*totals(F.count(F.lit(1))))
    )
    backward = F.sequence(F.lit(0), F.lit(micros(size) - micros(slide)), F.lit(micros(slide)))
    spread = panes.withColumn("_shift", F.explode(backward)).withColumn(
        "window_start", F.timestamp_micros(F.unix_micros("_pane") - F.col("_shift"))
    )
    return (
        spread.groupBy(*keys, "window_start")
        .agg(*totals(F.sum("event_count")))
        .withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {micros(size)} MICROSECONDS"))
    )


# --- distinct values by sketches ---------------------------------------------

SKETCH_BITS = 12


def distinct_sketches(
    events: DataFrame, keys: list[str], field: str, pane: timedelta, offset: timedelta = ZERO,
    ts: str = "timestamp", bits: int = SKETCH_BITS,
) -> DataFrame:
    """Events and a sketch of the distinct values of ``field`` per key and pane.

    A sketch has a fixed size, ``2**bits`` bytes at most, and sketches merge: the table
    answers for any run of panes without a look at the events. Null values are not
    counted; a pane with none but nulls has an empty sketch.
    """
    return tumbling(events, pane, offset, ts).groupBy(*keys, "window_start", "window_end").agg(
        F.count(F.lit(1)).alias("event_count"), F.hll_sketch_agg(field, bits).alias("sketch")
    )


def merged_distinct(panes: DataFrame, keys: list[str]) -> DataFrame:
    """Panes of ``distinct_sketches`` taken together per key: events, distinct values, merged sketch."""
    return (
        panes.groupBy(*keys)
        .agg(F.sum("event_count").alias("event_count"), F.hll_union_agg("sketch").alias("sketch"))
        .withColumn("distinct_count", F.hll_sketch_estimate("sketch"))
    )


def sliding_distinct(
    events: DataFrame, keys: list[str], field: str, size: timedelta, slide: timedelta,
    offset: timedelta = ZERO, ts: str = "timestamp", bits: int = SKETCH_BITS,
) -> DataFrame:
    """Events and estimated distinct values per key and sliding window.

    Events are sketched once, per slide-wide pane; only sketches are repeated for the
    windows they belong to. The slide divides the size.
    """
    if slide > size or micros(size) % micros(slide):
        raise ValueError("the slide must divide the window size")
    panes = distinct_sketches(events, keys, field, slide, offset, ts, bits)
    backward = F.sequence(F.lit(0), F.lit(micros(size) - micros(slide)), F.lit(micros(slide)))
    spread = panes.withColumn("_shift", F.explode(backward)).withColumn(
        "window_start", F.timestamp_micros(F.unix_micros("window_start") - F.col("_shift"))
    )
    return merged_distinct(spread, [*keys, "window_start"]).withColumn(
        "window_end", F.timestamp_micros(F.unix_micros("window_start") + micros(size))
    )


def distinct_error(bits: int = SKETCH_BITS) -> float:
    """Three standard errors of a merged estimate, as a share of the true count."""
    return 3 * 1.04 / 2 ** (bits / 2)


def field_aggregates(field: str, prefix: str | None = None) -> list[Column]:
    """Count, sum, average, minimum, maximum and distinct count of one field.

    A missing field counts as 0, except in the distinct count, which skips it.
    """
    name = prefix or field
    value = F.coalesce(F.col(field), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{name}_sum"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{name}_avg"),
        F.coalesce(F.min(value), F.lit(0.0)).alias(f"{name}_min"),
        F.coalesce(F.max(value), F.lit(0.0)).alias(f"{name}_max"),
        F.count_distinct(F.col(field)).alias(f"{name}_distinct"),
    ]


def approx_distinct(field: str) -> Column:
    """Sketch-based alternative to the exact distinct count, for very wide groups."""
    return F.approx_count_distinct(field)


def on_time(windowed: DataFrame, as_of: datetime, lateness: timedelta = ZERO) -> DataFrame:
    """Drops events whose window closed more than ``lateness`` before ``as_of``."""
    return windowed.filter(F.unix_micros(F.lit(as_of)) - F.unix_micros("window_end") <= micros(lateness))


def expired(windows: DataFrame, as_of: datetime, lateness: timedelta = ZERO) -> DataFrame:
    """Windows that are past their end and allowed lateness."""
    return windows.filter(F.unix_micros(F.lit(as_of)) > F.unix_micros("window_end") + micros(lateness))


def open_windows(windows: DataFrame, as_of: datetime, lateness: timedelta = ZERO) -> DataFrame:
    """What is left after expired windows are cleaned up."""
    return windows.filter(F.unix_micros(F.lit(as_of)) <= F.unix_micros("window_end") + micros(lateness))


def one_window(windows: DataFrame, key: Column, start: datetime, end: datetime) -> DataFrame:
    """The window of one key, taken before its time."""
    return windows.filter(key & (F.col("window_start") == F.lit(start)) & (F.col("window_end") == F.lit(end)))


def window_contents(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Events of a window as a list per key.

    For groups known to be small. The long form, one row per event and window,
    is what ``tumbling`` and ``sliding`` return, and has no such bound.
    """
    bare = [c for c in windowed.columns if c not in (*keys, "window_start", "window_end")]
    return windowed.groupBy(*keys, "window_start", "window_end").agg(
        F.sort_array(F.collect_list(F.struct(*bare))).alias("values")
    )


def ordered_contents(
    windowed: DataFrame, keys: list[str], ts: str = "timestamp", tie: str = "event_id", width: timedelta = HOUR,
) -> DataFrame:
    """Events of each key's windows with their ``position``, from 0 in order of time and ``tie``.

    Order is made inside time slices of ``width``; only the sizes of slices are added
    up, so no task holds a window whole. Rows equal in time and ``tie`` share a slice and
    are placed in either order.
    """
    group = [*keys, "window_start", "window_end"]
    rows = sliced(windowed, F.unix_micros(ts), micros(width)).drop("_own")
    sizes = rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    firsts = before(sizes, group, "_slice", "_size", "_first", F.sum, levels=1).drop("_size")
    by_time = Window.partitionBy(*group, "_slice").orderBy("_us", tie)
    placed = null_safe_join(rows.withColumn("_at", F.row_number().over(by_time)), firsts, [*group, "_slice"])
    position = F.col("_at") - 1 + F.coalesce("_first", F.lit(0))
    return placed.withColumn("position", position.cast("bigint")).drop("_us", "_slice", "_at", "_first")


def content_runs(placed: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows of ``ordered_contents`` as lists of at most ``size``, numbered by ``run``."""
    group = [*keys, "window_start", "window_end"]
    bare = [c for c in placed.columns if c not in (*group, "position")]
    return placed.groupBy(*group, floor_div(F.col("position"), size).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("position", *bare))).alias("values")
    )


# --- sessions -------------------------------------------------------------

def mark_new_sessions(
    events: DataFrame, key: str, timeout: timedelta, closes: DataFrame | None = None,
    ts: str = "timestamp", tie: str = "event_id", width: timedelta = HOUR,
) -> DataFrame:
    """Adds ``is_new_session``: no earlier event of the key within ``timeout``.

    A gap equal to the timeout continues the session. Rows of ``closes``
    (``key``, ``ts``) end the running session by hand. Each event is compared
    with its predecessor inside a time slice, so no task sorts a whole key.
    """
    gap = micros(timeout)
    slice_us = max(gap, micros(width))
    rows = events.withColumn("_close", F.lit(False))
    if closes is not None:
        marks = closes.select(key, ts).withColumn("_close", F.lit(True))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    rows = sliced(rows, F.unix_micros(ts), slice_us, gap + 1)
    by_time = Window.partitionBy(key, "_slice").orderBy("_us", "_close", tie)
    before = F.lag(F.struct("_us", "_close")).over(by_time)
    joined = before.isNotNull() & (F.col("_us") - before["_us"] <= gap) & ~before["_close"]
    return (
        rows.withColumn("is_new_session", ~joined)
        .filter(F.col("_own") & ~F.col("_close"))
        .drop("_own", "_close")
    )


def new_session_flags(events: DataFrame, key: str, timeout: timedelta, **options) -> DataFrame:
    return mark_new_sessions(events, key, timeout, **options).drop("_us", "_slice")


def _session_parts(
    flagged: DataFrame, key: str, tie: str, sums: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_part``, and the parts: what each session holds of each time slice.

    Parts carry the session (``_session``, its first instant). A part that goes on with
    a session finds it in the last slice before that opens one; that is looked up
    from a row per slice in a tree of blocks, so no task holds a key's parts.
    """
    in_slice = (
        Window.partitionBy(key, "_slice").orderBy("_us", tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = flagged.withColumn("_part", F.sum(F.col("is_new_session").cast("bigint")).over(in_slice))
    parts = (
        rows.groupBy(key, "_slice", "_part")
        .agg(
            F.min("_us").alias("_first"), F.max("_us").alias("_last"),
            F.count(F.lit(1)).alias("event_count"), *[F.sum(c).alias(c) for c in sums],
        )
    )
    facts = ["_first", "_last", "event_count", *sums]
    slices = parts.groupBy(key, "_slice").agg(
        F.max(F.when(F.col("_part") > 0, F.col("_first"))).alias("_open"),
        # one part at most goes on with a session
        F.max(F.when(F.col("_part") == 0, F.struct(*facts))).alias("_rest"),
    )
    going_on = (
        before(slices, [key], "_slice", "_open", "_session", levels=1).filter("_rest is not null")
        .select(key, "_slice", F.lit(0).cast("bigint").alias("_part"), "_rest.*", "_session")
    )
    opened = parts.filter(F.col("_part") > 0).withColumn("_session", F.col("_first"))
    return rows, opened.unionByName(going_on)


def _with_span(parts: DataFrame, key: str) -> DataFrame:
    """Parts with the span and the size of their session."""
    whole = Window.partitionBy(key, "_session")
    return (
        parts.withColumn("_span", F.max("_last").over(whole) - F.col("_session"))
        .withColumn("_n", F.sum("event_count").over(whole))
    )


def _part_totals(parts: DataFrame, key: str, timeout: timedelta, sums: tuple[str, ...]) -> DataFrame:
    return (
        parts.groupBy(key, "_session")
        .agg(
            F.timestamp_micros(F.max("_last") + micros(timeout)).alias("session_end"),
            F.sum("event_count").alias("event_count"), *[F.sum(c).alias(c) for c in sums],
        )
        .select(key, F.timestamp_micros("_session").alias("session_start"), "session_end", "event_count", *sums)
    )


def session_windows(
    events: DataFrame, key: str, timeout: timedelta, sums: tuple[str, ...] = (),
    ts: str = "timestamp", tie: str = "event_id", **options,
) -> DataFrame:
    """One row per inactivity session: start, end (last event + timeout), count, sums."""
    flagged = mark_new_sessions(events, key, timeout, ts=ts, tie=tie, **options)
    return _part_totals(_session_parts(flagged, key, tie, sums)[1], key, timeout, sums)


def inactive_sessions(sessions: DataFrame, as_of: datetime, threshold: timedelta) -> DataFrame:
    """Sessions whose end lies more than ``threshold`` before ``as_of``."""
    return sessions.filter(
        F.unix_micros(F.lit(as_of)) - F.unix_micros("session_end") > micros(threshold)
    )


def _walk_by_fold(rows: DataFrame, keys: list[str], limit: int, tie: str) -> DataFrame:
    """Session starts inside stretches of bounded size: one ordered pass over each."""
    bare = [c for c in rows.columns if c not in (*keys, "_us", tie, "is_new_session")]
    item = F.struct("_us", tie, *bare)
    done = "array<struct<start:bigint,is_new:boolean>>"

    def step(acc: Column, e: Column) -> Column:
        new = acc["start"].isNull() | (e["_us"] - acc["start"] > limit)
        start = F.when(new, e["_us"]).otherwise(acc["start"])
        return F.struct(
            start.alias("start"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), new.alias("is_new")))).alias("out"),
        )

    walked = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    first = F.struct(F.lit(None).cast("bigint").alias("start"), F.array().cast(done).alias("out"))
    marked = F.arrays_zip(
        F.col("_items").alias("e"), F.aggregate("_items", first, step)["out"].alias("s")
    )
    return walked.select(*keys, F.explode(marked).alias("_m")).select(
        *keys, "_m.e.*", F.col("_m.s.start").alias("_start"), F.col("_m.s.is_new").alias("is_new_session")
    )


def _starts_by_jumps(long: DataFrame, keys: list[str], limit: int, slice_us: int) -> DataFrame:
    """The same for islands of any size: every time points at the first time out of
    its reach, and the times on the chain are marked by doubling the jumps.

    Takes ``log2(sessions per island)`` rounds of equi-joins on (island, time),
    which split evenly however large one island is.
    """
    ensure_checkpoint_dir(long.sparkSession)
    node = [*keys, "_us"]
    times = long.select(*node, "_gap").distinct().checkpoint()
    # the next time lies at most one timeout past t + limit, as an island has no
    # longer gap; look for it from the other side, time running backwards
    reach = limit + F.col("_gap")
    back = sliced(
        times.withColumn("_t", F.col("_us")), -F.col("_us"), slice_us, reach + 1,
    )
    ahead = (
        Window.partitionBy(*keys, "_slice").orderBy("_us")
        .rangeBetween(Window.unboundedPreceding, -(limit + 1))
    )
    jump = (
        back.withColumn("_to", F.max(F.struct("_us")).over(ahead)["_us"])
        .filter("_own")
        .select(*keys, F.col("_t").alias("_us"), (-F.col("_to")).alias("_to"))
        .filter("_to is not null")
        .checkpoint()
    )
    reached = times.groupBy(*keys).agg(F.min("_us").alias("_us"))
    total = -1
    while True:
        hops = reached.join(jump, node).select(*keys, F.col("_to").alias("_us"))
        reached = reached.union(hops).distinct().checkpoint()
        size = reached.count()
        if size == total:
            break
        total = size
        further = jump.select(*keys, F.col("_us").alias("_to"), F.col("_to").alias("_next"))
        jump = (
            jump.join(further, [*keys, "_to"])
            .select(*keys, "_us", F.col("_next").alias("_to"))
            .checkpoint()
        )
    first = times.groupBy(*keys).agg(F.min("_us").alias("_first"))
    return reached.join(first, keys).filter("_us > _first").drop("_first")


def _walk_by_jumps(
    rows: DataFrame, keys: list[str], limit: int, gap: int, tie: str
) -> DataFrame:
    """The same for stretches of any size."""
    nodes = rows.select(*keys, "_us").withColumn("_gap", F.lit(gap))
    inner = _starts_by_jumps(nodes, keys, limit, max(limit, gap)).withColumn("_inner", F.lit(True))
    at_once = Window.partitionBy(*keys, "_slice", "_us").orderBy(F.desc("is_new_session"), tie)
    marked = (
        rows.join(inner, [*keys, "_us"], "left")
        .withColumn("is_new_session", F.col("is_new_session") | (
            F.coalesce(F.col("_inner"), F.lit(False)) & (F.row_number().over(at_once) == 1)
        ))
        .withColumn("_open", F.when(F.col("is_new_session"), F.col("_us")))
        .drop("_inner")
    )
    return carry_forward(marked, keys, ["_us", tie], "_open", "_start").drop("_open")


def _walk(rows: DataFrame, keys: list[str], limit: int, gap: int, tie: str, fold_limit: int,
          crowded: bool) -> DataFrame:
    """Rows of long stretches with ``_start`` and ``is_new_session``."""
    small = rows.filter(F.col("_n") <= fold_limit).drop("_n")
    out = _walk_by_fold(small, keys, limit, tie)
    if crowded:
        large = _walk_by_jumps(rows.filter(F.col("_n") > fold_limit).drop("_n"), keys, limit, gap, tie)
        out = out.unionByName(large)
    return out


def capped_sessions(
    events: DataFrame, key: str, timeout: timedelta, max_length: timedelta,
    ts: str = "timestamp", tie: str = "event_id", fold_limit: int = FOLD_LIMIT, **options,
) -> DataFrame:
    """Events with ``session_start`` and ``is_new_session`` under a length limit.

    A session also ends at the first event more than ``max_length`` after its
    start. Stretches without a gap that are no longer than that are one session.
    Longer ones are walked: in one pass where they hold at most ``fold_limit``
    events, by jump doubling where they hold more.
    """
    limit, gap = micros(max_length), micros(timeout)
    flagged = mark_new_sessions(events, key, timeout, ts=ts, tie=tie, **options)
    rows, parts = _session_parts(flagged, key, tie, ())
    parts = _with_span(parts, key)
    crowded = not parts.filter((F.col("_span") > limit) & (F.col("_n") > fold_limit)).isEmpty()
    placed = rows.join(
        parts.select(key, "_slice", "_part", "_session", "_span", "_n"), [key, "_slice", "_part"]
    ).drop("_part")
    short = placed.filter(F.col("_span") <= limit).withColumn("_start", F.col("_session"))
    long = placed.filter(F.col("_span") > limit).drop("_span")
    walked = _walk(long, [key, "_session"], limit, gap, tie, fold_limit, crowded)
    return (
        short.drop("_span", "_n").unionByName(walked)
        .withColumn("session_start", F.timestamp_micros("_start"))
        .drop("_us", "_slice", "_session", "_start")
    )


def capped_session_windows(
    events: DataFrame, key: str, timeout: timedelta, max_length: timedelta,
    sums: tuple[str, ...] = (), ts: str = "timestamp", tie: str = "event_id",
    fold_limit: int = FOLD_LIMIT, **options,
) -> DataFrame:
    """One row per session under a length limit.

    Short stretches are totalled from their parts; only the events of long ones,
    whose parts are kept aside, are looked at one by one.
    """
    limit, gap = micros(max_length), micros(timeout)
    ensure_checkpoint_dir(events.sparkSession)
    slim = events.select(*dict.fromkeys([key, ts, tie, *sums]))
    flagged = mark_new_sessions(slim, key, timeout, ts=ts, tie=tie, **options)
    rows, parts = _session_parts(flagged, key, tie, sums)
    parts = _with_span(parts, key)
    long = (
        parts.filter(F.col("_span") > limit).select(key, "_slice", "_part", "_session", "_n").checkpoint()
    )
    crowded = not long.filter(F.col("_n") > fold_limit).isEmpty()
    stretch = rows.join(long, [key, "_slice", "_part"]).select(
        key, "_session", "_us", tie, "is_new_session", "_slice", "_n", *[c for c in sums if c != tie]
    )
    walked = _walk(stretch, [key, "_session"], limit, gap, tie, fold_limit, crowded)
    capped = walked.select(
        key, F.col("_start").alias("_session"), F.col("_us").alias("_last"),
        F.lit(1).cast("bigint").alias("event_count"), *sums,
    )
    short = parts.filter(F.col("_span") <= limit).select(key, "_session", "_last", "event_count", *sums)
    return _part_totals(short.unionByName(capped), key, timeout, sums)
