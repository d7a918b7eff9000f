"""Instants, windows, buckets and intervals as column expressions.

Every instant is a ``timestamp`` in a UTC session; widths and gaps are
``datetime.timedelta``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit suffixes of readable durations.
DURATION_UNITS = ((60, 1, "秒"), (3600, 60, "分钟"), (86400, 3600, "小时"), (None, 86400, "天"))


def micros(delta: timedelta) -> int:
    return delta // timedelta(microseconds=1)


def interval_text(delta: timedelta) -> str:
    """The form ``window`` and ``withWatermark`` take."""
    return f"{micros(delta)} microseconds"


def floor_div(value: Column, width: int | Column) -> Column:
    """Integer division rounding down, so instants before 1970 fall in the right slot."""
    step = width if isinstance(width, Column) else F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, step), step)


def to_utc(value: Column) -> Column:
    """Zone-less values are taken as UTC; the session time zone is UTC."""
    return value.cast("timestamp")


def epoch_millis(value: Column) -> Column:
    return F.unix_millis(value)


def from_epoch_millis(value: Column) -> Column:
    return F.timestamp_millis(value)


def format_iso(value: Column) -> Column:
    """ISO 8601 with an explicit offset; the fraction is shown only when there is one."""
    head = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(F.unix_micros(value), F.lit(1_000_000))
    text = F.when(fraction == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
    )
    return F.concat(head, text, F.lit("+00:00"))


def parse_iso(value: Column) -> Column:
    """ISO 8601 text; ``Z`` and offsets are accepted, unreadable text becomes null."""
    return F.try_to_timestamp(value)


def window_start(value: Column, size: timedelta, offset: timedelta = timedelta(0)) -> Column:
    width, shift = F.lit(micros(size)), F.lit(micros(offset))
    at = F.unix_micros(value)
    return F.timestamp_micros(at - F.pmod(at - shift, width))


def window_end(value: Column, size: timedelta, offset: timedelta = timedelta(0)) -> Column:
    return window_start(value, size, offset) + F.expr(f"INTERVAL {micros(size)} MICROSECONDS")


def in_window(value: Column, start: Column, end: Column) -> Column:
    """Half-open: the start belongs to the window, the end does not."""
    return (value >= start) & (value < end)


def time_buckets(start: Column, end: Column, size: timedelta) -> Column:
    """Array of ``struct(bucket_start, bucket_end)``: aligned start, last end clipped."""
    width = micros(size)
    first, stop = F.unix_micros(window_start(start, size)), F.unix_micros(end)
    slots = F.when(
        first < stop, F.sequence(first, stop - F.lit(1), F.lit(width).cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    return F.transform(
        slots,
        lambda s: F.struct(
            F.timestamp_micros(s).alias("bucket_start"),
            F.timestamp_micros(F.least(s + F.lit(width), stop)).alias("bucket_end"),
        ),
    )


def bucket_table(spark, start: datetime, end: datetime, size: timedelta) -> DataFrame:
    """One row per bucket of a fixed range."""
    row = spark.range(1).select(
        F.lit(start).cast("timestamp").alias("s"), F.lit(end).cast("timestamp").alias("e")
    )
    return row.select(F.inline(time_buckets(F.col("s"), F.col("e"), size)))


def overlap_micros(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the common part of two half-open intervals; 0 when they only touch."""
    length = F.unix_micros(F.least(a_end, b_end)) - F.unix_micros(F.greatest(a_start, b_start))
    return F.greatest(length, F.lit(0).cast("bigint"))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common part as ``struct(start, end)``; null when there is none."""
    start, end = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def duration_micros(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def humanize(micros_value: Column) -> Column:
    """Whole seconds, minutes, hours or days, in the largest unit that fits."""
    seconds = F.call_function("div", micros_value, F.lit(1_000_000).cast("bigint"))
    result = None
    for limit, unit, suffix in DURATION_UNITS:
        text = F.concat(
            F.call_function("div", seconds, F.lit(unit).cast("bigint")).cast("string"),
            F.lit(suffix),
        )
        if result is None:
            result = F.when(seconds < limit, text)
        elif limit is not None:
            result = result.when(seconds < limit, text)
        else:
            result = result.otherwise(text)
    return result
