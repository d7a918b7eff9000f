"""Per-key state on streams: trailing counts, capped sessions, order replay.

Rows of a key are put in order within a micro-batch and state carries over
between micro-batches, so results equal the batch operators wherever events
reach the stream in order from one micro-batch to the next. A late event within
the watermark is counted from then on; results already emitted stay.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.functions.timeutil import interval_text, micros
from tidewatch.operators import audit
from tidewatch.operators.detect import (
    LOGIN_FAILURE, Burst, _alert, _alert_rows, burst_alert, default_bursts, login_failed,
    COUNT_FIELDS, message_format,
)

FAILURE_SLOT = -1


class _Ordered(StatefulProcessor):
    """Base: all rows of a key in one micro-batch as one ordered frame."""

    def __init__(self, order: list[str]):
        self.order = order

    def rows(self, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(batches), ignore_index=True).sort_values(self.order, kind="stable")

    def close(self) -> None:
        pass


class TrailingCounter(_Ordered):
    """Counts a user's events in the window up to each event, per detector and ``by``.

    State is the instants still inside their windows. For login failures they are
    cleared as soon as their number reaches the limit, which is reported. A timer,
    one per key with state, drops what a silent user has left.
    """

    def __init__(self, windows: dict[int, int], limits: dict[int, int]):
        super().__init__(["us", "event_id"])
        self.windows, self.limits = windows, limits

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("instants", "slot array<int>, by array<string>, us array<bigint>")

    def stored(self) -> dict[tuple[int, str], list[int]]:
        value, groups = self.kept.get(), {}
        for slot, by, us in zip(*value) if value is not None else ():
            groups.setdefault((slot, by), []).append(us)
        return groups

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = self.rows(rows)
        groups: dict[tuple[int, str], list[int]] = {}
        for place, group in enumerate(zip(batch["slot"].tolist(), batch["by"].tolist())):
            groups.setdefault(group, []).append(place)
        instants = batch["us"].to_numpy(dtype=np.int64)
        counts, hit = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=bool)
        known = self.stored()
        had_state = bool(known)
        for group, places in groups.items():
            old, width, limit = known.get(group, []), self.windows[group[0]], self.limits[group[0]]
            if group[0] == FAILURE_SLOT:
                found, known[group] = self._with_reset(old, instants[places], width, limit)
                hit[places] = found >= limit
            else:
                found, known[group] = self._plain(old, instants[places], width)
                hit[places] = found > limit
            counts[places] = found
        self._store(known, had_state)
        if hit.any():
            out = batch.loc[hit, ["slot", "by", "event_id", "us"]].copy()
            out.insert(0, "user_id", key[0])
            out["n"] = counts[hit]
            yield out

    def _store(self, known: dict[tuple[int, str], list[int]], had_state: bool) -> None:
        newest = max((times[-1] for times in known.values() if times), default=None)
        flat = [
            (slot, by, t) for (slot, by), times in known.items() for t in times
            if t > newest - self.windows[slot]
        ]
        if flat:
            self.kept.update(tuple(list(c) for c in zip(*flat)))
            if not had_state:
                self.handle.registerTimer(self._silent_after(known))
        elif had_state:
            self.kept.clear()

    def _silent_after(self, known: dict[tuple[int, str], list[int]]) -> int:
        return max(times[-1] + self.windows[slot] for (slot, _), times in known.items() if times) // 1000 + 1

    @staticmethod
    def _plain(old: list[int], new: np.ndarray, width: int) -> tuple[np.ndarray, list[int]]:
        before = np.array(old, dtype=np.int64)
        if not old or new[0] >= before[-1]:
            every = np.concatenate([before, new])
            upto = np.arange(len(before) + 1, len(every) + 1)
            counts = upto - np.searchsorted(every, new - width, side="right")
        else:
            # late events: what is stored counts, whether earlier or later
            upto = np.arange(1, len(new) + 1) - np.searchsorted(new, new - width, side="right")
            counts = upto + len(before) - np.searchsorted(before, new - width, side="right")
            every = np.sort(np.concatenate([before, new]))
        return counts, every[every > every[-1] - width].tolist()

    @staticmethod
    def _with_reset(old: list[int], new: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, list[int]]:
        recent, counts = deque(old), []
        for t in new.tolist():
            recent.append(t)
            while recent[0] <= t - width:
                recent.popleft()
            counts.append(len(recent))
            if len(recent) >= limit:
                recent.clear()
        return np.array(counts, dtype=np.int64), sorted(recent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.stored()
        if known:
            until = self._silent_after(known)
            if until > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(until)
            else:
                self.kept.clear()
        return iter([])


def alert_stream(
    events: DataFrame, bursts: list[Burst] | None = None, failed: Column | None = None,
    threshold: int = LOGIN_FAILURE[2], window: timedelta = LOGIN_FAILURE[3],
    lateness: timedelta = timedelta(seconds=30),
) -> DataFrame:
    """Alerts of all detectors as a stream.

    State has two keys per user, one for the first detector (all events, by
    default) and one for the others, so that a busy user's events are split.
    """
    bursts = bursts if bursts is not None else default_bursts()
    chosen = failed if failed is not None else login_failed()

    def slot(number: int, flag: Column, by: str | None, part: int) -> Column:
        group = F.coalesce(F.col(by), F.lit("")) if by else F.lit("")
        return F.when(flag, F.struct(F.lit(number).alias("slot"), group.alias("by"), F.lit(part).alias("part")))

    slots = [slot(i, b.flag, b.by, 0 if i == 0 else 1) for i, b in enumerate(bursts)]
    slots.append(slot(FAILURE_SLOT, chosen, None, 1))
    spread = (
        events.withWatermark("timestamp", interval_text(lateness))
        .withColumn("_s", F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())))
        .select(
            "user_id", F.col("_s.part"), F.col("_s.slot"), F.col("_s.by"), "event_id", "timestamp",
            F.unix_micros("timestamp").alias("us"),
        )
    )
    counter = TrailingCounter(
        {FAILURE_SLOT: micros(window), **{i: micros(b.window) for i, b in enumerate(bursts)}},
        {FAILURE_SLOT: threshold, **{i: b.threshold for i, b in enumerate(bursts)}},
    )
    hits = spread.groupBy("user_id", "part").transformWithStateInPandas(
        counter, "user_id string, slot int, by string, event_id string, us bigint, n bigint", "append", "EventTime"
    )
    n, alert = F.col("n"), None
    for i, b in enumerate(bursts):
        made = burst_alert(Burst(b.alert_type, b.severity, b.threshold, b.window, b.flag, None), n)
        if b.by:
            made = _alert(b.alert_type, b.severity, F.format_string(message_format(b.alert_type, b.window), F.col("by"), n), [
                F.col("by").alias(b.by), n.alias(COUNT_FIELDS[b.alert_type]), F.lit(b.threshold).alias("threshold")])
        alert = F.when(F.col("slot") == i, made) if alert is None else alert.when(F.col("slot") == i, made)
    kind, severity = LOGIN_FAILURE[:2]
    burst = _alert(kind, severity, F.format_string(message_format(kind, window), n), [
        n.alias(COUNT_FIELDS[kind]), F.lit(window // timedelta(minutes=1)).alias("window_minutes"),
        F.lit(threshold).alias("threshold")])
    alert = burst if alert is None else alert.otherwise(burst)
    return _alert_rows(hits.withColumn("timestamp", F.timestamp_micros("us")).withColumn("_alert", alert))


class CappedSessions(_Ordered):
    """Session start of each event under a timeout and a length limit."""

    def __init__(self, timeout_us: int, limit_us: int | None):
        super().__init__(["us", "event_id"])
        self.timeout_us, self.limit_us = timeout_us, limit_us

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "first bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = self.rows(rows)
        known = self.session.get()
        first, last = (known[0], known[1]) if known is not None else (None, None)
        starts, flags = [], []
        for t, close in zip(batch["us"].tolist(), batch["is_close"].tolist()):
            if close:
                first = last = None
                starts.append(None)
                flags.append(False)
                continue
            new = (
                last is None or t - last > self.timeout_us
                or (self.limit_us is not None and t - first > self.limit_us)
            )
            first = t if new else first
            last = t if new else max(last, t)
            starts.append(first)
            flags.append(new)
        if last is not None:
            self.session.update((int(first), int(last)))
            if known is None:
                self.handle.registerTimer((int(last) + self.timeout_us) // 1000 + 1)
        elif known is not None:
            self.session.clear()
        out = batch[["event_id", "us"]].copy()
        out.insert(0, "key", key[0])
        out["start_us"] = pd.array(starts, dtype="Int64")
        out["is_new_session"] = flags
        yield out[out["start_us"].notna()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.session.get()
        if known is not None:
            until = (known[1] + self.timeout_us) // 1000 + 1
            if until > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(until)
            else:
                self.session.clear()
        return iter([])


def session_stream(
    events: DataFrame, key: str, timeout: timedelta, max_length: timedelta | None = None,
    lateness: timedelta = timedelta(seconds=30), close: Column | None = None,
) -> DataFrame:
    """Events with ``session_start`` and ``is_new_session``; rows where ``close`` holds
    end the running session and are not themselves events."""
    rows = events.withWatermark("timestamp", interval_text(lateness)).select(
        F.col(key), "event_id", "timestamp", F.unix_micros("timestamp").alias("us"),
        F.coalesce(close if close is not None else F.lit(False), F.lit(False)).alias("is_close"),
    )
    walker = CappedSessions(micros(timeout), None if max_length is None else micros(max_length))
    out = rows.groupBy(key).transformWithStateInPandas(
        walker, "key string, event_id string, us bigint, start_us bigint, is_new_session boolean", "append", "EventTime"
    )
    return out.select(
        F.col("key").alias(key), "event_id", F.timestamp_micros("us").alias("timestamp"),
        F.timestamp_micros("start_us").alias("session_start"), "is_new_session",
    )


class OrderReplay(_Ordered):
    """Applies review requests to an order whose status is the state.

    Stored orders are the state to begin with; requests for others are refused, their status is null. A
    closed order takes no request any more; it is dropped when the watermark is ``keep_ms`` past its closing, and
    unknown from then on.
    """

    def __init__(self, keep_ms: int):
        super().__init__(["seq"])
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")

    def _set(self, status: str, at_us: int) -> None:
        self.status.update((status,))
        if not audit.TRANSITIONS[status]:
            self.handle.registerTimer(int(at_us) // 1000 + self.keep_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        status, us = initialState[["status", "us"]].iloc[-1]
        if status in audit.TRANSITIONS:
            self._set(status, us)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = self.rows(rows)
        known = self.status.get()
        status = known[0] if known is not None else None
        before, after = [], []
        for action, wanted in zip(batch["action"], batch["status"]):
            before.append(status)
            if status is not None:
                wanted = "closed" if action == "close" else wanted
                status = audit.status_after(action, status, wanted)
            after.append(status)
        if known is not None and status != known[0]:
            self._set(status, batch["us"].max())
        out = batch[["seq", "action"]].copy()
        out.insert(0, "order_id", key[0])
        out["status_before"], out["status_after"] = before, after
        out["accepted"] = [x != y for x, y in zip(before, after)]
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.status.clear()
        return iter([])


def replay_stream(
    requests: DataFrame, orders: DataFrame, keep_closed: timedelta = timedelta(days=30), lateness: timedelta = timedelta(days=1),
) -> DataFrame:
    """Outcome of each request; ``orders``, as stored when the job first starts, have the statuses to begin with.

    Requests that come later than ``lateness`` after newer ones are dropped. Closed orders are kept for ``keep_closed``.
    """
    us = F.unix_micros("request_time").alias("us")
    rows = requests.withWatermark("request_time", interval_text(lateness)).select("order_id", "seq", "action", "status", us, "request_time")
    stored = orders.select(F.col("id").alias("order_id"), "status", F.unix_micros("update_time").alias("us"))
    return rows.groupBy("order_id").transformWithStateInPandas(
        OrderReplay(keep_closed // timedelta(milliseconds=1)),
        "order_id string, seq bigint, action string, status_before string, status_after string, accepted boolean",
        "append", "EventTime", initialState=stored.groupBy("order_id"),
    )


class TagFeed(_Ordered):
    """The effect of each tag change of a user on what the user holds.

    State is the latest change of each tag, removals included, and of the last removal of all tags, so that a change
    that arrives after a later one has no effect.
    """

    def __init__(self):
        super().__init__(["ts", "seq"])

    def init(self, handle) -> None:
        self.kept = handle.getValueState(
            "tags", "tag array<string>, ts array<bigint>, seq array<bigint>, deleted array<boolean>, value array<string>, "
            "cleared_ts bigint, cleared_seq bigint"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = self.rows(rows)
        stored = self.kept.get()
        held, cleared = {}, (-(2**63), 0)
        if stored is not None:
            held = {tag: tuple(rest) for tag, *rest in zip(*stored[:5])}
            cleared = tuple(stored[5:7])
        out = []
        batch = batch.astype(object).where(batch.notna(), None)
        columns = [batch[c].tolist() for c in ("tag_name", "ts", "seq", "deleted", "value", "source")]
        changes = sorted(zip(*columns), key=lambda c: (c[1], c[2], c[3], c[4] or ""))
        for tag, ts, seq, deleted, value, source in changes:
            if tag is None:
                if (ts, seq) <= cleared:
                    continue
                cleared = (ts, seq)
                for name in sorted(held):
                    old = held[name]
                    if not old[2] and (old[0], old[1]) < cleared:
                        out.append(("delete", name, None, old[3], source, ts))
                        held[name] = (ts, seq, True, None)
                continue
            old = held.get(tag)
            if (ts, seq) < cleared or old is not None and (ts, seq, deleted, value or "") < (*old[:3], old[3] or ""):
                continue
            before = old[3] if old is not None and not old[2] else None
            if not deleted:
                out.append(("update", tag, value, before, source, ts))
            elif old is not None and not old[2]:
                out.append(("delete", tag, None, before, source, ts))
            held[tag] = (ts, seq, deleted, None if deleted else value)
        tags = list(held)
        self.kept.update((tags, *[[held[t][i] for t in tags] for i in range(4)], *cleared))
        if out:
            made = pd.DataFrame(out, columns=["change", "tag_name", "value", "old_value", "source", "ts"], dtype=object)
            made.insert(0, "user_id", key[0])
            made["ts"] = made["ts"].astype("int64")
            yield made


def tag_feed(changes: DataFrame) -> DataFrame:
    """Tag updates and deletions as they take effect, each with the value that it replaces.

    ``changes`` is the change log as a stream. A removal of what the user does not hold is no event; one without a tag name
    is a deletion of each tag held. Changes of a user apply by time and ``seq``; one that comes in a later micro-batch
    than a later change of its tag has no effect, as in the table read latest-wins.
    """
    rows = changes.select(
        "user_id", "tag_name", F.unix_micros("ts").alias("ts"), F.coalesce("seq", F.lit(0).cast("bigint")).alias("seq"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"), "value", "source",
    )
    out = rows.groupBy("user_id").transformWithStateInPandas(
        TagFeed(), "user_id string, change string, tag_name string, value string, old_value string, source string, ts bigint", "append", "None"
    )
    return out.withColumn("ts", F.timestamp_micros("ts"))
