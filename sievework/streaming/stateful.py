"""Per-user request limits and per-session state on streams."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT_SCHEMA = "user_id long, event_id long, ts_us long, allowed boolean, remaining int, retry_after long"


def decide(accepted: list, now: int, limit: int, window: int):
    """One request against the accepted times within a window of it; times in microseconds.

    Returns the accepted times to keep, whether the request is allowed, how many are left, and the seconds to wait. A
    request that comes late counts the accepted ones on both sides of it, so no window ever holds more than the limit;
    decisions already given stay.
    """
    near = [t for t in accepted if abs(now - t) < window]
    allowed = len(near) < limit
    if allowed:
        near, accepted = sorted([*near, now]), sorted([*accepted, now])
    wait = -(-(window - (now - near[0])) // 1_000_000) if near else 0
    newest = max([now, *accepted])
    return [t for t in accepted if newest - t < window], allowed, max(0, limit - len(near)), wait


class RateLimiter(StatefulProcessor):
    """State per user: the accepted times of the last window, at most limit of them, dropped when the watermark has
    passed the last one by a window."""

    def __init__(self, limit, window_us):
        self.limit, self.window_us = limit, window_us

    def init(self, handle):
        self.handle = handle
        state = T.StructType([T.StructField("accepted", T.ArrayType(T.LongType()))])
        self.state = handle.getValueState("accepted", state)

    def handleInputRows(self, key, rows, timerValues):
        accepted = list(self.state.get()[0]) if self.state.exists() else []
        # decisions need time order: two numbers per request of one user and trigger; the source's limit per trigger
        # (maxFilesPerTrigger and the like) bounds them
        batch = pd.concat([r[["ts_us", "event_id"]] for r in rows]).sort_values(["ts_us", "event_id"])
        watermark = timerValues.getCurrentWatermarkInMs()
        if watermark > 0:
            batch = batch[batch["ts_us"] >= watermark * 1000]
        out = []
        for now, event_id in zip(batch["ts_us"].tolist(), batch["event_id"].tolist()):
            accepted, allowed, remaining, wait = decide(accepted, now, self.limit, self.window_us)
            out.append((key[0], event_id, now, allowed, remaining, wait))
        self.state.update((accepted,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if accepted:
            self.handle.registerTimer((accepted[-1] + self.window_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts_us", "allowed", "remaining", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame([], columns=["user_id", "event_id", "ts_us", "allowed", "remaining", "retry_after"])

    def close(self):
        pass


def stream_rate_limit(
    requests: DataFrame, limit: int = 20, window_seconds: int = 60, late_seconds: int = 3600
) -> DataFrame:
    """Decisions for a stream of (user_id, event_id, ts).

    Within a trigger requests are decided in order of time. A request up to late_seconds behind the newest one seen is
    decided when it comes (see decide); an older one is left out, as its window may have been forgotten.
    """
    shaped = requests.select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("ts").cast("timestamp").alias("ts")
    ).withWatermark("ts", f"{late_seconds} seconds")
    return shaped.groupBy("user_id").transformWithStateInPandas(
        RateLimiter(limit, window_seconds * 1_000_000), LIMIT_SCHEMA, "Append", "EventTime"
    )


class SessionCounter(StatefulProcessor):
    """State per session: number of messages, highest turn and latest time. Texts take no part.

    Messages count in the order in which they come: triggers one after the other, within a trigger Arrow batch by batch, in a
    batch by turn. So a task holds one batch, however many messages a session has in a trigger; last_turn is the highest so
    far. With a gap the state goes when the watermark has passed the latest message by it.
    """

    def __init__(self, ttl_ms, gap_us=None):
        self.ttl_ms, self.gap_us = ttl_ms, gap_us

    def init(self, handle):
        self.handle = handle
        fields = [T.StructField(name, T.LongType()) for name in ("n", "updated", "newest")]
        self.state = handle.getValueState("session", T.StructType(fields), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        n, updated, newest = self.state.get() if self.state.exists() else (0, -1, None)
        for frame in rows:
            turns = frame["turn"].sort_values().tolist()
            if not turns:
                continue
            counts = list(range(n + 1, n + 1 + len(turns)))
            highest = []
            for turn in turns:
                updated = max(updated, turn)
                highest.append(updated)
            n = counts[-1]
            if self.gap_us is not None:
                newest = max([int(frame["ts_us"].max())] + ([newest] if newest is not None else []))
            yield pd.DataFrame({"conv_id": [key[0]] * len(turns), "turn": turns, "message_count": counts, "last_turn": highest})
        self.state.update((n, updated, newest))
        if self.gap_us is not None and newest is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((newest + self.gap_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame([], columns=["conv_id", "turn", "message_count", "last_turn"])

    def close(self):
        pass


SESSION_SCHEMA = "conv_id long, turn long, message_count long, last_turn long"


def stream_session_state(messages: DataFrame, ttl_hours: int | None = None) -> DataFrame:
    """Running message count for a stream of (conv_id, turn); the messages themselves are appended by a plain stream.

    ttl_hours drops the state of silent sessions by the clock; Spark then needs a trigger that keeps running. Without it
    state stays: use `stream_sessions` where messages have times.
    """
    return (
        messages.select("conv_id", "turn")
        .groupBy("conv_id")
        .transformWithStateInPandas(
            SessionCounter(ttl_hours * 3_600_000 if ttl_hours else None),
            SESSION_SCHEMA,
            "Append",
            "ProcessingTime" if ttl_hours else "None",
        )
    )


def stream_sessions(messages: DataFrame, gap_seconds: int = 1800, late_seconds: int = 600) -> DataFrame:
    """The same for a stream of (conv_id, turn, ts) by event time.

    Messages may come late_seconds behind the newest one seen; older ones are left out. A session that was silent for
    gap_seconds of event time ends, and its state goes; a message after that begins a session of the same name anew.
    """
    timed = messages.select(
        "conv_id", "turn", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    ).withWatermark("ts", f"{late_seconds} seconds")
    return timed.where(F.col("conv_id").isNotNull()).groupBy("conv_id").transformWithStateInPandas(
        SessionCounter(None, gap_seconds * 1_000_000), SESSION_SCHEMA, "Append", "EventTime"
    )
