"""Sessions of users: events no further apart than a gap, in batch and as a stream with state and event-time timers.

A session is user_id, begin, finish, events, kinds (its different event types, sorted). Events without user, time or type are left out; repeated rows count as often as they come.
The stream gives a session out once the watermark has passed its gap, so that no event in time can still belong to it; with in-time events it
gives the batch form's sessions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP_MINUTES = 30
_OUT = "user_id long, begin timestamp, finish timestamp, events long, kinds string"
_STATE = "begins array<long>, finishes array<long>, counts array<long>, kinds array<string>"


def _complete(events: DataFrame) -> DataFrame:
    return events.where("user_id is not null and ts is not null and event_type is not null").select("user_id", "ts", "event_type")


def sessions(events: DataFrame, minutes: int = GAP_MINUTES) -> DataFrame:
    """user_id, begin, finish, events, kinds of every session."""
    w = Window.partitionBy("user_id").orderBy("ts")
    before = F.lag("ts").over(w)
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    new = before.isNull() | (micros(F.col("ts")) - micros(before) > minutes * 60_000_000)
    numbered = _complete(events).withColumn("new", new.cast("int")).withColumn("n", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return numbered.groupBy("user_id", "n").agg(F.min("ts").alias("begin"), F.max("ts").alias("finish"), F.count("*").alias("events"), kinds.alias("kinds")).drop("n")


def _step(minutes: int):
    gap = minutes * 60_000_000  # microseconds, as all times here

    def step(key, frames, state: GroupState):
        open_ = [(b, f, n, set(k.split(","))) for b, f, n, k in zip(*state.get)] if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                times = frame["ts"].astype("datetime64[us]").astype("int64")
                open_ += [(t, t, 1, {k}) for t, k in zip(times.tolist(), frame["event_type"])]
        merged: list[tuple] = []
        for b, f, n, kinds in sorted(open_, key=lambda s: s[:2]):
            if merged and b - merged[-1][1] <= gap:
                last = merged[-1]
                merged[-1] = (last[0], max(last[1], f), last[2] + n, last[3] | kinds)
            else:
                merged.append((b, f, n, kinds))
        watermark = state.getCurrentWatermarkMs() * 1000
        done, left = [s for s in merged if s[1] + gap < watermark], [s for s in merged if s[1] + gap >= watermark]
        if left:
            state.update(([s[0] for s in left], [s[1] for s in left], [s[2] for s in left], [",".join(sorted(s[3])) for s in left]))
            state.setTimeoutTimestamp(max(min(s[1] for s in left) + gap, watermark) // 1000 + 1)
        elif state.exists:
            state.remove()
        times = [pd.to_datetime([s[i] for s in done], unit="us").astype("datetime64[ns]") for i in (0, 1)]
        yield pd.DataFrame({"user_id": [key[0]] * len(done), "begin": times[0], "finish": times[1], "events": [s[2] for s in done], "kinds": [",".join(sorted(s[3])) for s in done]})

    return step


def session_stream(events: DataFrame, minutes: int = GAP_MINUTES, delay: str = "10 minutes") -> DataFrame:
    """The sessions of a streaming table of events, each once, when no event less late than `delay` can still belong to it."""
    kept = _complete(events).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return kept.groupBy("user_id").applyInPandasWithState(_step(minutes), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
