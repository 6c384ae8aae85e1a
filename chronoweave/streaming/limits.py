"""A sliding-window rate limit: a call passes if fewer than ``calls`` passed in the last ``seconds``.

Rejected calls aren't recorded, so that whether a call passes depends on those that passed before, in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "event_id long, user_id long, allowed boolean, retry_after double"


class Window:
    """The passed calls of one client, times in seconds. A call exactly ``seconds`` old still counts; a limit of 0 or
    less is none."""

    def __init__(self, calls: int, seconds: float, times=()):
        self.calls, self.seconds, self.times = calls, seconds, deque(times)

    def call(self, at: float) -> tuple[bool, float]:
        """Whether a call passes, and else after how many seconds one may."""
        if self.calls <= 0:
            return True, 0.0
        while self.times and self.times[0] < at - self.seconds:
            self.times.popleft()
        if len(self.times) >= self.calls:
            return False, self.times[0] + self.seconds - at
        self.times.append(at)
        return True, 0.0


def sliding(events: DataFrame, calls: int, seconds: float) -> DataFrame:
    """event_id, user_id, allowed, retry_after. Clients' rows come sorted, and one is walked at a time, whatever its
    number of calls: a task holds one batch and the open window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, window = None, Window(calls, seconds)
        for f in frames:
            out = []
            for event, own, at in zip(f["event_id"], f["user_id"], f["at"], strict=True):
                if own != user:
                    user, window = own, Window(calls, seconds)
                out.append((event, own, *window.call(at)))
            yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed", "retry_after"])

    rows = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, OUT)


def sliding_stream(events: DataFrame, calls: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """The same over a stream. Windows are in event time, and so is the end of a client's state: it goes once the
    watermark, ``late`` behind the latest event, is ``seconds`` beyond the client's last passed call."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = Window(calls, seconds, state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = [(event, key[0], *window.call(at)) for event, at in zip(rows["event_id"], rows["at"], strict=True)]
        if window.times:
            state.update((list(window.times),))
            state.setTimeoutTimestamp(max(int((window.times[-1] + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed", "retry_after"])

    rows = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    # a watermark begins at the epoch, and what is not after it counts as late
    clocked = rows.withColumn("clock", F.greatest("ts", F.timestamp_millis(F.lit(1)))).withWatermark("clock", late)
    rows = clocked.select("event_id", "user_id", "clock", (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(run, OUT, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
