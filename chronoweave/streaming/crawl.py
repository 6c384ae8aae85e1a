"""The states of pages that workers claim: leases that end, batches that are released, results that come in part.

A page is Pending, Processing, Completed, Failed or Skipped. A claim takes a Pending page for a batch; done, failed and
skipped end the claim of their own batch only, so what a batch tells too late counts for nothing; a release gives back
what its batch still holds, and results that came before it stay. A claim that is older than the lease is given back by itself,
at the moment the lease ends. An ended page stays as it is.

The machine is one step in Python; a batch replays a log with it, page by page in order, and a stream keeps it as state
with a timer for each open claim.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENDING, PROCESSING = "Pending", "Processing"
ENDS = {"done": "Completed", "failed": "Failed", "skipped": "Skipped"}
OUT = "page long, status string, batch long, at long, why string"


class Page:
    """One page's state; times are in microseconds."""

    def __init__(self, lease: int, status: str = PENDING, batch: int | None = None, since: int | None = None):
        self.lease, self.status, self.batch, self.since = lease, status, batch, since

    def expire(self, now: int) -> list[tuple]:
        """Gives back a claim whose lease ended before now."""
        if self.status != PROCESSING or now <= self.since + self.lease:
            return []
        self.status, at = PENDING, self.since + self.lease
        return [(PENDING, self.batch, at, "stale")]

    def step(self, kind: str, batch: int, at: int) -> list[tuple]:
        """The changes (status, batch, when, why) that an event makes."""
        out = self.expire(at)
        if kind == "claim" and self.status == PENDING:
            self.status, self.batch, self.since = PROCESSING, batch, at
        elif self.status == PROCESSING and self.batch == batch and kind in ENDS:
            self.status = ENDS[kind]
        elif self.status == PROCESSING and self.batch == batch and kind == "release":
            self.status = PENDING
        else:
            return out
        return [*out, (self.status, batch, at, kind)]


def for_pages(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events of a whole batch (page is null) as one for each of its pages; members: batch, page."""
    whole = events.where("page IS NULL").drop("page").join(members.select("batch", "page").distinct(), "batch")
    return events.where("page IS NOT NULL").unionByName(whole.select(*events.columns))


def _rows(events: DataFrame) -> DataFrame:
    fine = events.where("page IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL AND batch IS NOT NULL")
    return fine.select(F.col("page").cast("long").alias("page"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("event").cast("long").alias("event"), "kind", F.col("batch").cast("long").alias("batch"))


def replay(events: DataFrame, lease_minutes: float = 10.0) -> DataFrame:
    """All changes of a log (page, at, event: its number, kind, batch), in each page by at, then event. Pages' rows come
    sorted, and one is walked at a time, so a task holds one batch of rows, however many events a page has. Leases end
    by the page's own events; ``final`` ends them by a clock."""
    lease = int(lease_minutes * 60_000_000)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, page = None, None
        for f in frames:
            out = []
            for id_, at, kind, batch in zip(f["page"].tolist(), f["at"].tolist(), f["kind"].tolist(), f["batch"].tolist(), strict=True):
                if id_ != own:
                    own, page = id_, Page(lease)
                out += [(id_, *change) for change in page.step(kind, batch, at)]
            yield pd.DataFrame(out, columns=["page", "status", "batch", "at", "why"])

    return _rows(events).repartition("page").sortWithinPartitions("page", "at", "event").mapInPandas(run, OUT)


def final(changes: DataFrame, now, lease_minutes: float = 10.0) -> DataFrame:
    """page, status, batch: each page's last state; open claims older than the lease at ``now`` are given back."""
    lease = int(lease_minutes * 60_000_000)
    # of the changes at one moment a lease's end comes first, and a claim after it
    last = changes.groupBy("page").agg(F.max_by(F.struct("status", "batch", "at"), F.struct("at", (F.col("why") != "stale").cast("int"), (F.col("status") != PROCESSING).cast("int"))).alias("x"))
    stale = (F.col("x.status") == PROCESSING) & (F.unix_micros(now.cast("timestamp")) > F.col("x.at") + lease)
    return last.select("page", F.when(stale, PENDING).otherwise(F.col("x.status")).alias("status"), F.col("x.batch").alias("batch"))


def stream(events: DataFrame, lease_minutes: float = 10.0, late: str = "1 minute") -> DataFrame:
    """The same changes over a stream of events, and the end of leases as the watermark passes them. Needs the RocksDB
    state store. Events of a page that come together are taken in order; one that comes late is taken as it comes."""
    from pyspark.sql.streaming import StatefulProcessor

    lease = int(lease_minutes * 60_000_000)
    columns = ["page", "status", "batch", "at", "why"]

    class Machine(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("page", "status string, batch long, since long, timer long")

        def _load(self):
            held = self.state.get()
            return (Page(lease, *held[:3]), held[3]) if held else (Page(lease), None)

        def _keep(self, page, timer):
            """A timer for the open claim, and none else."""
            want = (page.since + lease) // 1000 + 1 if page.status == PROCESSING else None
            if timer is not None and timer != want:
                self.handle.deleteTimer(timer)
            if want is not None and timer != want:
                self.handle.registerTimer(want)
            self.state.update((page.status, page.batch, page.since, want))

        def handleInputRows(self, key, rows, timerValues):
            page, timer = self._load()
            f = pd.concat(list(rows)).sort_values(["at", "event"])
            out = [(key[0], *c) for at, kind, batch in zip(f["at"].tolist(), f["kind"].tolist(), f["batch"].tolist(), strict=True) for c in page.step(kind, batch, at)]
            self._keep(page, timer)
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            page, _ = self._load()
            out = [(key[0], *c) for c in page.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)]
            self.state.update((page.status, page.batch, page.since, None))
            yield pd.DataFrame(out, columns=columns)

        def close(self):
            pass

    clocked = events.withColumn("clock", F.col("at").cast("timestamp")).withWatermark("clock", late)
    fine = clocked.where("page IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL AND batch IS NOT NULL")
    rows = fine.select(F.col("page").cast("long").alias("page"), "clock", F.unix_micros("clock").alias("at"), F.col("event").cast("long").alias("event"), "kind", F.col("batch").cast("long").alias("batch"))
    return rows.groupBy("page").transformWithStateInPandas(Machine(), OUT, "Append", "EventTime")
