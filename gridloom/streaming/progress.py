"""Job progress as streams: the state of jobs, the generation guard, limits, deduplicated queueing, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.session import ship

#: The states a job can be in, and those that end it.
TERMINAL = ("succeeded", "failed")
IN_FLIGHT = ("queued", "started", "scheduled", "deferred")
INFLIGHT_MOST = 3
EVENT = "job_id string, event_id long, generation long, status string, stage string, ts timestamp"
STATE = "job_id string, event_id long, generation long, status string, stage string, accepted boolean"


def accepts(kept: tuple | None, generation: int, status: str) -> bool:
    """Whether an event may write over the kept (generation, status): no older status, no failure of another generation, none after success."""
    if kept is None:
        return True
    if status == "failed":
        return generation == kept[0] and kept[1] != "succeeded"
    return generation >= kept[0]


def job_states(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A stream of events as a stream of decisions: each event with whether it was accepted, by state of its job."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get if state.exists else None
        for pdf in batches:
            rows = []
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                ok = accepts(kept, r.generation, r.status)
                if ok:
                    kept = (int(r.generation), r.status)
                rows.append((key[0], r.event_id, r.generation, r.status, r.stage, ok))
            yield pd.DataFrame(rows, columns=["job_id", "event_id", "generation", "status", "stage", "accepted"])
        if kept is not None:
            state.update(kept)
            if kept[1] in TERMINAL:
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 600_000)

    rows = events.withWatermark("ts", watermark)
    return rows.groupBy("job_id").applyInPandasWithState(step, STATE, "generation long, status string", "append", GroupStateTimeout.EventTimeTimeout)


def tail(events: DataFrame, after: int) -> DataFrame:
    """Events after the last one seen; a checkpointed query resumes by its own offsets."""
    return events.where(F.col("event_id") > after)


def queued_once(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """One queueing of a job in a session while it is in flight."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "job_id"])


def windowed(events: DataFrame, length: str = "5 minutes", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Events by tumbling (or sliding) window and status; late ones are dropped after the watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", watermark).groupBy(w.alias("w"), "status").agg(F.count("*").alias("n"))


def guarded(events: DataFrame) -> DataFrame:
    """Batch twin of the guard for status events: those of a generation not under any earlier one of their job."""
    before = Window.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("generation").over(before)
    return events.withColumn("__top", top).where(F.col("__top").isNull() | (F.col("generation") >= F.col("__top"))).drop("__top")


def inflight(events: DataFrame, most: int = INFLIGHT_MOST) -> DataFrame:
    """Jobs in flight of each session, and whether it may queue no more."""
    n = F.count_if(F.col("status").isin(*IN_FLIGHT))
    return events.groupBy("session_id").agg(n.alias("inflight"), (n >= most).alias("full_"))
