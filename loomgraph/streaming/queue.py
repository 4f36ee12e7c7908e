"""Structured Streaming forms of the event queue: folding, draining, timeouts, retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import polls

#: How often a job's stream is triggered.
CADENCES = {"scan": "5 minutes", "embedding": "120 seconds", "status": "80 seconds", "index clean-up": "60 minutes", "events": "1 second"}

_OUT = "workspace string, path string, id long, event_type string, action string"
_STATE = "id long, event_type string, busy boolean"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Every event of a path either overwrites the latest one, or, while that is in progress, is a new one."""
    known = state.get if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
    for row in rows.itertuples():
        busy = row.embedding_status in (2, 3) or row.codegraph_status == 2
        if known is None or known[2]:
            known, action = (int(row.id), row.event_type, bool(busy)), "create"
        else:
            known, action = (known[0], row.event_type, bool(busy)), "update"
        out.append((key[0], key[1], known[0], row.event_type, action))
    state.update(known)
    yield pd.DataFrame(out, columns=["workspace", "path", "id", "event_type", "action"])


def upserts(stream: DataFrame) -> DataFrame:
    """One action, create or update, for each event of a stream with the columns of the queue."""
    return stream.groupBy("workspace", "path").applyInPandasWithState(_fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (status,) = state.get
        state.remove()
        yield pd.DataFrame([(key[0], status)], columns=["id", "embedding_status"])
        return
    last = pd.concat(list(batches)).sort_values("updated_at").iloc[-1]
    if last["embedding_status"] in (2, 3):
        state.update((4 if last["embedding_status"] == 2 else 5,))
        state.setTimeoutDuration(180_000)
    elif state.exists:
        state.remove()
    yield pd.DataFrame([], columns=["id", "embedding_status"])


def timeouts(stream: DataFrame) -> DataFrame:
    """(id, failed status) of events that stay three minutes of processing time uploading (4) or building (5)."""
    return stream.groupBy("id").applyInPandasWithState(_watch, "id long, embedding_status int", "status int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def recent(stream: DataFrame, hours: int = 48) -> DataFrame:
    """Each event id once within the time that events are kept."""
    timed = stream.withColumn("seen_at", F.col("created_at").cast("timestamp")).withWatermark("seen_at", f"{hours} hours")
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("seen_at")


def every(stream: DataFrame, job: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A query that gives each micro-batch to ``handle`` at the cadence of a job."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=CADENCES[job]).start()


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, per_type: int = 10) -> StreamingQuery:
    """Each micro-batch's open events in polls of ``per_type`` of each type, the oldest first, to ``handle``; ends when the input is read.

    A batch is polled until none of its events is left: poll n has the n-th ``per_type`` of each type.
    """

    def each(batch: DataFrame, number: int) -> None:
        waiting = polls(batch, per_type).persist()
        try:
            for poll in range((waiting.agg(F.max("poll")).first()[0] or 0) + 1 if not waiting.isEmpty() else 0):
                handle(waiting.where(F.col("poll") == poll).drop("poll").orderBy("priority", "rn"), number)
        finally:
            waiting.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
