"""Structured Streaming over turns, recall events and jobs.

* ``captured_turns`` drops a turn that is delivered again within the watermark;
* ``recalls`` ranks each micro-batch of queries against a snapshot of the records;
* ``write_jobs`` hands each micro-batch to a sink that is keyed by batch, so a replay changes nothing; ``in_scope_order``
  numbers a batch's requests within their owner, so that a sink can apply them one after another;
* ``recent_by_scope`` keeps a bounded ring of each owner's last events in state, which ends after ``idle`` of quiet;
* ``last_of_all`` is the ring over all owners, kept as a small table;
* ``windowed_counts`` is an extension: tumbling or sliding counts with late data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.operators import retrieval


def captured_turns(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (session_id, turn_id) once within ``delay`` of event time, with its idempotency key."""
    keyed = turns.withColumn("capture_key", F.concat_ws(":", "session_id", F.lit("turn"), F.col("turn_id").cast("string")))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["capture_key"])


def recalls(queries: DataFrame, records: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, as_of: Column, config: retrieval.SearchConfig = retrieval.SearchConfig()) -> StreamingQuery:
    """Search every micro-batch of ``queries`` (columns of ``retrieval.search``) in the snapshot that ``records()`` reads, and sink the hits."""

    def one(batch: DataFrame, batch_id: int) -> None:
        sink(retrieval.search(records(), batch, as_of, config), batch_id)

    return write_jobs(queries, one, checkpoint)


def in_scope_order(batch: DataFrame, at: str = "ts", tie: str = "capture_key") -> DataFrame:
    """``batch`` with turn_in_scope: the place of a request among its owner's in the batch, by time and key."""
    order = Window.partitionBy(retrieval.scope_key()).orderBy(at, tie)
    return batch.withColumn("turn_in_scope", F.row_number().over(order))


def write_jobs(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``sink(batch, batch_id)`` on each micro-batch, once per batch id even after a restart."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recent_by_scope(events: DataFrame, most: int = 20, idle: str = "30 days") -> DataFrame:
    """(scope, event_id, ts_us, place): after each batch the last ``most`` events of the scopes it touched; ``events`` carry a watermark on ts."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            held += list(zip(frame["ts"].astype("int64") // (1000 if frame["ts"].dtype == "datetime64[ns]" else 1), frame["event_id"].astype("int64")))
            held = sorted(set(held), reverse=True)[:most]
        state.update(([h[0] for h in held], [h[1] for h in held]))
        latest = held[0][0] // 1000
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + quiet_ms)
        yield pd.DataFrame(
            {
                "scope": [key[0]] * len(held),
                "event_id": [h[1] for h in held],
                "ts_us": [h[0] for h in held],
                "place": range(1, len(held) + 1),
            }
        )

    quiet_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.select("scope", "event_id", "ts")
    return rows.groupBy("scope").applyInPandasWithState(keep, "scope string, event_id long, ts_us long, place int", "ts array<long>, ids array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def last_of_all(held: DataFrame, batch: DataFrame, most: int = 200) -> DataFrame:
    """The last ``most`` (scope, event_id, ts) of ``held`` and ``batch`` together: the ring over all owners after a micro-batch."""
    cols = ["scope", "event_id", "ts"]
    return held.select(*cols).unionByName(batch.select(*cols)).distinct().orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def windowed_counts(events: DataFrame, keys: list[str], width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(window_start, *keys, n): counts in event-time windows; rows later than ``delay`` are dropped by the watermark."""
    window: Column = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n")
