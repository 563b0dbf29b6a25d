"""Streaming twins: rate limiting with keyed state, ingestion of new files, hourly request counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.operators.service import accept
from docquarry.operators.versions import insert_new


def limit_stream(requests: DataFrame, limit: int = 5, window_seconds: float = 1.0, late: str = "10 seconds") -> DataFrame:
    """(event_id, user_id, accepted) of a stream of requests (event_id, user_id, ts), in event time within a micro-batch.

    The state of a user is the accepted times of the last window; the watermark ends it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        held = list(state.get[0]) if state.exists else []
        flags, held = accept([t.timestamp() for t in frame["ts"]], limit, window_seconds, held)
        state.update((held,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(frame["ts"].max().timestamp() * 1000)) + int(window_seconds * 1000) + 1)
        yield pd.DataFrame({"event_id": frame["event_id"], "user_id": key[0], "accepted": flags})

    rows = requests.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(
        run, "event_id bigint, user_id bigint, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def ingest_stream(files: DataFrame, known: Callable[[], DataFrame], index: Callable[[DataFrame, int], None], checkpoint: str):
    """Index the files of a stream whose hash is not known yet; ``index`` gets them with the batch number."""
    return files.writeStream.foreachBatch(lambda df, n: index(insert_new(known(), df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, event_type, n): requests by hour of event time."""
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
