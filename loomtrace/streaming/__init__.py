"""Structured Streaming: ingest with exactly-once appends, session debounce, windows, first terminal state of a task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

# The states in which a task has ended.
TERMINAL = ("succeeded", "failed", "cancelled", "lost")


def event_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 100, kind: str = "json") -> DataFrame:
    """New files below ``path`` as a stream; at most ``max_files`` a batch, which bounds what one epoch holds."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").format(kind).load(path)


def ingest(stream: DataFrame, table: str, checkpoint: str, key: str = "event_id", late: str = "7 days", at: str = "occurred_at") -> StreamingQuery:
    """Append each event once to a Parquet table: repeats within ``late`` are dropped by state, the file sink commits epochs.

    Readers of the table see committed epochs only (the sink's own log). Runs over what is there, then ends.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark([key]).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced_sessions(stream: DataFrame, idle: str = "45 minutes", late: str = "1 hour") -> DataFrame:
    """One row per session and pause, emitted when the watermark has passed the pause: ``session_key, first_at, due_at, n``."""
    timed = stream.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", late)
    grouped = timed.filter("session_key is not null").groupBy(F.session_window("occurred_at", idle).alias("w"), "session_key").agg(F.count("*").alias("n"))
    return grouped.select("session_key", F.col("w.start").alias("first_at"), F.col("w.end").alias("due_at"), "n")


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Events per type and window; rows later than the watermark are not counted (no counterpart in the original system)."""
    timed = stream.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", late)
    return timed.groupBy(F.window("occurred_at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("from_at"), "event_type", "n")


def first_terminal(stream: DataFrame, late: str = "1 day", expires_ms: int = 86_400_000) -> DataFrame:
    """``task_id, status, at`` once per task: its first terminal state; later results of the task are ignored.

    State is one flag a task; it ends when the watermark is ``expires_ms`` beyond the last row of the task.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = state.exists and state.get[0]
        rows = pd.concat(list(batches))
        ended = rows[rows["status"].isin(TERMINAL)].sort_values(["at", "status"])
        if not done and len(ended):
            yield pd.DataFrame({"task_id": [key[0]], "status": [ended["status"].iloc[0]], "at": [ended["at"].iloc[0]]})
            done = True
        state.update((bool(done),))
        heard = int(rows["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(heard, state.getCurrentWatermarkMs()) + expires_ms)

    return stream.withWatermark("at", late).groupBy("task_id").applyInPandasWithState(step, "task_id string, status string, at timestamp", "done boolean", "append", "EventTimeTimeout")


def first_terminal_batch(rows: DataFrame) -> DataFrame:
    """The same over a finished table."""
    ended = rows.filter(F.col("status").isin(*TERMINAL))
    return ended.groupBy("task_id").agg(F.min(F.struct("at", "status")).alias("f")).select("task_id", "f.status", "f.at")


def refresh_into(stream: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    """Call ``merge(batch, epoch)`` for every micro-batch; the checkpoint keeps an epoch from being merged twice in order."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
