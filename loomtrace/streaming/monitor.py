"""The state of a refreshing query: ready, stale or unavailable, from its own progress events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last progress, the rows seen and the last error of every query; register with :meth:`watch`."""

    def __init__(self):
        self.started: dict[str, dt.datetime] = {}
        self.updated: dict[str, dt.datetime] = {}
        self.rows: dict[str, int] = {}
        self.errors: dict[str, str | None] = {}

    def watch(self, spark: SparkSession) -> Progress:
        spark.streams.addListener(self)
        return self

    def onQueryStarted(self, event):  # noqa: N802
        self.started[str(event.id)] = dt.datetime.now(dt.UTC)
        self.errors.pop(str(event.id), None)

    def onQueryProgress(self, event):  # noqa: N802
        key = str(event.progress.id)
        self.updated[key] = dt.datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00"))
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.errors[str(event.id)] = event.exception

    def state(self, query_id: str, now: dt.datetime, lag: dt.timedelta = dt.timedelta(minutes=5)) -> str:
        """``unavailable`` before the first batch and after an error without one, ``stale`` after an error or a longer lag, else ``ready``."""
        if query_id not in self.updated:
            return "unavailable"
        return "stale" if self.errors.get(query_id) or now - self.updated[query_id] > lag else "ready"
