"""The event log as the other operators read it: one row per event, names in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns whose letter case and outer blanks vary.
NAMED = ("event_type", "status", "model", "tool_name", "source_type", "stop_reason")


def clean(name: str) -> Column:
    """A name column trimmed and in lower case; empty becomes null."""
    return F.nullif(F.lower(F.trim(F.col(name))), F.lit("")).alias(name)


def unique_events(audit_events: DataFrame, *columns: str) -> DataFrame:
    """``event_id`` and ``columns``, one row per event: deliveries agree but for ``recorded_at`` (idempotent insert).

    Deliveries that disagree in one of ``columns`` would stay apart. The distinct combines map-side before it shuffles.
    """
    return audit_events.select("event_id", *[clean(c) if c in NAMED else F.col(c) for c in columns if c != "event_id"]).distinct()


#: The order of events: time, then the place in the log.
ORDER = ("occurred_at", "process_instance_id", "durability_epoch", "segment_id", "segment_sequence", "event_id")
