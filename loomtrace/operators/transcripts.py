"""Transcript rows folded to the messages that a reader sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.history import merge_tool_events
from loomtrace.sources.jsonl import transcript_turns

# The phases of a tool call, later ones win.
PHASES = ("start", "progress", "end", "error")
#: Where a delivery that was held back because the page already shows the stream comes from.
STREAM_REASON, STREAM_SOURCE = "webui_stream_already_delivered", "websocket"


def fold(rows: DataFrame) -> DataFrame:
    """``session_key, turn_no, first_seq, kind, key, role, text, name, status``: one row per message and per tool call.

    rows: ``session_key, seq, event`` (delta, message, tool, turn_end and others), ``message_id, role, text, tool_call_id,
    phase, name, status``. A message's text is that of its last ``message`` row, else its deltas joined in order; a tool call
    has of each field the value of its highest phase. Rows of other events show nothing. A message is as long as its deltas:
    the only thing that is gathered.
    """
    turns = transcript_turns(rows)
    key = ["session_key", "turn_no"]
    final = F.max(F.when(F.col("event") == "message", F.struct("seq", "text")))["text"]
    deltas = F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))))
    said = turns.filter("event in ('delta', 'message') and message_id is not null").groupBy(*key, "message_id")
    messages = said.agg(F.min("seq").alias("first_seq"), F.min("role").alias("role"), final.alias("final"), deltas.alias("deltas")).select(
        *key, "first_seq", F.lit("text").alias("kind"), F.col("message_id").alias("key"), "role", F.coalesce("final", F.array_join(F.transform("deltas", lambda d: d["text"]), "")).alias("text"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("status"),
    )
    tools = turns.filter("event = 'tool' and tool_call_id is not null")
    rank = F.array_position(F.array(*map(F.lit, PHASES)), F.coalesce("phase", F.lit("")))
    merged = merge_tool_events(tools, [*key, "tool_call_id"], rank, "seq", ["name", "status", "text"])
    first = tools.groupBy(*key, "tool_call_id").agg(F.min("seq").alias("first_seq"))
    calls = merged.join(first, [*key, "tool_call_id"]).select(*key, "first_seq", F.lit("tool").alias("kind"), F.col("tool_call_id").alias("key"), F.lit("tool").alias("role"), "text", "name", "status")
    return messages.unionByName(calls)


def in_turn_order(messages: DataFrame) -> DataFrame:
    """Folded messages of a session in the order they are shown."""
    return messages.orderBy("session_key", "turn_no", "first_seq", "kind", "key")


def unexpected_suppressions(events: DataFrame) -> DataFrame:
    """``trace_id, n``: deliveries held back for no known reason.

    With a reason, the known one is expected; without, a delivery of a run in a trace that came over the page's own stream.
    """
    held = events.filter("event_type = 'delivery_finished' and status = 'suppressed' and trace_id is not null")
    stream = F.max((F.col("source_type") == STREAM_SOURCE) | F.coalesce(F.col("session_key").startswith(f"{STREAM_SOURCE}:"), F.lit(False)))
    own = events.groupBy("trace_id").agg(F.coalesce(stream, F.lit(False)).alias("streamed"))
    expected = F.when(F.col("suppression_reason").isNotNull(), F.col("suppression_reason") == STREAM_REASON).otherwise(F.col("run_id").isNotNull() & F.col("streamed"))
    return held.join(own, "trace_id").filter(~expected).groupBy("trace_id").agg(F.count("*").alias("n"))
