"""Queries of the classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import classify as C
from loomtrace.operators.log import unique_events
from loomtrace.plans.graph_queries import _MORE
from loomtrace.plans.log_queries import EVENTS, events
from loomtrace.sources.tables import load


def step_evidence(spark, d):
    return C.step_evidence(events(spark, d, "event_type", "status", "tool_name", "trace_id", "occurred_at", "segment_sequence"))


def primary_sources(spark, d):
    return C.primary_source(events(spark, d, "source_type", "session_key", "occurred_at"), "session_key")


def run_lanes(spark, d):
    started = unique_events(load(spark, d, "audit_events"), "event_type", "run_id", "parent_run_id", "resumed_from_run_id", "occurred_at").filter("event_type = 'run_started'")
    return C.run_lanes(started)


def outcome_counts(spark, d):
    rows = events(spark, d, "event_type", "status").filter("event_type like '%_finished'")
    return rows.groupBy("event_type", C.outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


def capacity(spark, d):
    tables = {name: load(spark, d, name) for name in ("documents", "tombstones", "node_relations")}
    return C.capacity(tables, 100, {"documents": 5_000}, "documents")


QUERIES = {f.__name__: f for f in (step_evidence, primary_sources, run_lanes, outcome_counts, capacity)}


def _case(column: str, table: dict, other: str) -> str:
    whens = " ".join("WHEN {} IN ({}) THEN '{}'".format(column, ", ".join(f"'{w}'" for w in words), name) for name, words in table.items())
    return f"CASE {whens} ELSE '{other}' END"


_list = lambda names: ", ".join(f"'{n}'" for n in names)
_EFFECT = _case("tool_name", C.SIDE_EFFECTS, "none")
SQL = {
    "step_evidence": f"""WITH {EVENTS} SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY occurred_at, segment_sequence, event_id) - 1 AS step, event_id,
  {_case("tool_name", {v: (k,) for k, v in C.OPERATIONS.items()}, "unknown")} AS operation, {_EFFECT} AS side_effect,
  CASE WHEN {_EFFECT} IN ('process_execution', 'external_message', 'scheduler', 'subagent') THEN 'R3' WHEN {_EFFECT} = 'filesystem_write' THEN 'R2' WHEN tool_name IN ({_list(C.EXTERNAL_READS)}) THEN 'R1' WHEN tool_name IN ({_list(C.READS)}) THEN 'R0' ELSE 'R3' END AS risk,
  {_case("status", C.OUTCOMES, "unknown")} AS outcome FROM e WHERE event_type = 'tool_finished' AND trace_id IS NOT NULL""",
    "primary_sources": f"""WITH {EVENTS} SELECT session_key, first(source_type ORDER BY CASE WHEN source_type IN ('user', 'websocket') THEN 0 WHEN source_type IN ('system', 'delivery') THEN 2 ELSE 1 END, occurred_at, event_id) AS primary_source
  FROM e WHERE source_type IS NOT NULL AND session_key IS NOT NULL GROUP BY 1""",
    "run_lanes": f"""WITH {_MORE}, s AS (SELECT DISTINCT event_id, run_id, parent_run_id, resumed_from_run_id, occurred_at FROM e WHERE event_type = 'run_started')
  SELECT run_id, CASE WHEN parent_run_id IS NOT NULL THEN 'child_agent' WHEN resumed_from_run_id IS NOT NULL THEN 'continuation' ELSE 'main' END AS kind,
    CASE WHEN parent_run_id IS NULL THEN 'center' WHEN row_number() OVER (PARTITION BY parent_run_id ORDER BY occurred_at, run_id) % 2 = 1 THEN 'left' ELSE 'right' END AS side FROM s""",
    "outcome_counts": f"WITH {EVENTS} SELECT event_type, {_case('status', C.OUTCOMES, 'unknown')} AS outcome, count(*) AS n FROM e WHERE event_type LIKE '%_finished' GROUP BY 1, 2",
    "capacity": """SELECT *, (documents - 100) / 100.0::DOUBLE AS growth, documents >= 5000 AS capacity_exceeded FROM (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM tombstones) AS tombstones, (SELECT count(*) FROM node_relations) AS node_relations)""",
}
