"""Queries over the causal graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import evidence as V
from loomtrace.operators import graph as G
from loomtrace.operators import traces as T
from loomtrace.operators.log import unique_events
from loomtrace.plans import log_queries as L
from loomtrace.plans.log_queries import EVENTS
from loomtrace.sources.tables import load

_ID = (
    "event_type", "status", "occurred_at", "run_id", "trace_id", "turn_id", "iteration", "model_call_id", "attempt_id", "tool_call_id", "checkpoint_id", "goal_id", "delivery_id", "elapsed_ms",
    "parent_run_id", "resumed_from_run_id", "caused_by_event_id", "process_instance_id",
)


def _events(spark, d):
    return unique_events(load(spark, d, "audit_events"), *_ID)


def graph_nodes(spark, d):
    return G.run_nodes(_events(spark, d))


def graph_trace_nodes(spark, d):
    return G.trace_nodes(_events(spark, d))


def graph_edges(spark, d):
    return G.edges(_events(spark, d))


def graph_membership(spark, d):
    owned = G.owned_events(_events(spark, d)).filter("node_type is not null")
    return owned.groupBy("node_type").agg(F.count("*").alias("n_events"), F.count_distinct("event_id").alias("n_distinct"))


def orphan_spans(spark, d):
    events = _events(spark, d)
    dead = events.filter("event_type = 'process_instance_closed'").select("process_instance_id")
    return G.orphan_marks(events, dead, "1 day", "2026-06-01 00:00:00").groupBy("span", "mark").agg(F.count("*").alias("n"))


def graph_returns(spark, d):
    return G.result_returns(_events(spark, d))


def graph_retries(spark, d):
    rows = spark.createDataFrame(RETRIES, "event_id string, event_type string, model_call_id string, attempt_id string, t int").withColumn("occurred_at", F.timestamp_seconds(F.col("t")))
    return G.retries_of(rows)


def graph_causes(spark, d):
    return G.node_causes(_events(spark, d)).groupBy("resolution").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"))


def graph_chains(spark, d):
    return G.collapse_chains(_events(spark, d))


def graph_anomaly_starts(spark, d):
    rows = unique_events(load(spark, d, "audit_events"), *_ID, "segment_sequence", "session_key", "source_type")
    return G.anomaly_starts(rows, T.list_traces(rows))


def graph_levels(spark, d):
    """Nodes and edges of the three levels, counted by kind."""
    rows, out = _events(spark, d), None
    for level in ("trace", "run", "trace_full"):
        nodes, edges = G.build(rows, level)
        part = nodes.groupBy(F.lit(level).alias("level"), F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit(level).alias("level"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))
        out = part if out is None else out.unionByName(part)
    return out


def graph_lanes(spark, d):
    return G.lane_orders(_events(spark, d).filter("event_type = 'run_started'"))


#: Subagent tasks, scheduled retries and a spawning run, which the log's columns or rows cannot show.
TASKS = [("subagent_created", "t1", "r1", None), ("subagent_recovered", "t1", None, None), ("subagent_created", "t2", None, "t1"), ("subagent_created", "t3", "r3", "gone"), ("subagent_terminal", None, "r4", None)]
RETRIES = [
    ("e1", "model_attempt_started", "m", "a1", 1), ("e2", "retry_scheduled", "m", None, 2), ("e3", "model_attempt_started", "m", "a2", 3), ("e4", "retry_scheduled", "m", None, 4), ("e5", "model_attempt_started", "m", "a3", 5),
    ("e6", "retry_scheduled", "m", None, 6), ("e7", "retry_scheduled", "n", None, 1), ("e8", "model_attempt_started", "n", "b1", 2), ("e9", "retry_scheduled", None, None, 2),
]
SPAWNS = [
    ("e1", "tool_finished", "spawn", "p", None, "c1", 1), ("e2", "run_started", None, "k1", "p", None, 2), ("e3", "tool_finished", "grep", "p", None, "c2", 3), ("e4", "tool_finished", "spawn", "p", None, "c3", 4),
    ("e5", "run_started", None, "k2", "p", None, 5), ("e6", "run_started", None, "k3", "q", None, 6), ("e7", "run_started", None, "k4", "p", None, 3),
]


def graph_tasks(spark, d):
    return G.task_edges(spark.createDataFrame(TASKS, "event_type string, subagent_task_id string, child_run_id string, replaces_task_id string"))


def graph_spawns(spark, d):
    rows = spark.createDataFrame(SPAWNS, "event_id string, event_type string, tool_name string, run_id string, parent_run_id string, tool_call_id string, segment_sequence int")
    rows = rows.withColumn("occurred_at", F.timestamp_seconds(F.col("segment_sequence")))
    return G.spawn_branches(V.spawned_between(rows), rows)


QUERIES = {
    f.__name__: f
    for f in (graph_nodes, graph_trace_nodes, graph_edges, graph_membership, orphan_spans, graph_returns, graph_retries, graph_causes, graph_chains, graph_anomaly_starts, graph_levels, graph_lanes, graph_tasks, graph_spawns)
}

_MORE = EVENTS.replace("parent_run_id,", "parent_run_id, resumed_from_run_id, caused_by_event_id, checkpoint_id, goal_id, delivery_id,", 1)
_list = lambda names: ", ".join(f"'{n}'" for n in names)
_RULES = (
    ("model_attempt", "attempt_id IS NOT NULL", "attempt_id"),
    ("model_call", f"event_type IN ({_list(G.MODEL_CALL)}) AND model_call_id IS NOT NULL", "model_call_id"),
    ("tool_call", f"event_type IN ({_list(G.TOOL_CALL)}) AND tool_call_id IS NOT NULL", "tool_call_id"),
    ("decision", f"event_type IN ({_list(G.DECISIONS)})", "event_id"),
    ("checkpoint", "checkpoint_id IS NOT NULL", "checkpoint_id"),
    ("anomaly", "starts_with(event_type, 'checkpoint_')", "event_id"),
    ("goal", "goal_id IS NOT NULL", "goal_id"),
    ("delivery", "delivery_id IS NOT NULL", "delivery_id"),
    ("turn_result", f"event_type IN ({_list(G.TURN_RESULTS)})", "coalesce(turn_id, run_id)"),
    ("anomaly", "starts_with(event_type, 'orphan_') OR event_type = 'audit_degraded'", "event_id"),
)
_OWNED = f"""{_MORE}, owned AS (SELECT *, CASE {' '.join(f"WHEN {r} THEN '{n}'" for n, r, _ in _RULES)} WHEN event_type IN ({_list(G.LEFT_OUT)}) THEN NULL ELSE 'decision' END AS node_type,
  CASE {' '.join(f"WHEN {r} THEN {k}" for _, r, k in _RULES)} WHEN event_type IN ({_list(G.LEFT_OUT)}) THEN NULL ELSE event_id END AS node_key FROM e WHERE run_id IS NOT NULL)"""
_NODES = f"""{_OWNED}, nodes AS (SELECT run_id, node_type, node_key, count(*) AS n_events, min(occurred_at) AS first_at,
  CASE WHEN node_type IN ('model_call', 'model_attempt', 'tool_call') AND NOT (bool_or(ends_with(event_type, '_started')) AND bool_or(regexp_matches(event_type, '(_finished|_received|_failed)$'))) THEN 'incomplete'
    WHEN bool_or(coalesce(status IN ('failed', 'exhausted', 'error'), false)) THEN 'failed' WHEN bool_or(coalesce(status = 'interrupted', false)) THEN 'interrupted' WHEN bool_or(coalesce(status = 'cancelled', false)) THEN 'cancelled'
    WHEN bool_or(coalesce(status IN ('timeout', 'blocked'), false)) THEN 'warning' ELSE 'succeeded' END AS status,
  greatest(coalesce(max(elapsed_ms), date_diff('millisecond', min(occurred_at), max(occurred_at))), 0) AS elapsed_ms FROM owned WHERE node_type IS NOT NULL GROUP BY 1, 2, 3)"""
_SPANS = (("run", "run_started", "run_finished", "run_id"), ("model_call", "model_request_started", "model_response_received", "model_call_id"), ("tool_call", "tool_started", "tool_finished", "tool_call_id"))

SQL = {
    "graph_nodes": f"WITH {_NODES} SELECT * FROM nodes",
    "graph_trace_nodes": f"""WITH {_MORE} SELECT trace_id, run_id, min(turn_id) AS turn_id, min(occurred_at) AS first_at, count(DISTINCT iteration) AS n_iterations, count(DISTINCT model_call_id) AS n_model_calls,
  count(DISTINCT tool_call_id) AS n_tool_calls, count(*) FILTER (WHERE status IN ({_list(G.ABNORMAL)})) AS n_failed FROM e WHERE trace_id IS NOT NULL AND run_id IS NOT NULL GROUP BY 1, 2""",
    "graph_edges": f"""WITH {_NODES} SELECT DISTINCT 'parent_run' AS edge_type, parent_run_id AS source, run_id AS target FROM e WHERE event_type = 'run_started' AND parent_run_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'resumed_from', resumed_from_run_id, run_id FROM e WHERE event_type = 'run_started' AND resumed_from_run_id IS NOT NULL
  UNION ALL SELECT 'caused_by', caused_by_event_id, event_id FROM e WHERE caused_by_event_id IS NOT NULL
  UNION ALL SELECT 'sequence', source, target FROM (SELECT node_type || ':' || node_key AS source, lead(node_type || ':' || node_key) OVER (PARTITION BY run_id ORDER BY first_at, node_type, node_key) AS target FROM nodes) WHERE target IS NOT NULL
  UNION ALL SELECT 'retry', source, target FROM (SELECT attempt_id AS source, lead(attempt_id) OVER (PARTITION BY model_call_id ORDER BY t, attempt_id) AS target
    FROM (SELECT model_call_id, attempt_id, min(occurred_at) AS t FROM e WHERE event_type = 'model_attempt_started' AND model_call_id IS NOT NULL AND attempt_id IS NOT NULL GROUP BY 1, 2)) WHERE target IS NOT NULL""",
    "graph_membership": f"WITH {_OWNED} SELECT node_type, count(*) AS n_events, count(DISTINCT event_id) AS n_distinct FROM owned WHERE node_type IS NOT NULL GROUP BY 1",
    "orphan_spans": f"""WITH {_MORE}, dead AS (SELECT DISTINCT process_instance_id FROM e WHERE event_type = 'process_instance_closed'),
  owner AS (SELECT process_instance_id, 'detected' AS mark FROM dead UNION ALL SELECT process_instance_id, 'suspected' FROM e WHERE process_instance_id NOT IN (SELECT process_instance_id FROM dead) GROUP BY 1 HAVING max(occurred_at) < TIMESTAMP '2026-05-31'),
  spans AS ({' UNION ALL '.join(f"SELECT DISTINCT '{s}' AS span, {k} AS identity, process_instance_id FROM e WHERE event_type = '{a}' AND {k} IS NOT NULL AND {k} NOT IN (SELECT {k} FROM e WHERE event_type IN ('{b}', 'model_request_failed') AND {k} IS NOT NULL)" for s, a, b, k in _SPANS)})
  SELECT span, mark, count(*) AS n FROM spans JOIN owner USING (process_instance_id) GROUP BY 1, 2""",
}
_NODE = "node_type || ':' || node_key"
_RETURNS = f"""SELECT 'result_return' AS edge_type, coalesce(x.node, 'run:' || r.src) AS source, 'run:' || r.run_id AS target FROM (SELECT DISTINCT resumed_from_run_id AS src, run_id FROM e WHERE event_type = 'run_started' AND resumed_from_run_id IN (SELECT run_id FROM e WHERE event_type = 'run_started')) r
  LEFT JOIN (SELECT run_id, last({_NODE} ORDER BY first_at, {_NODE}) AS node FROM nodes JOIN (SELECT run_id, max(occurred_at) AS done FROM e WHERE event_type = 'run_finished' GROUP BY 1) USING (run_id) WHERE first_at <= done GROUP BY 1) x ON x.run_id = r.src"""
_RETRIES = """SELECT DISTINCT 'retry_of' AS edge_type, 'model_attempt:' || b AS source, 'model_attempt:' || a AS target FROM (SELECT s.event_id, last(t.attempt_id ORDER BY t.at, t.attempt_id) FILTER (WHERE t.at <= s.occurred_at) AS b, first(t.attempt_id ORDER BY t.at, t.attempt_id) FILTER (WHERE t.at > s.occurred_at) AS a
  FROM e s JOIN (SELECT model_call_id, attempt_id, min(occurred_at) AS at FROM e WHERE event_type = 'model_attempt_started' AND attempt_id IS NOT NULL GROUP BY 1, 2) t USING (model_call_id) WHERE s.event_type = 'retry_scheduled' GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL"""
_CAUSES = f"""causes AS (SELECT event_id, source, target, CASE WHEN source IS NULL THEN 'unresolved' WHEN source = target THEN 'same_node' ELSE 'linked' END AS resolution FROM (SELECT DISTINCT event_id, caused_by_event_id AS cause, {_NODE} AS target FROM owned WHERE node_type IS NOT NULL AND caused_by_event_id IS NOT NULL) a
  LEFT JOIN (SELECT DISTINCT event_id AS cause, {_NODE} AS source FROM owned WHERE node_type IS NOT NULL) o USING (cause))"""
_O = "(occurred_at, segment_sequence, event_id)"
_LIFE = " UNION ALL ".join(
    f"SELECT trace_id, '{span}' AS span, {key} AS key, CASE WHEN event_type IN ({_list(a)}) THEN 's' WHEN event_type IN ({_list(b)}) THEN 'e' END AS role, {_O} AS o FROM e WHERE trace_id IS NOT NULL AND {key} IS NOT NULL" + ("" if span == "run" else f" AND event_type IN ({_list(a + b)})")
    for span, (key, a, b) in G.LIFECYCLES.items()
)
_BAD = f"(starts_with(event_type, 'orphan_') OR event_type IN ('audit_degraded', 'policy_blocked', 'retry_scheduled') OR coalesce(status IN ({_list(G.ABNORMAL)}), false))"
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
SQL |= {
    "graph_returns": f"WITH {_NODES} {_RETURNS}",
    "graph_retries": f"WITH e AS (SELECT event_id, event_type, model_call_id, attempt_id, to_timestamp(t) AS occurred_at FROM (VALUES {_values(RETRIES)}) v(event_id, event_type, model_call_id, attempt_id, t)) {_RETRIES}",
    "graph_causes": f"WITH {_NODES}, {_CAUSES} SELECT resolution, count(*) AS n, count(DISTINCT target) AS n_targets FROM causes GROUP BY 1",
    "graph_chains": f"""WITH {_NODES}, {_CAUSES}, retried AS ({_RETRIES}), touched AS (SELECT unnest([source, target]) AS node FROM causes WHERE resolution = 'linked' UNION SELECT unnest([source, target]) FROM retried),
  n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_at, node_type, node_key) AS pos FROM nodes),
  i AS (SELECT *, pos - row_number() OVER (PARTITION BY run_id ORDER BY first_at, node_type, node_key) AS island FROM n WHERE status = 'succeeded' AND node_type <> 'anomaly' AND {_NODE} NOT IN (SELECT node FROM touched))
  SELECT run_id, count(*) AS members, min(first_at) AS first_at, CAST(coalesce(sum(elapsed_ms), 0) AS BIGINT) AS elapsed_ms FROM i GROUP BY run_id, island HAVING count(*) >= 3""",
    "graph_anomaly_starts": f"""WITH {EVENTS}, life AS ({_LIFE}), ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id, span, key, role ORDER BY o) AS n FROM life),
  per AS (SELECT trace_id, span, key, count(*) FILTER (WHERE role = 's') AS ns, count(*) FILTER (WHERE role = 'e') AS ne, min(o) AS first, min(o) FILTER (WHERE role = 's' AND n = 2) AS s2, min(o) FILTER (WHERE role = 'e' AND n = 2) AS e2 FROM ranked GROUP BY 1, 2, 3),
  broken AS (SELECT trace_id, min(coalesce(s2, e2, first)) AS o FROM per WHERE CASE WHEN span = 'run' THEN ns <> 1 OR ne > 1 ELSE ns = 0 OR ne = 0 END GROUP BY 1),
  t AS (SELECT trace_id, min({_O}) AS first, first(event_id ORDER BY {_O}) FILTER (WHERE {_BAD}) AS bad, first(event_type ORDER BY {_O}) FILTER (WHERE {_BAD}) AS bad_type FROM e WHERE trace_id IS NOT NULL GROUP BY 1),
  l AS (SELECT trace_id, integrity FROM ({L.SQL['trace_listing']}))
  SELECT * FROM (SELECT trace_id, coalesce(broken.o[3], bad, CASE WHEN integrity IN ('invalid', 'incomplete', 'degraded') THEN t.first[3] END) AS event_id,
    CASE WHEN broken.o IS NOT NULL THEN 'lifecycle_mismatch' WHEN bad IS NOT NULL THEN bad_type WHEN integrity IN ('invalid', 'incomplete', 'degraded') THEN 'integrity' END AS category FROM t LEFT JOIN broken USING (trace_id) LEFT JOIN l USING (trace_id)) WHERE event_id IS NOT NULL""",
    "graph_levels": f"""WITH RECURSIVE {_NODES}, edges AS ({SQL['graph_edges'].split(' SELECT DISTINCT ', 1)[1].join(['SELECT DISTINCT ', ''])}), returns AS ({_RETURNS}), retried AS ({_RETRIES}),
  runs AS (SELECT count(*) AS n FROM (SELECT DISTINCT trace_id, run_id FROM e WHERE trace_id IS NOT NULL AND run_id IS NOT NULL)),
  ec AS (SELECT edge_type AS kind, count(*) AS n FROM edges GROUP BY 1), nc AS (SELECT node_type AS kind, count(*) AS n FROM nodes GROUP BY 1)
  SELECT 'trace' AS level, 'run' AS kind, n FROM runs UNION ALL SELECT 'trace', kind, n FROM ec WHERE kind IN ('parent_run', 'resumed_from')
  UNION ALL SELECT 'run', kind, n FROM nc UNION ALL SELECT 'run', kind, n FROM ec WHERE kind NOT IN ('parent_run', 'resumed_from')
  UNION ALL SELECT 'trace_full', 'run', n FROM runs UNION ALL SELECT 'trace_full', kind, n FROM nc UNION ALL SELECT 'trace_full', kind, n FROM ec
  UNION ALL SELECT 'trace_full', edge_type, count(*) FROM returns GROUP BY 2 UNION ALL SELECT 'trace_full', edge_type, count(*) FROM retried GROUP BY 2""",
    "graph_lanes": f"""WITH RECURSIVE {_MORE}, f AS (SELECT run_id, parent_run_id AS p, resumed_from_run_id AS r, occurred_at AS t FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY occurred_at, parent_run_id NULLS FIRST, resumed_from_run_id NULLS FIRST) AS nr FROM e WHERE event_type = 'run_started' AND run_id IS NOT NULL) WHERE nr = 1),
  k AS (SELECT run_id, coalesce(p, r) AS up, CASE WHEN p IS NOT NULL THEN 'child_agent' WHEN r IS NOT NULL THEN 'continuation' ELSE 'main' END AS kind, row_number() OVER (PARTITION BY p ORDER BY t, run_id) - 1 AS nth FROM f),
  w AS (SELECT run_id, kind, CASE WHEN kind = 'main' THEN 0 ELSE 1 END AS lane, kind = 'child_agent' AS stuck FROM k WHERE up IS NULL OR up NOT IN (SELECT run_id FROM k)
    UNION ALL SELECT k.run_id, k.kind, CASE WHEN w.stuck THEN 1 WHEN k.kind = 'continuation' THEN CASE WHEN w.lane <> 0 THEN w.lane ELSE 1 END WHEN w.lane <> 0 THEN sign(w.lane) * (abs(w.lane) + 1)
      WHEN k.nth % 2 = 0 THEN -(k.nth // 2 + 1) ELSE k.nth // 2 + 1 END, w.stuck FROM w JOIN k ON k.up = w.run_id)
  SELECT k.run_id, k.kind, CAST(coalesce(w.lane, 1) AS INTEGER) AS lane FROM k LEFT JOIN w USING (run_id)""",
    "graph_tasks": f"""WITH t AS (SELECT task, max(child) AS child, max(replaces) AS replaces, bool_or(kind = 'subagent_recovered') AS recovered FROM (VALUES {_values(TASKS)}) v(kind, task, child, replaces) WHERE task IS NOT NULL GROUP BY 1)
  SELECT 'task_execution' AS edge_type, 'task:' || task AS source, 'run:' || child AS target FROM t WHERE child IS NOT NULL UNION ALL SELECT 'task_recovery', 'task:' || task, 'run:' || child FROM t WHERE child IS NOT NULL AND recovered
  UNION ALL SELECT 'task_replacement', 'task:' || replaces, 'task:' || task FROM t WHERE replaces IN (SELECT task FROM t)""",
    "graph_spawns": f"""WITH e AS (SELECT * FROM (VALUES {_values(SPAWNS)}) v(event_id, kind, tool, run_id, parent, call, t)), g AS (SELECT *, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS upto FROM e),
  m AS (SELECT c.run_id, count(*) AS n, min(g.call) AS call FROM e c JOIN g ON g.run_id = c.parent AND g.tool = 'spawn' AND c.t > g.t AND (g.upto IS NULL OR c.t < g.upto) WHERE c.kind = 'run_started' GROUP BY 1)
  SELECT 'spawn_branch' AS edge_type, 'tool_call:' || call AS source, 'run:' || run_id AS target FROM m WHERE n = 1""",
}
