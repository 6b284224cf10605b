"""Queries of the general data operators over the event log (problems 1, 3 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import entity_features, hierarchy, orphans
from loomtrace.sources.tables import load


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.log_orphans(load(spark, d, "audit_events"), load(spark, d, "node_relations"), load(spark, d, "tombstones"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "ref_key")


def p1_weekly(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_per_week(_orphans(spark, d))


def p1_dense(spark: SparkSession, d: str) -> DataFrame:
    """Dense integer keys, so long runs: events whose predecessor in the segment is missing or younger."""
    return orphans.sequence_orphans(load(spark, d, "audit_events"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return orphans.sequence_runs(load(spark, d, "audit_events"))


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    return entity_features.run_features(load(spark, d, "audit_events"), load(spark, d, "event_type_catalog"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.run_hierarchy(load(spark, d, "audit_events"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_nodes(hierarchy.run_links(load(spark, d, "audit_events"))).select(F.col("id").alias("run_id"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    solved = hierarchy.with_descendant_counts(_runs(spark, d))
    return solved.select(F.col("id").alias("run_id"), F.col("root").alias("root_run_id"), "depth", F.concat_ws("/", "path").alias("path"), "status", "n_descendants")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_runs(spark, d)).select(F.col("ancestor").alias("run_id"), F.col("id").alias("descendant_run_id"), "distance")


QUERIES = {f.__name__: f for f in (p1_found, p1_weekly, p1_dense, p1_runs, p3_features, p6_found, p6_paths, p6_descendants)}

_U = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def _ref(column: str) -> str:
    bare = rf"regexp_replace({column}, '^\s*(?:urn:uuid:)?\s*(?:\{{\s*(?:urn:uuid:)?({_U})\s*\}}|({_U}))\s*$', '\1\2', 'i')"
    return f"(CASE WHEN regexp_full_match(lower({bare}), '{_U}') THEN lower({bare}) END)"


_ORPHANS = f"""
WITH ev AS (SELECT *, coalesce({_ref('event_id')}, trim(event_id)) AS k FROM audit_events),
e AS (SELECT k, min(recorded_at) AS seen, any_value({_ref('caused_by_event_id')}) AS c, any_value({_ref('parent_run_id')}) AS p FROM ev GROUP BY k),
starts AS (SELECT {_ref('run_id')} AS k, min(recorded_at) AS seen FROM ev WHERE event_type = 'run_started' GROUP BY 1),
rel AS (SELECT relation_id, min(built_at) AS seen, any_value({_ref('raw_target_event_id')}) AS t FROM node_relations GROUP BY 1),
tomb AS (SELECT DISTINCT object_type, {_ref('object_id')} AS k FROM tombstones),
refs AS (
  SELECT 'audit_events' AS ref_table, 'caused_by_event_id' AS ref_field, k AS ref_key, c AS t, seen, 'event' AS o FROM e WHERE c IS NOT NULL
  UNION ALL SELECT 'audit_events', 'parent_run_id', k, p, seen, 'run' FROM e WHERE p IS NOT NULL
  UNION ALL SELECT 'node_relations', 'raw_target_event_id', CAST(relation_id AS VARCHAR), t, seen, 'event' FROM rel WHERE t IS NOT NULL),
targets AS (SELECT 'event' AS o, k, seen FROM e UNION ALL SELECT 'run', k, seen FROM starts),
orphans AS (
  SELECT ref_table, ref_field, ref_key, refs.seen,
    CASE WHEN tomb.k IS NOT NULL THEN 'deleted' WHEN targets.k IS NULL THEN 'missing' ELSE 'later' END AS reason
  FROM refs LEFT JOIN targets ON targets.o = refs.o AND targets.k = refs.t
  LEFT JOIN tomb ON tomb.object_type = refs.o AND tomb.k = refs.t
  WHERE targets.k IS NULL OR tomb.k IS NOT NULL OR targets.seen > refs.seen)
"""


# The 61 event types of the log, for the column names of the SQL only; the operator reads the catalog.
EVENT_TYPES = (
    "audit_degraded audit_recovered cancel_requested checkpoint_cleared checkpoint_restored checkpoint_written continuation_requested "
    "delivery_attempted delivery_finished delivery_retry_scheduled finalization_requested goal_blocked goal_cancelled goal_completed "
    "goal_created goal_updated input_injected iteration_finished iteration_started model_attempt_finished model_attempt_started "
    "model_first_output model_request_failed model_request_started model_response_received orphan_model_call_detected orphan_run_detected "
    "orphan_run_suspected orphan_tool_detected policy_blocked process_instance_closed process_instance_started provider_route_decision "
    "reasoning_summary_received retry_scheduled returned_to_caller run_finished run_started segment_closed segment_started "
    "subagent_admitted subagent_budget_updated subagent_cancel_requested subagent_created subagent_delivery_failed subagent_lost "
    "subagent_phase_changed subagent_recovered subagent_result_claimed subagent_result_delivered subagent_result_ready subagent_terminal "
    "subagent_termination_decided subagent_usage_updated tool_finished tool_started trace_created trace_linked turn_finished "
    "turn_response_prepared turn_started"
).split()


def _feature_sql() -> str:
    listed = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    parts = []
    for t in [*EVENT_TYPES, entity_features.UNLISTED]:
        of = lambda c: f"any_value({c}) FILTER (WHERE t = '{t}')"  # noqa: B023, E731
        parts += [f"coalesce({of('n')}, 0) AS n_{t}", f"{of('seen')} AS last_{t}", f"coalesce({of('ms')}, 0) AS elapsed_ms_{t}", f"coalesce({of('tok')}, 0) AS total_tokens_{t}"]
        slot = lambda c, none, kind: f"list_transform(slots, lambda x: coalesce(CAST({of('by_status')}[x].{c} AS {kind}), {none}))"  # noqa: B023, E731
        parts += [f"{slot('n', 0, 'INTEGER')} AS statuses_{t}", f"{slot('seen', 'NULL', 'BIGINT')} AS status_last_{t}", f"{slot('ms', 0, 'BIGINT')} AS status_elapsed_ms_{t}", f"{slot('tok', 0, 'BIGINT')} AS status_total_tokens_{t}"]
    return f"""
WITH once AS (SELECT DISTINCT event_id, coalesce({_ref('run_id')}, trim(run_id)) AS run_id, lower(trim(event_type)) AS et, coalesce(nullif(lower(trim(status)), ''), 'none') AS s,
    occurred_at AT TIME ZONE 'UTC' AS seen, greatest(coalesce(elapsed_ms, 0), 0) AS ms, greatest(coalesce(total_tokens, 0), 0) AS tok FROM audit_events WHERE run_id IS NOT NULL),
named AS (SELECT list_append(coalesce(list(s ORDER BY s) FILTER (WHERE s <> 'none'), []), 'none') AS slots FROM (SELECT DISTINCT s FROM once)),
typed AS (SELECT *, CASE WHEN et IN ({listed}) THEN et ELSE '{entity_features.UNLISTED}' END AS t FROM once),
cells AS (SELECT run_id, t, s, count(*) AS n, max(seen) AS seen, sum(ms) AS ms, sum(tok) AS tok FROM typed GROUP BY 1, 2, 3),
kinds AS (SELECT run_id, t, CAST(sum(n) AS BIGINT) AS n, max(seen) AS seen, CAST(sum(ms) AS BIGINT) AS ms, CAST(sum(tok) AS BIGINT) AS tok,
    map_from_entries(list((s, struct_pack(n := n, seen := epoch_us(seen), ms := ms, tok := tok)))) AS by_status FROM cells GROUP BY 1, 2)
SELECT run_id, CAST(sum(n) AS BIGINT) AS n_events, max(seen) AS last_at, any_value(slots) AS status_slots, {', '.join(parts)} FROM kinds, named GROUP BY run_id, slots"""


_WALK = f"""
WITH RECURSIVE st AS (
  SELECT * FROM (SELECT coalesce({_ref('run_id')}, trim(run_id)) AS id, {_ref('parent_run_id')} AS p, {_ref('resumed_from_run_id')} AS r, {_ref('caused_by_event_id')} AS c,
    row_number() OVER (PARTITION BY run_id ORDER BY recorded_at, event_id) AS nr FROM audit_events WHERE event_type = 'run_started') WHERE nr = 1 AND id IS NOT NULL),
ev AS (SELECT coalesce({_ref('event_id')}, trim(event_id)) AS k, min(coalesce({_ref('run_id')}, trim(run_id))) AS run FROM audit_events WHERE run_id IS NOT NULL GROUP BY 1),
named AS (SELECT st.id, CASE WHEN coalesce(p, r) IS NOT NULL THEN coalesce(p, r) ELSE ev.run END AS parent FROM st LEFT JOIN ev ON ev.k = st.c),
links AS (SELECT a.id, b.id AS parent FROM named a LEFT JOIN st b ON b.id = a.parent),
walk AS (
  SELECT id, id AS at_id, [id] AS up, parent AS nxt, 0 AS depth FROM links
  UNION ALL
  SELECT w.id, l.id, list_append(w.up, l.id), l.parent, w.depth + 1 FROM walk w JOIN links l ON l.id = w.nxt WHERE NOT list_contains(w.up, w.nxt)),
ends AS (SELECT id, at_id, up, depth, CASE WHEN nxt IS NULL THEN 'tree' WHEN nxt = id THEN 'cycle' ELSE 'below_cycle' END AS status
  FROM walk WHERE nxt IS NULL OR list_contains(up, nxt)),
pairs AS (SELECT w.at_id AS run_id, w.id AS descendant_run_id, w.depth AS distance FROM walk w JOIN ends e ON e.id = w.id WHERE e.status = 'tree' AND w.depth > 0)
"""

SQL = {
    "p1_found": f"{_ORPHANS} SELECT ref_field, ref_key FROM orphans",
    "p1_weekly": f"{_ORPHANS} SELECT ref_table, ref_field, CAST(date_trunc('week', seen AT TIME ZONE 'UTC') AS DATE) AS week, reason, count(*) AS n_orphans FROM orphans GROUP BY 1, 2, 3, 4",
    "p1_dense": """
WITH e AS (SELECT event_id, segment_id, segment_sequence, min(recorded_at) AS seen FROM audit_events WHERE segment_id IS NOT NULL AND segment_sequence IS NOT NULL GROUP BY 1, 2, 3),
places AS (SELECT segment_id, segment_sequence, min(seen) AS seen FROM e GROUP BY 1, 2)
SELECT e.segment_id, e.segment_sequence, event_id, CASE WHEN p.segment_id IS NULL THEN 'missing' ELSE 'later' END AS reason
FROM e LEFT JOIN places p ON p.segment_id = e.segment_id AND p.segment_sequence = e.segment_sequence - 1
WHERE e.segment_sequence > 1 AND (p.segment_id IS NULL OR p.seen > e.seen)""",
    "p1_runs": """
WITH places AS (SELECT DISTINCT segment_id, segment_sequence AS s FROM audit_events WHERE segment_id IS NOT NULL AND segment_sequence IS NOT NULL),
numbered AS (SELECT *, s - row_number() OVER (PARTITION BY segment_id, s >> 16 ORDER BY s) AS island FROM places)
SELECT segment_id, min(s) AS first_sequence, max(s) AS last_sequence, count(*) AS n_places FROM numbered GROUP BY segment_id, s >> 16, island""",
    "p3_features": _feature_sql(),
    "p6_found": f"{_WALK} SELECT id AS run_id FROM ends WHERE status = 'cycle'",
    "p6_paths": f"{_WALK} SELECT id AS run_id, CASE WHEN status = 'tree' THEN at_id END AS root_run_id, CASE WHEN status = 'tree' THEN depth END AS depth,"
    " CASE WHEN status = 'tree' THEN array_to_string(list_reverse(up), '/') ELSE '' END AS path, status,"
    " CASE WHEN status = 'tree' THEN coalesce(n, 0) END AS n_descendants FROM ends LEFT JOIN (SELECT run_id, count(*) AS n FROM pairs GROUP BY 1) d ON d.run_id = ends.id",
    "p6_descendants": f"{_WALK} SELECT run_id, descendant_run_id, distance FROM pairs",
}
