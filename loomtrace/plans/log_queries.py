"""Queries over the event log: statistics, listings, paging, lifecycles, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import stats as S
from loomtrace.operators import traces as T
from loomtrace.operators.log import unique_events
from loomtrace.sources.tables import load

#: "Now" of the reports, always given, never read from a clock.
TODAY = "2026-06-01"
SINCE, UNTIL = "2026-05-01 00:00:00", "2026-05-08 00:00:00"
PAGE = 50

COLUMNS = (
    "event_type", "occurred_at", "trace_id", "turn_id", "run_id", "model_call_id", "attempt_id", "tool_call_id", "session_key", "source_type", "iteration", "status",
    "model", "tool_name", "elapsed_ms", "prompt_tokens", "completion_tokens", "total_tokens", "process_instance_id", "segment_id", "segment_sequence", "durability_epoch",
)


def events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per event with the columns asked for (all that are used, by default)."""
    return unique_events(load(spark, d, "audit_events"), *(columns or COLUMNS))


_STATS = ("event_type", "status", "trace_id", "run_id", "prompt_tokens", "completion_tokens", "total_tokens", "elapsed_ms")


def stats_by_source(spark, d):
    return S.stats(events(spark, d, *_STATS, "source_type"), "source_type")


def stats_by_status(spark, d):
    return S.stats(events(spark, d, *_STATS), "status")


def stats_by_model(spark, d):
    return S.stats(events(spark, d, *_STATS, "model"), "model")


def stats_by_tool(spark, d):
    return S.stats(events(spark, d, *_STATS, "tool_name"), "tool")


_TRACE = ("event_type", "status", "trace_id", "turn_id", "run_id", "occurred_at")


def trace_summaries(spark, d):
    return T.find_traces(events(spark, d, *_TRACE))


def trace_page_first(spark, d):
    return T.page(trace_summaries(spark, d), "trace_id", PAGE)


def trace_page_next(spark, d):
    last = T.page(trace_summaries(spark, d), "trace_id", PAGE).orderBy("last_seen", "trace_id").select(F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "trace_id").first()
    cursor = T.decode_cursor(T.encode_cursor(last["at"], last["trace_id"])) if last else None
    return T.page(trace_summaries(spark, d), "trace_id", PAGE, cursor)


def trace_filter_exists(spark, d):
    return T.find_traces(T.having_any(events(spark, d, *_TRACE, "source_type", "tool_name"), "trace_id", source_type="channel", tool_name="grep"))


def trace_time_overlap(spark, d):
    return T.overlapping(trace_summaries(spark, d), SINCE, UNTIL)


def trace_time_rows(spark, d):
    return T.find_traces(events(spark, d, *_TRACE).filter(F.col("occurred_at").between(F.lit(SINCE).cast("timestamp"), F.lit(UNTIL).cast("timestamp"))))


def trace_substring_filter(spark, d):
    rows = events(spark, d, "session_key", "trace_id").filter(F.lower("session_key").like("%slack%17_7%"))
    return rows.groupBy("session_key").agg(F.count_distinct("trace_id").alias("trace_count"))


def trace_listing(spark, d):
    return T.list_traces(events(spark, d, "event_type", "status", "trace_id", "run_id", "occurred_at", "session_key", "source_type", "process_instance_id"))


def session_listing(spark, d):
    return T.list_sessions(events(spark, d, "event_type", "status", "trace_id", "run_id", "occurred_at", "session_key", "process_instance_id"))


def anti_open_runs(spark, d):
    return T.open_runs(events(spark, d, "event_type", "run_id", "occurred_at"))


def process_integrity(spark, d):
    return T.process_integrity(events(spark, d, "event_type", "process_instance_id"))


def first_anomaly(spark, d):
    return T.first_anomaly(events(spark, d, "event_type", "status", "trace_id", "occurred_at", "segment_sequence"))


def trace_outcomes(spark, d):
    return T.trace_summary(events(spark, d, "event_type", "status", "trace_id", "tool_name", "elapsed_ms", "occurred_at"))


def sequence_edges(spark, d):
    return T.sequence_edges(events(spark, d, "run_id", "occurred_at", "segment_sequence"))


def collapse_groups(spark, d):
    return T.collapse_groups(events(spark, d, "event_type", "status", "run_id", "occurred_at", "segment_sequence", "elapsed_ms"))


def lifecycle_cardinality(spark, d):
    return S.lifecycle_cardinality(events(spark, d, "event_type", "run_id", "iteration", "model_call_id", "attempt_id", "tool_call_id"))


_USE = ("occurred_at", "session_key", "prompt_tokens", "completion_tokens", "total_tokens")


def usage_daily(spark, d):
    return S.daily_usage(events(spark, d, *_USE))


def usage_summary(spark, d):
    return S.usage_summary(usage_daily(spark, d), TODAY)


def usage_streaks(spark, d):
    days = events(spark, d, "session_key", "occurred_at").filter("session_key is not null").select("session_key", F.to_date("occurred_at").alias("day"))
    return S.streaks(days, TODAY, "session_key")


def operational_report(spark, d):
    runs = events(spark, d, "event_type", "occurred_at", "status").filter("event_type = 'run_finished'")
    return S.operational_report(runs, SINCE, UNTIL, "occurred_at", "status", "succeeded", ("failed", "exhausted"))


def operational_overview(spark, d):
    return S.operational_overview(events(spark, d, "event_type", "occurred_at", "status"), SINCE, UNTIL)


def tombstoned_events(spark, d):
    gone = load(spark, d, "tombstones").filter("object_type = 'event'").select(F.col("object_id").alias("event_id")).distinct()
    return events(spark, d, "event_type").join(gone, "event_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


def live_events(spark, d):
    gone = load(spark, d, "tombstones").filter("object_type = 'event'").select(F.col("object_id").alias("event_id")).distinct()
    return events(spark, d, "event_type").join(gone, "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


def catalog_left_join(spark, d):
    # The catalogs have a fixed number of rows: Spark broadcasts them by their size.
    kinds = load(spark, d, "event_type_catalog").select("event_type", "family", "is_terminal")
    models = load(spark, d, "model_catalog").select("model", "provider")
    rows = events(spark, d, "event_type", "model", "total_tokens").join(kinds, "event_type", "left").join(models, "model", "left")
    return rows.groupBy(F.coalesce("family", F.lit("unlisted")).alias("family"), F.coalesce("provider", F.lit("none")).alias("provider")).agg(F.count("*").alias("n"), S.zero(F.sum("total_tokens")).alias("tokens"))


def parent_child_runs(spark, d):
    starts = unique_events(load(spark, d, "audit_events"), "event_type", "run_id", "parent_run_id", "occurred_at").filter("event_type = 'run_started'")
    child, parent = starts.alias("c"), starts.alias("p")
    both = child.join(parent, F.col("c.parent_run_id") == F.col("p.run_id"))
    return both.select(F.col("c.run_id").alias("run_id"), F.col("p.run_id").alias("parent_run_id"), (F.unix_millis("c.occurred_at") - F.unix_millis("p.occurred_at")).alias("lag_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        stats_by_source, stats_by_status, stats_by_model, stats_by_tool, trace_summaries, trace_page_first, trace_page_next, trace_filter_exists, trace_time_overlap, trace_time_rows,
        trace_substring_filter, trace_listing, session_listing, anti_open_runs, process_integrity, first_anomaly, trace_outcomes, sequence_edges, collapse_groups, lifecycle_cardinality,
        usage_daily, usage_summary, usage_streaks, operational_report, operational_overview, tombstoned_events, live_events, catalog_left_join, parent_child_runs,
    )
}


def named(column: str) -> str:
    return f"nullif(lower(trim({column})), '')"


#: One row per event in SQL.
EVENTS = f"""e AS (SELECT DISTINCT event_id, {', '.join(f"{named(c)} AS {c}" for c in ('event_type', 'status', 'model', 'tool_name', 'source_type'))},
  occurred_at AT TIME ZONE 'UTC' AS occurred_at, trace_id, turn_id, run_id, parent_run_id, model_call_id, attempt_id, tool_call_id, session_key, iteration, elapsed_ms, prompt_tokens, completion_tokens,
  total_tokens, process_instance_id, segment_id, segment_sequence, durability_epoch FROM audit_events)"""


def _stats_sql(column: str) -> str:
    flag = lambda c: f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT)"
    return f"""WITH {EVENTS} SELECT coalesce({column}, 'unknown') AS group_name, count(*) AS event_count, count(DISTINCT trace_id) AS trace_count,
      count(DISTINCT CASE WHEN event_type = 'run_started' THEN run_id END) AS run_count, {flag("event_type = 'run_finished' AND status = 'failed'")} AS error_count,
      {flag("event_type = 'run_finished' AND status = 'cancelled'")} AS cancellation_count, {flag("event_type = 'iteration_started'")} AS iteration_count,
      {', '.join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ('prompt_tokens', 'completion_tokens', 'total_tokens'))}, round(avg(elapsed_ms), 4) AS average_latency_ms
      FROM e GROUP BY 1"""


def _traces(source: str = "e") -> str:
    return f"""SELECT trace_id, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, count(DISTINCT turn_id) AS turn_count, count(DISTINCT run_id) AS run_count,
      coalesce(array_to_string(list_sort(list(DISTINCT status) FILTER (WHERE event_type = 'run_finished' AND status IS NOT NULL)), ','), '') AS terminal_statuses FROM {source} WHERE trace_id IS NOT NULL GROUP BY trace_id"""


_BAD = "(coalesce(starts_with(event_type, 'orphan_') OR event_type = 'audit_degraded' OR status IN ('error', 'timeout', 'blocked'), false))"
_OPEN = f"""open_runs AS (SELECT run_id, min(occurred_at) FILTER (WHERE event_type = 'run_started') AS started_at FROM e WHERE run_id IS NOT NULL GROUP BY run_id
  HAVING count(*) FILTER (WHERE event_type = 'run_started') > 0 AND count(*) FILTER (WHERE event_type IN ('run_finished', 'orphan_run_detected')) = 0)"""
_INTEGRITY = """integ AS (SELECT process_instance_id, CASE WHEN bool_or(event_type = 'audit_degraded') THEN 'degraded' WHEN NOT bool_or(event_type = 'process_instance_closed') THEN 'incomplete' ELSE 'valid' END AS integrity
  FROM e WHERE process_instance_id IS NOT NULL GROUP BY process_instance_id)"""
_USAGE = f"""WITH {EVENTS}, u AS (SELECT CAST(occurred_at AS DATE) AS day,
    CASE WHEN starts_with(k, 'dream:') THEN 'dream' WHEN k = 'heartbeat' OR starts_with(k, 'cron:') THEN 'cron' WHEN starts_with(k, 'api:') THEN 'api' WHEN starts_with(k, 'system:') THEN 'system' ELSE 'user' END AS source, p, c,
    CASE WHEN t > 0 THEN t ELSE p + c END AS t
  FROM (SELECT occurred_at, coalesce(session_key, '') AS k, greatest(0, coalesce(prompt_tokens, 0)) AS p, greatest(0, coalesce(completion_tokens, 0)) AS c, greatest(0, coalesce(total_tokens, 0)) AS t FROM e)),
 daily AS (SELECT day, source, count(*) AS requests, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(t) AS BIGINT) AS total_tokens FROM u WHERE t > 0 GROUP BY 1, 2)"""
_SPANS = "UNION ALL ".join(
    f"SELECT '{span}' AS span, {identity} AS identity, CASE WHEN event_type = '{start}' THEN 1 ELSE 0 END AS s FROM e WHERE event_type IN ('{start}', {ends}) "
    for span, start, ends, identity in (
        ("run", "run_started", "'run_finished'", "run_id"),
        ("iteration", "iteration_started", "'iteration_finished'", "concat_ws('/', run_id, CAST(iteration AS VARCHAR))"),
        ("model_call", "model_request_started", "'model_response_received', 'model_request_failed'", "model_call_id"),
        ("model_attempt", "model_attempt_started", "'model_attempt_finished'", "attempt_id"),
        ("tool_call", "tool_started", "'tool_finished'", "tool_call_id"),
    )
)
_ISLAND_ORDER = "PARTITION BY run_id ORDER BY occurred_at, segment_sequence, event_id"

_KINDS = (("runs", "run_finished", "'failed', 'exhausted'"), ("deliveries", "delivery_finished", "'failed'"), ("tools", "tool_finished", "'error', 'timeout', 'blocked'"), ("subagents", "subagent_terminal", "'failed', 'lost', 'cancelled'"))
SQL = {
    "operational_overview": f"""WITH {EVENTS}, c AS (SELECT {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{n}, count(*) FILTER (WHERE event_type = '{k}' AND status IN ({bad})) AS bad_{n}" for n, k, bad in _KINDS)}
  FROM e WHERE occurred_at >= TIMESTAMP '{SINCE}' AND occurred_at < TIMESTAMP '{UNTIL}') SELECT *, {', '.join(f"round(CASE WHEN n_{n} > 0 THEN bad_{n} / CAST(n_{n} AS DOUBLE) ELSE 0.0::DOUBLE END, 6) AS rate_{n}" for n, _, _ in _KINDS)} FROM c""",
    "stats_by_source": _stats_sql("source_type"),
    "stats_by_status": _stats_sql("status"),
    "stats_by_model": _stats_sql("model"),
    "stats_by_tool": _stats_sql("tool_name"),
    "trace_summaries": f"WITH {EVENTS} {_traces()}",
    "trace_page_first": f"WITH {EVENTS} {_traces()} ORDER BY last_seen DESC, trace_id DESC LIMIT {PAGE}",
    "trace_page_next": f"WITH {EVENTS} {_traces()} ORDER BY last_seen DESC, trace_id DESC LIMIT {PAGE} OFFSET {PAGE}",
    "trace_filter_exists": f"WITH {EVENTS}, f AS (SELECT * FROM e WHERE trace_id IN (SELECT trace_id FROM e WHERE source_type = 'channel') AND trace_id IN (SELECT trace_id FROM e WHERE tool_name = 'grep')) {_traces('f')}",
    "trace_time_overlap": f"WITH {EVENTS} SELECT * FROM ({_traces()}) WHERE last_seen >= TIMESTAMP '{SINCE}' AND first_seen <= TIMESTAMP '{UNTIL}'",
    "trace_time_rows": f"WITH {EVENTS}, f AS (SELECT * FROM e WHERE occurred_at BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}') {_traces('f')}",
    "trace_substring_filter": f"WITH {EVENTS} SELECT session_key, count(DISTINCT trace_id) AS trace_count FROM e WHERE lower(session_key) LIKE '%slack%17_7%' GROUP BY 1",
    "trace_listing": f"""WITH {EVENTS}, {_OPEN}, {_INTEGRITY},
  runs AS (SELECT trace_id, run_id, bool_or(event_type = 'run_started') AND NOT bool_or(event_type = 'run_finished') AND run_id IS NOT NULL AS open, bool_or(event_type = 'orphan_run_detected') AS orphaned FROM e WHERE trace_id IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT trace_id, count(run_id) AS run_count, coalesce(bool_or(open AND NOT orphaned), false) AS active, coalesce(bool_or(open), false) AS incomplete FROM runs GROUP BY 1),
  t AS (SELECT trace_id, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, count(*) AS event_count, count(*) FILTER (WHERE {_BAD}) AS anomaly_count,
    coalesce(list(DISTINCT status) FILTER (WHERE status IS NOT NULL), []) AS st, coalesce(array_to_string(list_sort(list(DISTINCT source_type) FILTER (WHERE source_type IS NOT NULL)), ','), '') AS sources, min(session_key) AS session_key,
    coalesce(first(source_type ORDER BY CASE WHEN source_type IN ('user', 'websocket') THEN 0 WHEN source_type IN ('system', 'delivery') THEN 2 ELSE 1 END, occurred_at, event_id) FILTER (WHERE source_type IS NOT NULL), 'system') AS primary_source
    FROM e WHERE trace_id IS NOT NULL GROUP BY 1),
  i AS (SELECT trace_id, CASE max(CASE integrity WHEN 'degraded' THEN 2 WHEN 'incomplete' THEN 3 ELSE 1 END) WHEN 2 THEN 'degraded' WHEN 3 THEN 'incomplete' ELSE 'valid' END AS integrity FROM (SELECT DISTINCT trace_id, process_instance_id FROM e WHERE trace_id IS NOT NULL) JOIN integ USING (process_instance_id) GROUP BY 1)
  SELECT t.trace_id, first_seen, last_seen, event_count, run_count, anomaly_count,
    CASE WHEN active THEN 'running' WHEN list_has_any(st, ['failed', 'exhausted']) THEN 'failed' WHEN list_contains(st, 'interrupted') THEN 'interrupted' WHEN list_contains(st, 'cancelled') THEN 'cancelled' WHEN incomplete THEN 'incomplete' WHEN anomaly_count > 0 THEN 'warning' ELSE 'succeeded' END AS display_status,
    sources, primary_source, session_key, coalesce(integrity, 'valid') AS integrity, concat_ws(' / ', primary_source, strftime(last_seen, '%H:%M'), substr(t.trace_id, 1, 8)) AS title
  FROM t JOIN r USING (trace_id) LEFT JOIN i USING (trace_id)""",
    "session_listing": f"""WITH {EVENTS}, {_OPEN}, {_INTEGRITY}, k AS (SELECT * FROM e WHERE session_key IS NOT NULL AND session_key <> '' AND trace_id IS NOT NULL),
  t AS (SELECT session_key, trace_id, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, coalesce(bool_or(status IN ('failed', 'exhausted')), false) AS failed, coalesce(bool_or(status IN ('error', 'timeout', 'blocked')), false) AS warned,
    coalesce(bool_or(run_id IN (SELECT run_id FROM open_runs)), false) AS active FROM k GROUP BY 1, 2),
  s AS (SELECT session_key, max(CASE integrity WHEN 'degraded' THEN 2 WHEN 'incomplete' THEN 3 ELSE 1 END) AS rank FROM (SELECT DISTINCT session_key, process_instance_id FROM k) JOIN integ USING (process_instance_id) GROUP BY 1)
  SELECT *, CASE (SELECT rank FROM s WHERE s.session_key = l.session_key) WHEN 2 THEN 'degraded' WHEN 3 THEN 'incomplete' ELSE 'valid' END AS integrity FROM (SELECT session_key, min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS trace_count, count(*) FILTER (WHERE active) AS active_trace_count, count(*) FILTER (WHERE failed) AS error_count,
    count(*) FILTER (WHERE NOT failed AND warned) AS warning_count, last(trace_id ORDER BY last_seen, trace_id) AS latest_trace_id FROM t GROUP BY 1) l""",
    "anti_open_runs": f"WITH {EVENTS}, {_OPEN} SELECT run_id, started_at FROM open_runs",
    "process_integrity": f"WITH {EVENTS}, {_INTEGRITY} SELECT process_instance_id, integrity FROM integ",
    "first_anomaly": f"""WITH {EVENTS} SELECT trace_id, event_id, event_type AS category FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY occurred_at, segment_sequence, event_id) AS nr FROM e
  WHERE trace_id IS NOT NULL AND (starts_with(event_type, 'orphan_') OR event_type IN ('audit_degraded', 'policy_blocked', 'retry_scheduled') OR status IN ('error', 'timeout', 'blocked', 'failed', 'exhausted'))) WHERE nr = 1""",
    "trace_outcomes": f"""WITH {EVENTS} SELECT trace_id, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'tool_finished') AS tool_count,
    coalesce(array_to_string(list_sort(list(DISTINCT tool_name) FILTER (WHERE tool_name IS NOT NULL)), ','), '') AS tools, CAST(count(DISTINCT event_type) AS INTEGER) AS type_count, count(*) FILTER (WHERE {_BAD}) AS failure_count,
    coalesce(last(status ORDER BY occurred_at, event_id) FILTER (WHERE event_type = 'run_finished' AND status IS NOT NULL), last(status ORDER BY occurred_at, event_id) FILTER (WHERE event_type = 'turn_finished' AND status IS NOT NULL), 'running') AS outcome,
    greatest(coalesce(max(elapsed_ms), date_diff('millisecond', min(occurred_at), max(occurred_at))), 0) AS elapsed_ms FROM e WHERE trace_id IS NOT NULL GROUP BY 1""",
    "sequence_edges": f"""WITH {EVENTS} SELECT * FROM (SELECT run_id, event_id AS source, lead(event_id) OVER w AS target, date_diff('millisecond', occurred_at, lead(occurred_at) OVER w) AS gap_ms
  FROM e WHERE run_id IS NOT NULL WINDOW w AS ({_ISLAND_ORDER})) WHERE target IS NOT NULL""",
    "collapse_groups": f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER ({_ISLAND_ORDER}) AS pos FROM e WHERE run_id IS NOT NULL AND event_type = 'tool_finished'),
  i AS (SELECT *, pos - row_number() OVER ({_ISLAND_ORDER}) AS island FROM n WHERE status = 'ok')
  SELECT run_id, count(*) AS members, min(pos) AS first_at, CAST(coalesce(sum(elapsed_ms), 0) AS BIGINT) AS elapsed_ms FROM i GROUP BY run_id, island HAVING count(*) >= 3""",
    "lifecycle_cardinality": f"""WITH {EVENTS}, s AS ({_SPANS}), c AS (SELECT span, identity, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(1 - s) AS BIGINT) AS ends FROM s GROUP BY 1, 2)
  SELECT span, identity, starts, ends, CASE WHEN starts <> 1 OR ends > 1 THEN 'lifecycle_cardinality' ELSE 'open_span' END AS verdict FROM c WHERE starts > 0 AND (starts <> 1 OR ends <> 1)""",
    "usage_daily": f"{_USAGE} SELECT * FROM daily",
    "usage_summary": f"""{_USAGE}, d AS (SELECT day, sum(total_tokens) AS t, sum(requests) AS r FROM daily GROUP BY 1) SELECT CAST(coalesce(sum(t), 0) AS BIGINT) AS total_tokens,
  CAST(coalesce(sum(t) FILTER (WHERE day <= DATE '{TODAY}' AND day > DATE '{TODAY}' - 30), 0) AS BIGINT) AS total_tokens_30d, CAST(coalesce(sum(t) FILTER (WHERE day <= DATE '{TODAY}' AND day > DATE '{TODAY}' - 365), 0) AS BIGINT) AS total_tokens_365d,
  CAST(coalesce(max(t), 0) AS BIGINT) AS peak_day_tokens, count(*) FILTER (WHERE day <= DATE '{TODAY}' AND day > DATE '{TODAY}' - 30 AND t > 0) AS active_days_30d,
  CAST(coalesce(sum(r) FILTER (WHERE day <= DATE '{TODAY}' AND day > DATE '{TODAY}' - 30), 0) AS BIGINT) AS requests_30d FROM d""",
    "usage_streaks": f"""WITH {EVENTS}, d AS (SELECT DISTINCT session_key, CAST(occurred_at AS DATE) AS day FROM e WHERE session_key IS NOT NULL),
  i AS (SELECT session_key, day, day - CAST(row_number() OVER (PARTITION BY session_key ORDER BY day) AS INTEGER) AS island FROM d),
  r AS (SELECT session_key, island, count(*) AS n, max(day) AS last_day FROM i GROUP BY 1, 2)
  SELECT session_key, coalesce(max(n) FILTER (WHERE last_day = DATE '{TODAY}'), 0) AS current_streak_days, max(n) AS longest_streak_days FROM r GROUP BY 1""",
    "operational_report": f"""WITH {EVENTS}, c AS (SELECT count(*) AS n_all, count(status) AS n_judged, count(*) FILTER (WHERE status = 'succeeded') AS n_good, count(*) FILTER (WHERE status IN ('failed', 'exhausted')) AS n_bad
  FROM e WHERE event_type = 'run_finished' AND occurred_at >= TIMESTAMP '{SINCE}' AND occurred_at < TIMESTAMP '{UNTIL}')
  SELECT *, round(CASE WHEN n_judged > 0 THEN n_good / CAST(n_judged AS DOUBLE) ELSE 0.0 END, 6) AS good_rate, round(CASE WHEN n_all > 0 THEN n_bad / CAST(n_all AS DOUBLE) ELSE 0.0 END, 6) AS bad_rate FROM c""",
    "tombstoned_events": f"WITH {EVENTS} SELECT event_type, count(*) AS n FROM e WHERE event_id IN (SELECT object_id FROM tombstones WHERE object_type = 'event') GROUP BY 1",
    "live_events": f"WITH {EVENTS} SELECT event_type, count(*) AS n FROM e WHERE event_id NOT IN (SELECT object_id FROM tombstones WHERE object_type = 'event') GROUP BY 1",
    "catalog_left_join": f"""WITH {EVENTS} SELECT coalesce(k.family, 'unlisted') AS family, coalesce(m.provider, 'none') AS provider, count(*) AS n, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens
  FROM e LEFT JOIN event_type_catalog k USING (event_type) LEFT JOIN model_catalog m ON m.model = e.model GROUP BY 1, 2""",
    "parent_child_runs": f"""WITH {EVENTS}, s AS (SELECT event_id, run_id, parent_run_id, occurred_at FROM e WHERE event_type = 'run_started')
  SELECT c.run_id, p.run_id AS parent_run_id, date_diff('millisecond', p.occurred_at, c.occurred_at) AS lag_ms FROM s c JOIN s p ON c.parent_run_id = p.run_id""",
}
