"""Queries over documents, messages and correlated events: search, text functions, history, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.operators import evidence as V
from loomtrace.operators import history as H
from loomtrace.operators import search as R
from loomtrace.operators.log import unique_events
from loomtrace.operators.stats import zero
from loomtrace.plans.log_queries import EVENTS, TODAY, events
from loomtrace.sources.tables import load

QUERY = "session store stale lease"
NOW = f"{TODAY} 00:00:00"
BUDGET = 400
#: Tokens of the texts that are packed together.
PACK_BUDGET = 12_000


def _docs(spark, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.col("updated_at").alias("updated"))


def term_match_rank(spark, d):
    return R.rank(_docs(spark, d), QUERY, NOW)


def term_match_all(spark, d):
    return _docs(spark, d).filter(R.match_all(F.concat_ws(" ", "title", "text"), QUERY)).select("id")


def bm25_topk(spark, d):
    return R.bm25(_docs(spark, d), QUERY)


def token_budget_pack(spark, d):
    hits = R.rank(_docs(spark, d), QUERY, NOW).join(_docs(spark, d).select("id", "text"), "id")
    return R.fit_budget(hits, PACK_BUDGET, "text", F.desc("score"), F.desc("freshness"), F.col("id")).select("id", "tokens_upto")


def grep_content(spark, d):
    return R.grep(load(spark, d, "documents"), "doc_id", "text", r"lease \d+ still held")


def grep_count(spark, d):
    return R.grep_counts(load(spark, d, "documents"), "doc_id", "text", "Token Budget", fixed=True, ignore_case=True)


def grep_context(spark, d):
    return R.grep_context(load(spark, d, "documents").filter("text is not null"), "doc_id", "text", r"WARN gateway", 1)


def line_window(spark, d):
    return R.line_window(load(spark, d, "documents"), "doc_id", "text", 3, 5, 400)


def html_strip(spark, d):
    pages = load(spark, d, "documents")
    return pages.select("doc_id", F.sha2(X.squeeze(X.strip_html(F.col("text"))), 256).alias("digest"), F.length(X.squeeze(X.strip_html(F.col("text")))).alias("n_chars"))


def html_markdown(spark, d):
    return load(spark, d, "documents").select("doc_id", X.to_markdown("text").alias("markdown"))


def redact_counts(spark, d):
    return load(spark, d, "documents").select("doc_id", *X.redaction_counts(F.coalesce("text", F.lit(""))), F.length(X.redact(F.col("text"))).alias("n_chars_left"))


def intent_route(spark, d):
    return load(spark, d, "turn_input_payloads").select("payload_id", "content").distinct().select("payload_id", X.intent(F.col("content")).alias("intent"))


def goal_masks(spark, d):
    return load(spark, d, "documents").select("doc_id", X.mask_names(F.col("title")).alias("goal"), F.size(X.near_paths(F.col("source"))).alias("n_near"))


def chunk_text(spark, d):
    cut = load(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 2000)).alias("pos", "chunk"))
    return cut.select("doc_id", "pos", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


def truncated_texts(spark, d):
    cut = X.truncate(F.col("text"), 500)
    return load(spark, d, "documents").select("doc_id", F.length(cut).alias("n_chars"), F.sha2(cut, 256).alias("digest"), X.token_estimate(F.col("text")).alias("tokens"))


def failure_families(spark, d):
    rows = events(spark, d, "event_type", "status", "tool_name", "stop_reason").filter("status in ('error', 'timeout', 'blocked', 'failed')")
    return rows.groupBy(X.failure_family(F.concat_ws(" ", "event_type", "status"), F.col("stop_reason")).alias("family")).agg(F.count("*").alias("n"))


def _messages(spark, d: str) -> DataFrame:
    sent = load(spark, d, "turn_input_payloads").select("payload_id", "event_id", F.lower(F.trim("role")).alias("role"), F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes")).distinct()
    at = unique_events(load(spark, d, "audit_events"), "session_key", "occurred_at", "segment_sequence").filter("session_key is not null")
    return sent.join(at, "event_id").select("session_key", F.col("payload_id").alias("message_id"), "role", "occurred_at", "segment_sequence", F.greatest(F.lit(4), F.col("bytes") + 4).alias("tokens"))


_ORDER = ["occurred_at", "segment_sequence", "message_id"]


def history_suffix(spark, d):
    return H.last_messages(_messages(spark, d), "session_key", _ORDER, 3).select("session_key", "message_id")


def history_token_budget(spark, d):
    return H.within_budget(_messages(spark, d), "session_key", _ORDER, F.col("tokens"), BUDGET).select("session_key", "message_id", "tokens_upto")


def history_window(spark, d):
    return H.history_window(_messages(spark, d), "session_key", _ORDER, F.col("tokens"), 3 * BUDGET, 5).select("session_key", "message_id")


def history_with_system(spark, d):
    return H.history_window(_messages(spark, d), "session_key", _ORDER, F.col("tokens"), 3 * BUDGET, 5, keep_system=True).select("session_key", "message_id")


def consolidation_boundary(spark, d):
    return H.consolidation_boundary(_messages(spark, d), "session_key", _ORDER[:2], F.col("tokens"), BUDGET)


def _calls(spark, d: str, kind: str) -> DataFrame:
    rows = events(spark, d, "event_type", "tool_call_id", "occurred_at").filter(F.col("event_type") == kind).filter("tool_call_id is not null")
    return rows.select(F.col("tool_call_id").alias("call_id"), F.col("occurred_at").alias("at"), "event_id")


def orphan_tool_results(spark, d):
    return H.orphan_results(_calls(spark, d, "tool_started"), _calls(spark, d, "tool_finished")).select("call_id", "event_id")


def missing_tool_results(spark, d):
    return H.missing_results(_calls(spark, d, "tool_started"), _calls(spark, d, "tool_finished")).select("call_id", "event_id")


def retain_last_k(spark, d):
    return H.newest_by_key(events(spark, d, "model", "occurred_at", "event_type").filter("event_type = 'model_request_failed'"), ["model"], ["occurred_at", "event_id"], 3).select("model", "event_id")


def latest_wins(spark, d):
    rows = load(spark, d, "tombstones").select("object_type", "object_id", "tombstone_id", "deleted_at")
    return H.newest_by_key(rows, ["object_type", "object_id"], ["deleted_at", "tombstone_id"]).select("object_type", "object_id", "tombstone_id")


def asof_recovery(spark, d):
    ended = events(spark, d, "event_type", "run_id", "session_key", "occurred_at", "status", "source_type").filter("event_type = 'run_finished' and run_id is not null")
    runs = ended.groupBy("run_id").agg(F.min("session_key").alias("session_key"), F.min("occurred_at").alias("at"), F.min("status").alias("status"), F.min("source_type").alias("family"))
    return V.recoveries(runs.withColumnRenamed("run_id", "id"))


def interval_spawn(spark, d):
    return V.spawned_between(events(spark, d, "event_type", "tool_name", "run_id", "parent_run_id", "occurred_at", "segment_sequence"))


def recovery_review(spark, d):
    rows = events(spark, d, "event_type", "status", "tool_name", "source_type", "session_key").filter("event_type = 'tool_finished' and status in ('error', 'timeout', 'blocked')")
    return V.repeated_groups(rows, ["tool_name", "status", "source_type"], 3, 2)


def reference_integrity(spark, d):
    return V.reference_integrity(events(spark, d, "payload_id"), load(spark, d, "turn_input_payloads"))


def sequence_faults(spark, d):
    return V.sequence_faults(events(spark, d, "process_instance_id", "segment_id", "segment_sequence").filter("segment_id is not null"), ["process_instance_id", "segment_id"], "segment_sequence")


def split_assign(spark, d):
    cases = load(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return V.assign_splits(cases, "doc_id", "source").select("doc_id", "source", "split")


def holdout_gate(spark, d):
    rows = split_assign(spark, d).join(load(spark, d, "documents").select("doc_id", (F.col("n_chars") / 3000).alias("score"), F.col("lang").isNull().alias("violation")), "doc_id")
    return V.holdout_gate(rows.withColumn("score", F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))), "source", 0.4)


def replay_consistency(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("lang").isNull().alias("violation"))
    return V.replay_consistency(rows, rows.withColumn("violation", F.col("violation") & (F.col("doc_id") % 7 != 0)), "doc_id")


def answer_scores(spark, d):
    return load(spark, d, "documents").select("doc_id", V.answer_score(F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))).alias("score"))


def session_debounce(spark, d):
    rows = events(spark, d, "session_key", "occurred_at").filter("session_key is not null")
    return V.session_debounce(rows, "session_key", "occurred_at", 45)


QUERIES = {
    f.__name__: f
    for f in (
        term_match_rank, term_match_all, bm25_topk, token_budget_pack, grep_content, grep_count, grep_context, line_window, html_strip, html_markdown, redact_counts, intent_route, goal_masks, chunk_text,
        truncated_texts, failure_families, history_suffix, history_token_budget, history_window, history_with_system, consolidation_boundary, orphan_tool_results, missing_tool_results, retain_last_k, latest_wins, asof_recovery, interval_spawn,
        recovery_review, reference_integrity, sequence_faults, split_assign, holdout_gate, replay_consistency, answer_scores, session_debounce,
    )
}

_TERMS = R.terms_of(QUERY)
_HAY = "lower(coalesce(title, '') || ' ' || coalesce(text, ''))"
_HITS = " + ".join(f"CAST(contains({_HAY}, '{t}') AS INTEGER)" for t in _TERMS)
_FRESH = f"coalesce(1.0 / (1.0 + greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at AT TIME ZONE 'UTC')) / 86400e6) / 30.0), 0.0)"
_RANK = f"""r AS (SELECT doc_id AS id, round(0.2 + ({_HITS}) / CAST({len(_TERMS)} AS DOUBLE) + 0.15 * ({_FRESH}) + 0.1 * 0.5, 6) AS score, round({_FRESH}, 6) AS freshness FROM documents
  WHERE ({_HITS}) > 0 ORDER BY score DESC, freshness DESC, id LIMIT 20)"""
_LINES = r"SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS line_no FROM documents"
_MESSAGES = f"""{EVENTS}, m AS (SELECT e.session_key, p.payload_id AS message_id, p.role, e.occurred_at, e.segment_sequence, greatest(4, p.bytes + 4) AS tokens
  FROM (SELECT DISTINCT payload_id, event_id, lower(trim(role)) AS role, coalesce(octet_length(encode(content)), 0) AS bytes FROM turn_input_payloads) p JOIN e USING (event_id) WHERE e.session_key IS NOT NULL)"""
_NEWEST = "PARTITION BY session_key ORDER BY occurred_at DESC, segment_sequence DESC, message_id DESC"
_OLDEST = "PARTITION BY session_key ORDER BY occurred_at, segment_sequence, message_id"
_SPLIT = """s AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY sha256(coalesce(source, '') || '|' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY coalesce(source, '')) AS n FROM documents),
 t AS (SELECT *, CASE WHEN n < 3 THEN n WHEN n = 3 THEN 1 ELSE n // 2 END AS a, CASE WHEN n < 3 THEN 0 WHEN n = 3 THEN 1 ELSE (n - n // 2) // 2 END AS b FROM s),
 split AS (SELECT doc_id, source, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'holdout' END AS split FROM t)"""


def _intent_sql() -> str:
    whens = []
    for name, words in X.INTENTS:
        tests = [f"contains(t, '{w}')" if any("一" <= c <= "鿿" for c in w) else f"regexp_matches(t, '(^|[^a-z0-9_]){w}($|[^a-z0-9_])')" for w in words]
        whens.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"SELECT payload_id, CASE {' '.join(whens)} ELSE 'task' END AS intent FROM (SELECT DISTINCT payload_id, content, lower(trim(coalesce(content, ''))) AS t FROM turn_input_payloads)"


_BM25_WORDS = "w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT id, len(w) AS n" + "".join(
    f", len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(sorted(set(_TERMS)))
) + " FROM w), k AS (SELECT count(*) AS docs, avg(n) AS mean" + "".join(f", count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(set(_TERMS)))) + " FROM c)"
_BM25 = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {R.K1 + 1} / (tf{i} + {R.K1} * (1 - {R.B} + {R.B} * n / mean))" for i in range(len(set(_TERMS))))

SQL = {
    "term_match_rank": f"WITH {_RANK} SELECT * FROM r",
    "term_match_all": f"SELECT doc_id AS id FROM documents WHERE ({_HITS}) = {len(_TERMS)}",
    "bm25_topk": f"WITH {_BM25_WORDS} SELECT id, round({_BM25}, 6) AS score FROM c, k WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(set(_TERMS))))} ORDER BY score DESC, id LIMIT 20",
    "token_budget_pack": f"""WITH {_RANK}, u AS (SELECT id, CAST(sum(greatest(4, octet_length(encode(coalesce(text, ''))) + 4)) OVER (ORDER BY score DESC, freshness DESC, id) AS BIGINT) AS tokens_upto FROM r JOIN documents ON doc_id = id)
  SELECT id, tokens_upto FROM u WHERE tokens_upto <= {PACK_BUDGET}""",
    "grep_content": rf"SELECT doc_id, line_no, line FROM ({_LINES}) WHERE regexp_matches(line, 'lease \d+ still held')",
    "grep_count": f"SELECT doc_id, count(*) AS n_lines FROM ({_LINES}) WHERE contains(lower(line), 'token budget') GROUP BY 1",
    "grep_context": f"""WITH l AS ({_LINES}), f AS (SELECT *, contains(line, 'WARN gateway') AS is_match FROM l)
  SELECT doc_id, line_no, line, is_match FROM (SELECT *, bool_or(is_match) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM f) WHERE near""",
    "line_window": f"SELECT * FROM (SELECT doc_id, line_no, line, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS chars_upto FROM ({_LINES}) WHERE line_no BETWEEN 3 AND 7) WHERE chars_upto <= 400",
    "redact_counts": r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+')) AS n_bearer, len(regexp_extract_all(coalesce(text, ''), '\bsk-[A-Za-z0-9_-]{16,}\b')) AS n_sk_key,
  len(regexp_extract_all(coalesce(text, ''), '\b(?:AKIA|ASIA)[A-Z0-9]{16}\b')) AS n_aws_access_key,
  length(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', '[REDACTED]', 'g'), '\bsk-[A-Za-z0-9_-]{16,}\b', '[REDACTED]', 'g'), '\b(?:AKIA|ASIA)[A-Z0-9]{16}\b', '[REDACTED]', 'g')) AS n_chars_left FROM documents""",
    "intent_route": _intent_sql(),
    "truncated_texts": "SELECT doc_id, CASE WHEN length(text) > 500 THEN 516 ELSE length(text) END AS n_chars, sha256(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '... (truncated)' ELSE text END) AS digest, greatest(4, coalesce(octet_length(encode(text)), 0) + 4) AS tokens FROM documents",
    "history_suffix": f"""WITH {_MESSAGES}, n AS (SELECT *, row_number() OVER ({_NEWEST}) AS r FROM m), u AS (SELECT session_key, min(r) FILTER (WHERE role = 'user') AS first_user FROM n GROUP BY 1)
  SELECT session_key, message_id FROM n JOIN u USING (session_key) WHERE r <= greatest(3, coalesce(first_user, 0))""",
    "history_window": f"""WITH {_MESSAGES}, n AS (SELECT session_key, message_id, role, sum(tokens) OVER ({_NEWEST}) AS upto, row_number() OVER ({_NEWEST}) AS r FROM m),
  k AS (SELECT *, max(r) FILTER (WHERE role = 'user') OVER (PARTITION BY session_key) AS u FROM n WHERE (upto <= {3 * BUDGET} OR r = 1) AND r <= 5) SELECT session_key, message_id FROM k WHERE u IS NULL OR r <= u""",
    "history_with_system": f"""WITH {_MESSAGES}, s AS (SELECT session_key, sum(tokens) AS used FROM m WHERE role = 'system' GROUP BY 1),
  n AS (SELECT session_key, message_id, role, sum(tokens) OVER ({_NEWEST}) AS upto, row_number() OVER ({_NEWEST}) AS r FROM m WHERE role IS NULL OR role <> 'system'),
  k AS (SELECT *, max(r) FILTER (WHERE role = 'user') OVER (PARTITION BY session_key) AS u FROM n LEFT JOIN s USING (session_key) WHERE (upto <= {3 * BUDGET} - coalesce(used, 0) OR r = 1) AND r <= 5)
  SELECT session_key, message_id FROM k WHERE u IS NULL OR r <= u UNION ALL SELECT session_key, message_id FROM m WHERE role = 'system'""",
    "history_token_budget": f"""WITH {_MESSAGES}, n AS (SELECT session_key, message_id, CAST(sum(tokens) OVER ({_NEWEST}) AS BIGINT) AS tokens_upto, row_number() OVER ({_NEWEST}) AS r FROM m) SELECT session_key, message_id, tokens_upto FROM n WHERE tokens_upto <= {BUDGET} OR r = 1""",
    "consolidation_boundary": f"""WITH {_MESSAGES}, n AS (SELECT *, row_number() OVER ({_OLDEST}) AS r, coalesce(sum(tokens) OVER ({_OLDEST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
  u AS (SELECT session_key, min(r) FILTER (WHERE before >= {BUDGET}) AS enough_at, max(r) AS last_at FROM n WHERE role = 'user' AND r > 1 GROUP BY 1)
  SELECT u.session_key, n.message_id AS boundary_id, enough_at IS NOT NULL AS enough FROM u JOIN n ON n.session_key = u.session_key AND n.r = coalesce(enough_at, last_at)""",
    "orphan_tool_results": f"""WITH {EVENTS}, c AS (SELECT tool_call_id, min(occurred_at) AS t FROM e WHERE event_type = 'tool_started' AND tool_call_id IS NOT NULL GROUP BY 1)
  SELECT e.tool_call_id AS call_id, event_id FROM e LEFT JOIN c USING (tool_call_id) WHERE event_type = 'tool_finished' AND e.tool_call_id IS NOT NULL AND (c.t IS NULL OR c.t >= e.occurred_at)""",
    "missing_tool_results": f"""WITH {EVENTS} SELECT tool_call_id AS call_id, event_id FROM e WHERE event_type = 'tool_started' AND tool_call_id IS NOT NULL
  AND tool_call_id NOT IN (SELECT tool_call_id FROM e WHERE event_type = 'tool_finished' AND tool_call_id IS NOT NULL)""",
    "retain_last_k": f"WITH {EVENTS} SELECT model, event_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY occurred_at DESC, event_id DESC) AS r FROM e WHERE event_type = 'model_request_failed') WHERE r <= 3",
    "latest_wins": "SELECT object_type, object_id, tombstone_id FROM (SELECT *, row_number() OVER (PARTITION BY object_type, object_id ORDER BY deleted_at DESC, tombstone_id DESC) AS r FROM tombstones) WHERE r = 1",
    "asof_recovery": f"""WITH {EVENTS}, r AS (SELECT run_id AS id, min(session_key) AS session_key, min(occurred_at) AS t, min(status) AS status, min(source_type) AS family FROM e WHERE event_type = 'run_finished' AND run_id IS NOT NULL GROUP BY 1),
  l AS (SELECT g.id, g.t, g.family, b.id AS bad, b.t AS bt, b.family AS bf, row_number() OVER (PARTITION BY g.id ORDER BY b.t DESC, b.id DESC) AS nr FROM r g JOIN r b ON b.session_key = g.session_key AND b.t <= g.t AND b.t >= g.t - INTERVAL 120 MINUTE
    WHERE g.status = 'succeeded' AND b.status IN ('failed', 'interrupted', 'exhausted'))
  SELECT id AS run_id, bad AS failed_run_id, date_diff('millisecond', bt, t) AS lag_ms FROM l WHERE nr = 1 AND family IS NOT DISTINCT FROM bf""",
    "interval_spawn": f"""WITH {EVENTS}, g AS (SELECT *, lead(occurred_at) OVER (PARTITION BY run_id ORDER BY occurred_at, segment_sequence, event_id) AS to_at FROM e WHERE run_id IS NOT NULL),
  i AS (SELECT c.run_id, c.parent_run_id, g.event_id FROM e c JOIN g ON g.run_id = c.parent_run_id AND c.occurred_at > g.occurred_at AND (g.to_at IS NULL OR c.occurred_at < g.to_at)
    WHERE c.event_type = 'run_started' AND g.event_type = 'tool_finished' AND g.tool_name = 'spawn')
  SELECT run_id, parent_run_id, min(event_id) AS spawn_event_id FROM i GROUP BY 1, 2 HAVING count(*) = 1""",
    "recovery_review": f"""WITH {EVENTS} SELECT tool_name, status, source_type, count(*) AS episodes, count(DISTINCT session_key) AS sessions, sha256(coalesce(tool_name, '') || '|' || status || '|' || coalesce(source_type, '')) AS group_id FROM e
  WHERE event_type = 'tool_finished' AND status IN ('error', 'timeout', 'blocked') GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count(DISTINCT session_key) >= 2""",
    "reference_integrity": """WITH a AS (SELECT payload_id, min(event_id) AS x FROM audit_events WHERE payload_id IS NOT NULL GROUP BY 1), b AS (SELECT payload_id, min(event_id) AS y FROM turn_input_payloads WHERE payload_id IS NOT NULL GROUP BY 1)
  SELECT * FROM (SELECT payload_id, CASE WHEN y IS NULL AND x IS NOT NULL THEN 'missing_payload' WHEN x IS NULL THEN 'orphan_payload' WHEN x <> y THEN 'wrong_event' END AS verdict FROM a FULL JOIN b USING (payload_id)) WHERE verdict IS NOT NULL""",
    "sequence_faults": f"""WITH {EVENTS}, p AS (SELECT process_instance_id, segment_id, segment_sequence AS s, count(*) AS n FROM e WHERE segment_id IS NOT NULL GROUP BY 1, 2, 3),
  g AS (SELECT *, s - coalesce(lag(s) OVER (PARTITION BY process_instance_id, segment_id ORDER BY s), 0) <> 1 AS gap FROM p)
  SELECT process_instance_id, segment_id, CAST(sum(n) AS BIGINT) AS n_rows, coalesce(first(CASE WHEN gap THEN 'sequence_gap' ELSE 'duplicate_sequence' END ORDER BY s) FILTER (WHERE gap OR n > 1), 'valid') AS verdict, min(s) FILTER (WHERE gap OR n > 1) AS at_sequence FROM g GROUP BY 1, 2""",
    "split_assign": f"WITH {_SPLIT} SELECT doc_id, source, split FROM split",
    "holdout_gate": f"""WITH {_SPLIT}, x AS (SELECT split.source, split, least(1.0, coalesce(n_chars / 3000.0, 0.0)) AS score, lang IS NULL AS violation FROM split JOIN documents USING (doc_id)),
  g AS (SELECT source, round(avg(CAST(score AS DOUBLE)) FILTER (WHERE split = 'holdout'), 6) AS holdout_score, bool_or(violation) AS any_violation FROM x GROUP BY 1) SELECT *, coalesce(holdout_score >= 0.4 AND NOT any_violation, false) AS passed FROM g""",
    "replay_consistency": "SELECT n_keys, n_different, CASE WHEN n_different = 0 THEN 'consistent' ELSE 'inconsistent' END AS verdict FROM (SELECT count(*) AS n_keys, count(*) FILTER (WHERE lang IS NULL AND doc_id % 7 = 0) AS n_different FROM documents)",
    "session_debounce": f"""WITH {EVENTS}, o AS (SELECT session_key, occurred_at AS t, CASE WHEN occurred_at - lag(occurred_at) OVER w < INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS new FROM e WHERE session_key IS NOT NULL WINDOW w AS (PARTITION BY session_key ORDER BY occurred_at)),
  i AS (SELECT *, sum(new) OVER (PARTITION BY session_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS nr FROM o) SELECT session_key, min(t) AS first_at, max(t) + INTERVAL 45 MINUTE AS due_at, count(*) AS n FROM i GROUP BY session_key, nr""",
}

_CHUNK_END = "CASE WHEN length(rest) <= 2000 THEN length(rest) " + " ".join(
    f"WHEN instr(reverse(substr(rest, 1, 2000)), {c}) BETWEEN 1 AND 1999 THEN 2000 - instr(reverse(substr(rest, 1, 2000)), {c})" for c in ("chr(10)", "' '")
) + " ELSE 2000 END"
_DECODED = "t"
for _entity, _char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
    _DECODED = f"replace({_DECODED}, '{_entity}', {_char})"
SQL |= {
    "html_strip": rf"""WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', '', 'g') AS t
    FROM documents),
  q AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_DECODED}, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM h)
  SELECT doc_id, sha256(t) AS digest, length(t) AS n_chars FROM q""",
    "chunk_text": f"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS pos, text AS rest FROM documents WHERE text IS NOT NULL AND text <> ''
    UNION ALL SELECT doc_id, pos + 1, regexp_replace(substr(rest, {_CHUNK_END} + 1), '^[\\s]+', '') FROM c WHERE length(rest) > 2000)
  SELECT doc_id, pos, {_CHUNK_END} AS n_chars, sha256(substr(rest, 1, {_CHUNK_END})) AS digest FROM c WHERE rest <> ''""",
    "goal_masks": r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[\w./-]+\.[A-Za-z0-9]{1,8}\b', '<file>', 'g'), '\d{4}-\d{2}-\d{2}|\d{4,}', '<id>', 'g'), '\s+', ' ', 'g'))) AS goal,
  CASE WHEN source IS NULL THEN NULL ELSE greatest(len(string_split(source, '/')) - 1, 1) END AS n_near FROM documents""",
    "failure_families": f"""WITH {EVENTS.replace("process_instance_id, segment_id", "stop_reason, process_instance_id, segment_id")},
  f AS (SELECT lower(concat_ws(' ', event_type, status)) AS t, lower(trim(stop_reason)) AS s FROM e WHERE status IN ('error', 'timeout', 'blocked', 'failed'))
  SELECT CASE {' '.join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{n}'" for n, words in X.FAILURES)}
    WHEN s = 'tool_error' THEN 'tool_exception' WHEN s = 'error' THEN 'agent_exception' ELSE 'unknown_failure' END AS family, count(*) AS n FROM f GROUP BY 1""",
    "answer_scores": r"""WITH a AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS x, lower(trim(coalesce(title, ''))) AS y FROM documents),
  w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(y, '\s+'), lambda z: z <> '')) AS yw, list_distinct(list_filter(regexp_split_to_array(x, '\s+'), lambda z: z <> '')) AS xw FROM a)
  SELECT doc_id, CAST(CASE WHEN y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(x, y) THEN 0.8 WHEN len(list_intersect(yw, xw)) / CAST(len(yw) AS DOUBLE) >= 0.5 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM w""",
}
