"""Queries of the operators over messages and documents (problems 2, 4, 5, 7, 8 and 9) and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import conversations, packing, pii, quantiles, spam, tokens
from loomtrace.session import written
from loomtrace.sources.tables import load


#: The percentiles of the reports.
FRACTIONS = (0.01, 0.25, 0.5, 0.75, 0.9, 0.99)
#: Leading binary digits kept in the bounded-error form: values are off by at most 2^-10.
BITS = 10


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles (error bound 0) of the days' exact summaries put together."""
    days = quantiles.summaries(quantiles.log_values(load(spark, d, "audit_events")))
    return quantiles.multi_select(quantiles.combine(days), FRACTIONS)


def p2_daily_summary(spark: SparkSession, d: str) -> DataFrame:
    """The form that combines: counts of value buckets per group and day."""
    return quantiles.summaries(quantiles.log_values(load(spark, d, "audit_events")), BITS)


def p2_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with bounds from the combined bounded-error summaries of all days."""
    return quantiles.with_bounds(quantiles.multi_select(quantiles.combine(p2_daily_summary(spark, d)), FRACTIONS), BITS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(load(spark, d, "turn_input_payloads"), load(spark, d, "audit_events"))[1]


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.kept_messages(load(spark, d, "turn_input_payloads"), load(spark, d, "audit_events"))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    # Rows of a payload_id repeat as they are: one of each is read.
    messages = load(spark, d, "turn_input_payloads").select("payload_id", "content").distinct()
    return pii.find_and_replace(messages, lexicon_path=f"{tokens.VOCABULARIES}/byte_bpe_50k.json")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("payload_id", F.explode("pii_types").alias("pii_type")).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("payload_id", "content")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_windows(tokens.count_tokens(load(spark, d, "documents")))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).drop("first_window_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(written(_windows(spark, d)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.page_features(load(spark, d, "documents")).filter("is_spam").select("doc_id")


def p9_features(spark: SparkSession, d: str) -> DataFrame:
    return spam.page_features(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_daily_summary, p2_combined, p4_found, p4_conversations, p5_found, p5_redacted, p7_ids, p8_windows, p8_fill, p9_found, p9_features)}

_U = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_REF = rf"lower(regexp_replace(event_id, '^\s*(?:urn:uuid:)?\s*(?:\{{\s*(?:urn:uuid:)?({_U})\s*\}}|({_U}))\s*$', '\1\2', 'i'))"
_UNSEEN = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
_PLACED = rf"""
WITH once AS (
  SELECT payload_id, any_value(trim({_REF})) AS event_id, any_value(role) AS role, any_value(content) AS content, any_value(media_refs) AS media_refs
  FROM turn_input_payloads WHERE payload_id IS NOT NULL AND event_id IS NOT NULL GROUP BY payload_id),
shown AS (
  SELECT *, lower(regexp_replace(role, '^{_UNSEEN}+|{_UNSEEN}+$', '', 'g')) AS r,
    CASE WHEN json_valid(content) AND json_type(content) = 'ARRAY' AND coalesce(list_bool_and(list_transform(json_extract(content, '$[*]'), lambda b: json_extract_string(b, '$.type') IS NOT NULL)), true)
      THEN array_to_string(list_transform(list_filter(json_extract(content, '$[*]'), lambda b: json_extract_string(b, '$.type') = 'text'), lambda b: coalesce(json_extract_string(b, '$.text'), '')), '')
      ELSE content END AS text
  FROM once),
spoken AS (
  SELECT payload_id, event_id,
    CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'bot', 'model') THEN 'assistant' WHEN r IN ('system', 'developer') THEN 'system'
      WHEN r IN ('tool', 'function') THEN 'tool' ELSE 'unknown' END AS role,
    len(coalesce(media_refs, [])) = 0 AND regexp_full_match(coalesce(text, ''), '{_UNSEEN}*') AS blank, content
  FROM shown),
ev AS (SELECT {_REF} AS event_id, any_value(turn_id) AS turn_id, any_value(occurred_at) AS occurred_at, any_value(segment_sequence) AS seq
  FROM audit_events WHERE turn_id IS NOT NULL GROUP BY 1),
turns AS (SELECT turn_id, min(session_key) AS session_key, min(occurred_at) AS turn_start FROM audit_events WHERE turn_id IS NOT NULL GROUP BY 1),
placed AS (
  SELECT session_key, turn_start, turn_id, occurred_at, seq, payload_id, role, blank, content
  FROM spoken JOIN ev USING (event_id) JOIN turns USING (turn_id) WHERE session_key IS NOT NULL),
left_over AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY turn_start, turn_id, occurred_at, seq, payload_id) - 1 AS position FROM placed WHERE NOT blank),
per_turn AS (
  SELECT session_key, turn_id, first(role ORDER BY position) FILTER (WHERE role <> 'system') AS opens,
    max(position) FILTER (WHERE role = 'user') AS last_user, max(position) FILTER (WHERE role = 'assistant') AS last_reply
  FROM left_over GROUP BY session_key, turn_id),
dropped AS (
  SELECT DISTINCT session_key FROM placed p WHERE
    session_key NOT IN (SELECT session_key FROM left_over WHERE role = 'user')
    OR session_key IN (SELECT session_key FROM left_over WHERE role = 'unknown')
    OR session_key IN (SELECT session_key FROM per_turn WHERE opens <> 'user' OR (last_user IS NOT NULL AND coalesce(last_reply, -1) < last_user)))
"""
def _name(column: str) -> str:
    return f"coalesce(nullif(lower(trim({column})), ''), '(none)')"


_VALUES = f"""
WITH once AS (SELECT DISTINCT event_id, {_name('model')} AS model, {_name('tool_name')} AS tool_name,
    CAST(occurred_at AT TIME ZONE 'UTC' AS DATE) AS day, elapsed_ms, total_tokens FROM audit_events),
vals AS (
  SELECT 'elapsed_ms' AS metric, 'model' AS dim, model AS grp, day, elapsed_ms AS value FROM once WHERE elapsed_ms IS NOT NULL
  UNION ALL SELECT 'elapsed_ms', 'tool_name', tool_name, day, elapsed_ms FROM once WHERE elapsed_ms IS NOT NULL
  UNION ALL SELECT 'total_tokens', 'model', model, day, total_tokens FROM once WHERE total_tokens IS NOT NULL
  UNION ALL SELECT 'total_tokens', 'tool_name', tool_name, day, total_tokens FROM once WHERE total_tokens IS NOT NULL)
"""
_PERCENTILES = f"""{_VALUES},
ranked AS (SELECT metric, dim, grp, value, row_number() OVER (PARTITION BY metric, dim, grp ORDER BY value) AS r, count(*) OVER (PARTITION BY metric, dim, grp) AS n FROM vals),
exact AS (
  SELECT metric, dim, grp, q, n, value FROM ranked, (SELECT unnest([{', '.join(map(str, FRACTIONS))}]) AS q)
  WHERE r = greatest(1, CAST(ceil(round(CAST(q AS DOUBLE) * n, 6)) AS BIGINT)))
"""
_DROP = f"greatest(0, length(format('{{:b}}', abs(value))) - {BITS})"
_LOW = f"(CASE WHEN value < 0 THEN -1 ELSE 1 END) * ((abs(value) >> CAST({_DROP} AS INTEGER)) << CAST({_DROP} AS INTEGER))"

SQL = {
    "p2_percentiles": f"{_PERCENTILES} SELECT metric, dim, grp, CAST(q AS DOUBLE) AS q, n, value FROM exact",
    "p2_daily_summary": f"{_VALUES} SELECT metric, dim, grp, day, {_LOW} AS value, count(*) AS n FROM vals GROUP BY 1, 2, 3, 4, 5",
    "p2_combined": f"{_PERCENTILES} SELECT metric, dim, grp, CAST(q AS DOUBLE) AS q, n, least(a, b) AS low, greatest(a, b) AS high, (least(a, b) + greatest(a, b)) / 2 AS estimate"
    f" FROM (SELECT *, {_LOW} AS a, {_LOW} + (CASE WHEN value < 0 THEN -1 ELSE 1 END) * ((CAST(1 AS BIGINT) << CAST({_DROP} AS INTEGER)) - 1) AS b FROM exact)",
    "p4_found": f"{_PLACED} SELECT session_key FROM dropped",
    "p4_conversations": f"{_PLACED} SELECT session_key, position, turn_id, payload_id, role, content FROM left_over WHERE session_key NOT IN (SELECT session_key FROM dropped)",
}
