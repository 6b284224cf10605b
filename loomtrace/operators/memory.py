"""Memory records, pages, cases, skills and traces searched as one; their revisions, deletions and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import redact
from loomtrace.operators.search import freshness, match_any, matched_terms, terms_of

# What a kind of source adds to the score, its authority, and the token budgets.
BASES = {"wiki": 0.2, "case": 0.2, "skill": 0.15, "trace": 0.1}
AUTHORITY = 0.5
LEAST_BUDGET, SOFT_BUDGET, HARD_BUDGET, WINDOW_SHARE = 128, 2_000, 3_000, 0.06


def budgets(context_window: int | None) -> tuple[int, int]:
    """``(soft, hard)`` token budgets for a model's window: 6 percent of it within the fixed bounds."""
    adaptive = max(LEAST_BUDGET, int(context_window * WINDOW_SHARE) if context_window else HARD_BUDGET)
    soft = min(SOFT_BUDGET, adaptive)
    return soft, min(HARD_BUDGET, max(soft, adaptive))


def current_revisions(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """Records with the text of their current revision; records whose revision is missing are left out."""
    return records.join(revisions.withColumnRenamed("revision_id", "current_revision_id"), "current_revision_id")


def linked(rows: DataFrame, others: DataFrame, key: str, **wanted: tuple) -> DataFrame:
    """Inner join by ``key`` with those of ``others`` whose columns have one of the values wanted (filtered before the join)."""
    for column, values in wanted.items():
        others = others.filter(F.col(column).isin(*values))
    return rows.join(others, key)


def not_deleted(rows: DataFrame, tombstones: DataFrame, object_type: str, key: str) -> DataFrame:
    """Rows that no tombstone of their type names."""
    gone = tombstones.filter(F.col("object_type") == object_type).select(F.col("object_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti")


def unexpired(rows: DataFrame, at: str, now: str) -> DataFrame:
    """Rows that never expire or expire after ``now``."""
    return rows.filter(F.col(at).isNull() | (F.col(at) > F.lit(now).cast("timestamp")))


def source_hits(rows: DataFrame, kind: str, query: str, now: str, before_match: int | None = None) -> DataFrame:
    """Hits of one source (``id, title, summary, updated``, for memory also ``effective_score, authority``).

    A memory record's score is its own effective score; the others score by matched terms. With ``before_match`` only so many
    newest rows are looked at (as the original does); without, a match can't be hidden by newer rows.
    """
    if before_match is not None:
        rows = rows.orderBy(F.desc("updated"), "id").limit(before_match)
    hay = F.concat_ws(" ", "title", "summary")
    fresh = freshness(F.col("updated"), now)
    terms = terms_of(query)
    if kind == "memory":
        own, authority = F.coalesce("effective_score", F.lit(0.0)), F.coalesce("authority", F.lit(0.0))
    else:
        own, authority = F.lit(BASES[kind]) + matched_terms(hay, terms) / F.lit(max(1, len(terms))), F.lit(AUTHORITY)
    hits = rows.filter(match_any(hay, query))
    return hits.select(F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("identifier"), F.lit(kind).alias("kind"), "title", "summary", F.round(own + 0.15 * fresh + 0.1 * authority, 6).alias("score"), F.round(fresh, 6).alias("freshness"))


def retrieve(sources: dict[str, DataFrame], query: str, now: str, limit: int = 20, before_match: int | None = None) -> DataFrame:
    """The best hits of all sources, one per identifier, by score, freshness and identifier."""
    hits = reduce(DataFrame.unionByName, [source_hits(rows, kind, query, now, before_match) for kind, rows in sources.items()])
    best = F.max(F.struct("score", "freshness", "title", "summary", "kind")).alias("b")
    return hits.groupBy("identifier").agg(best).select("identifier", "b.*").orderBy(F.desc("score"), F.desc("freshness"), "identifier").limit(limit)


def duplicates_of(cases: DataFrame, content_hash: str, signature: str, key: str) -> DataFrame:
    """``key, duplicate_of``: cases whose content or whose signature equals that of an earlier one (smallest key first).

    Two equi-joins by way of each group's smallest key instead of one join with an OR, so no group is paired with itself.
    """
    first = [cases.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(key).alias(f"_{c}")) for c in (content_hash, signature)]
    both = cases.join(first[0], content_hash, "left").join(first[1], signature, "left")
    earliest = F.least(F.col(f"_{content_hash}"), F.col(f"_{signature}"))
    return both.select(key, earliest.alias("duplicate_of")).filter(F.col("duplicate_of") < F.col(key))


def with_sample(issues: DataFrame, episodes: DataFrame, ids: str = "episode_ids") -> DataFrame:
    """Issues with the first of their episodes (left join on the first element of an array; an empty array has none)."""
    return issues.withColumn("episode_id", F.try_element_at(ids, F.lit(1))).join(episodes, "episode_id", "left")


def upsert_edges(edges: DataFrame, add: DataFrame, remove: DataFrame, keys: list[str]) -> DataFrame:
    """A relation table after adding and removing edges: an added edge replaces its old row, a removed one is gone."""
    kept = edges.join(add.select(*keys).unionByName(remove.select(*keys)).distinct(), keys, "left_anti")
    return kept.unionByName(add.join(remove.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys))


def due(queue: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    """Work that may be claimed: pending and due, or leased with an expired lease; oldest first by ``due_at, id``, up to ``limit``."""
    at = F.lit(now).cast("timestamp")
    ready = ((F.col("status") == "pending") & (F.col("due_at") <= at)) | ((F.col("status") == "leased") & (F.col("lease_until") < at))
    ready_rows = queue.filter(ready).orderBy("due_at", "id")
    return ready_rows if limit is None else ready_rows.limit(limit)


def illegal_transitions(actions: DataFrame, key: str, order: list[str], allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Status changes that the table of allowed ones doesn't have: ``key, from_status, to_status``."""
    steps = actions.withColumn("from_status", F.lag("status").over(Window.partitionBy(key).orderBy(*order)))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs])
    bad = F.col("from_status").isNotNull() & ~F.array_contains(pairs, F.concat_ws(">", "from_status", "status"))
    return steps.filter(bad).select(key, "from_status", F.col("status").alias("to_status"))


def quota_used(tables: list[DataFrame], key: str, at: str, day: str, zone: str = "UTC", amount: str | None = None) -> DataFrame:
    """How many rows of all tables fall on a local day, per key: ``key, used``, and with a column ``amount`` its sum."""
    rows = reduce(DataFrame.unionByName, [t.select(key, at, *([amount] if amount else [])) for t in tables])
    own = rows.filter(F.to_date(F.from_utc_timestamp(at, zone)) == F.lit(day).cast("date"))
    sums = [F.coalesce(F.sum(amount), F.lit(0)).alias("amount")] if amount else []
    return own.groupBy(key).agg(F.count("*").alias("used"), *sums)


def next_version(packs: DataFrame, key: str, document: str, path: str = "$.version") -> DataFrame:
    """One more than the largest version in the JSON documents of a key; 1 where there is none."""
    version = F.expr(f"try_cast(get_json_object({document}, '{path}') as bigint)")
    return packs.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def ab_gate(results: DataFrame, key: str, tolerance: float = 0.05, least: float = 0.85, cost: float = 0.15, latency: float = 0.20) -> DataFrame:
    """Per evaluation whether the candidate may replace the baseline: mean score not worse than the tolerance and at least the
    minimum, no violation, cost and latency within their growth. results: ``arm`` (baseline, candidate), ``score, tokens, ms, violation``."""
    arm = lambda name, c: F.avg(F.when(F.col("arm") == name, F.col(c)))
    growth = lambda c: arm("candidate", c) / F.nullif(arm("baseline", c), F.lit(0)) - 1
    out = results.groupBy(key).agg(
        F.round(arm("baseline", "score"), 6).alias("baseline_score"), F.round(arm("candidate", "score"), 6).alias("candidate_score"), F.max(F.coalesce("violation", F.lit(False))).alias("any_violation"),
        F.round(growth("tokens"), 6).alias("cost_growth"), F.round(growth("ms"), 6).alias("latency_growth"),
    )
    fine = (F.col("candidate_score") >= F.greatest(F.col("baseline_score") - tolerance, F.lit(least))) & ~F.col("any_violation")
    return out.withColumn("passed", F.coalesce(fine & (F.coalesce("cost_growth", F.lit(0.0)) <= cost) & (F.coalesce("latency_growth", F.lit(0.0)) <= latency), F.lit(False)))


def reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: the names of the rules that hold, in order (threshold checks), and ``reason``: the first of them."""
    held = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("reasons", held).withColumn("reason", F.try_element_at("reasons", F.lit(1)))


def retention_plan(rows: DataFrame, at: str, now: str, payload_days: int, trace_days: int) -> DataFrame:
    """What two cutoffs would remove (nothing is removed): ``action`` ``drop_trace``, ``drop_payload`` or ``keep``, per row."""
    age = F.datediff(F.lit(now).cast("timestamp"), F.col(at))
    return rows.withColumn("action", F.when(age > trace_days, "drop_trace").when(age > payload_days, "drop_payload").otherwise("keep"))


def read_payloads(payloads: DataFrame, events: DataFrame, content: str, digest: str, max_chars: int, max_bytes: int = 1 << 20) -> DataFrame:
    """Payloads as a reader may see them: ``payload_id, verdict, text, truncated``.

    verdict is ``unknown_event`` (no event names the payload and is its owner), ``too_large``, ``wrong_hash`` or ``intact``; only
    an intact one shows its text, without credentials and up to ``max_chars``. events: ``event_id, payload_id``.
    """
    owner = events.select("payload_id", "event_id").distinct().withColumn("_owned", F.lit(True))
    intact = F.concat(F.lit("sha256:"), F.sha2(content, 256)) == F.col(digest)
    verdict = F.when(F.col("_owned").isNull(), "unknown_event").when(F.octet_length(content) > max_bytes, "too_large").when(~F.coalesce(intact, F.lit(False)), "wrong_hash").otherwise("intact")
    shown = F.when(F.col("verdict") == "intact", redact(F.col(content)))
    rows = payloads.join(owner, ["payload_id", "event_id"], "left").withColumn("verdict", verdict).withColumn("_text", shown)
    return rows.select("payload_id", "verdict", F.substring("_text", 1, max_chars).alias("text"), F.coalesce(F.length("_text") > max_chars, F.lit(False)).alias("truncated"))


def load_payload(payloads: DataFrame, payload_id: str, content: str, digest: str, max_chars: int) -> DataFrame:
    """One payload by id with ``intact`` (its digest fits) and its text up to ``max_chars``; an intact one only is shown."""
    row = payloads.filter(F.col("payload_id") == payload_id)
    intact = F.concat(F.lit("sha256:"), F.sha2(content, 256)) == F.col(digest)
    return row.select("payload_id", intact.alias("intact"), F.when(intact, F.substring(content, 1, max_chars)).alias("text"), (F.length(content) > max_chars).alias("truncated"))


def with_retention(summaries: DataFrame, at: str, payload_days: int, trace_days: int, key: str) -> DataFrame:
    """Adds until when a trace and its payloads are kept, and a digest of the summary that tells whether it changed."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(summaries.columns) if c not in (key, at)]
    digest = F.sha2(F.concat_ws("|", *fields), 256)
    until = lambda days: F.timestamp_micros(F.unix_micros(at) + F.lit(days * 86_400_000_000))
    return summaries.withColumn("digest", digest).withColumn("payload_expire_at", until(payload_days)).withColumn("trace_expire_at", until(trace_days))


def sessions_by_project(sessions: DataFrame) -> DataFrame:
    """Sessions that are not archived, per project (trimmed, without a trailing slash): newest time, number, newest first."""
    project = F.regexp_replace(F.trim(F.coalesce("project", F.lit(""))), r"(?<=.)/+$", "")
    return sessions.filter(~F.coalesce("archived", F.lit(False))).groupBy(project.alias("project")).agg(F.max("updated").alias("updated"), F.count("*").alias("n")).orderBy(F.desc("updated"), "project")


def pending_calls(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Whether a transcript ends within a tool call: per key the last of its call and result events."""
    last = F.max(F.when(F.col("event").isin("tool_call", "tool_result", "turn_end"), F.struct(seq, "event")))["event"]
    return rows.groupBy(key).agg(F.coalesce(last == "tool_call", F.lit(False)).alias("pending"))
