"""Listings of traces and sessions with stable keyset paging, filters over whole groups, and derived status."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.neighbours import with_neighbours
from loomtrace.operators.stats import zero

# Integrity from best to worst, and the order in which a display status is decided.
INTEGRITY = ("valid", "degraded", "incomplete", "unknown", "invalid")
ABNORMAL = ("error", "timeout", "blocked")
INBOUND = ("user", "websocket")


def encode_cursor(last_seen: str, key: str) -> str:
    """An opaque cursor of the last row of a page."""
    return base64.urlsafe_b64encode(f"{last_seen}\0{key}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, str]:
    """The parts of :func:`encode_cursor`; ValueError for anything else."""
    try:
        last_seen, key = base64.urlsafe_b64decode(cursor.encode()).decode().split("\0")
    except ValueError as e:
        raise ValueError("no valid cursor") from e
    return last_seen, key


def page(listing: DataFrame, key: str, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """At most ``limit`` rows by ``last_seen`` and ``key`` descending, those after the cursor's row. Pages never overlap.

    A plain predicate and a top-n: no sort of the whole listing, and no offset that grows with the page.
    """
    if after is not None:
        seen = F.lit(after[0]).cast("timestamp")
        listing = listing.filter((F.col("last_seen") < seen) | ((F.col("last_seen") == seen) & (F.col(key) < after[1])))
    return listing.orderBy(F.desc("last_seen"), F.desc(key)).limit(limit)


def having_any(events: DataFrame, key: str, **wanted: str) -> DataFrame:
    """Events of the groups in which for every wanted column some event has that value (one semi join each)."""
    for column, value in wanted.items():
        events = events.join(events.filter(F.col(column) == value).select(key).distinct(), key, "left_semi")
    return events


def overlapping(listing: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Groups whose interval from first to last event meets the range; their counts stay whole."""
    if since:
        listing = listing.filter(F.col("last_seen") >= F.lit(since).cast("timestamp"))
    return listing.filter(F.col("first_seen") <= F.lit(until).cast("timestamp")) if until else listing


def filter_listing(listing: DataFrame, status: str | None = None, anomalies_only: bool = False) -> DataFrame:
    """Rows of :func:`list_traces` with a display status, or with anomalies. Before the page is cut, so pages are full."""
    if status is not None:
        listing = listing.filter(F.col("display_status") == status)
    return listing.filter("anomaly_count > 0") if anomalies_only else listing


def with_suppressions(listing: DataFrame, unexpected: DataFrame) -> DataFrame:
    """A listing (``trace_id, anomaly_count, display_status``) with deliveries held back for no known reason: one anomaly more, and a
    trace that seemed to have succeeded is a warning. unexpected: ``trace_id`` (:func:`transcripts.unexpected_suppressions`)."""
    marked = listing.join(unexpected.select("trace_id").distinct().withColumn("_held", F.lit(1)), "trace_id", "left")
    status = F.when(F.col("_held").isNotNull() & (F.col("display_status") == "succeeded"), "warning").otherwise(F.col("display_status"))
    return marked.withColumn("anomaly_count", F.col("anomaly_count") + F.coalesce("_held", F.lit(0))).withColumn("display_status", status).drop("_held")


def search_summaries(summaries: DataFrame, outcomes: tuple[str, ...] = (), tool: str | None = None, limit: int = 50) -> DataFrame:
    """The traces of :func:`trace_summary` with one of the outcomes and a tool, those of most events first (a top-n)."""
    if outcomes:
        summaries = summaries.filter(F.col("outcome").isin(*outcomes))
    if tool is not None:
        summaries = summaries.filter(F.array_contains(F.split("tools", ","), tool))
    return summaries.orderBy(F.desc("event_count"), "trace_id").limit(limit)


def event_page(events: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """Of every ``key`` its events ``after + 1`` to ``after + limit`` in log order, with their ``position`` (from 1).

    The rank is bounded, so that only so many rows of a key are kept before they move.
    """
    order = Window.partitionBy(key).orderBy("occurred_at", "segment_sequence", "event_id")
    return events.withColumn("position", F.row_number().over(order)).filter((F.col("position") <= after + limit) & (F.col("position") > after))


def find_traces(events: DataFrame) -> DataFrame:
    """Per trace: first and last event, distinct turns and runs, and how its runs ended (sorted, comma separated)."""
    ended = F.when(F.col("event_type") == "run_finished", F.col("status"))
    return events.filter("trace_id is not null").groupBy("trace_id").agg(
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
        F.count_distinct("turn_id").alias("turn_count"),
        F.count_distinct("run_id").alias("run_count"),
        F.array_join(F.sort_array(F.collect_set(ended)), ",").alias("terminal_statuses"),
    )


def display_status(statuses: Column, active: Column, incomplete: Column, warning: Column) -> Column:
    """One status of a group from all of its own: the first that applies."""
    has = lambda *s: F.arrays_overlap(statuses, F.array(*map(F.lit, s)))
    return (
        F.when(active, "running").when(has("failed", "exhausted"), "failed").when(has("interrupted"), "interrupted").when(has("cancelled"), "cancelled").when(incomplete, "incomplete").when(warning, "warning").otherwise("succeeded")
    )


def anomaly(kind: Column, status: Column) -> Column:
    """Whether an event is an anomaly."""
    return F.coalesce(kind.startswith("orphan_") | (kind == "audit_degraded") | status.isin(*ABNORMAL), F.lit(False))


def open_runs(events: DataFrame) -> DataFrame:
    """Runs with a start and neither an end nor an orphan mark (two anti joins in one aggregate): ``run_id, started_at``."""
    kind = F.col("event_type")
    seen = events.filter(kind.isin("run_started", "run_finished", "orphan_run_detected") & F.col("run_id").isNotNull())
    runs = seen.groupBy("run_id").agg(F.min(F.when(kind == "run_started", F.col("occurred_at"))).alias("started_at"), F.max(F.when(kind != "run_started", 1)).alias("over"))
    return runs.filter("started_at is not null and over is null").select("run_id", "started_at")


def worst(status: Column) -> Column:
    """Aggregate: the worst integrity among rows, ``valid`` for none; an unknown word ranks as ``unknown``."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, INTEGRITY)), status), F.lit(4))
    return F.element_at(F.array(*map(F.lit, INTEGRITY)), F.coalesce(F.max(F.when(status.isNotNull(), rank)), F.lit(1)).cast("int"))


def process_integrity(events: DataFrame) -> DataFrame:
    """``process_instance_id, integrity`` from the log alone: ``degraded`` after a lost record, ``incomplete`` if never closed."""
    kind = F.col("event_type")
    by = events.filter("process_instance_id is not null").groupBy("process_instance_id").agg(F.max(kind == "audit_degraded").alias("lost"), F.max(kind == "process_instance_closed").alias("closed"))
    return by.select("process_instance_id", F.when(F.col("lost"), "degraded").when(~F.col("closed"), "incomplete").otherwise("valid").alias("integrity"))


def _per_trace(events: DataFrame) -> DataFrame:
    """One aggregate per (trace, run) and one per trace: open runs need no collected set of run ids."""
    kind = F.col("event_type")
    run = events.filter("trace_id is not null").groupBy("trace_id", "run_id").agg(
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
        F.count("*").alias("event_count"),
        F.max(F.coalesce(kind == "run_started", F.lit(False))).alias("started"),
        F.max(F.coalesce(kind == "run_finished", F.lit(False))).alias("finished"),
        F.max(F.coalesce(kind == "orphan_run_detected", F.lit(False))).alias("orphaned"),
        zero(F.sum(anomaly(kind, F.col("status")).cast("int"))).alias("anomaly_count"),
        F.collect_set("status").alias("statuses"),
        F.collect_set("source_type").alias("sources"),
        F.min("session_key").alias("session_key"),
        F.min(
            F.when(
                F.col("source_type").isNotNull(),
                F.struct(F.when(F.col("source_type").isin(*INBOUND), 0).when(F.col("source_type").isin("system", "delivery"), 2).otherwise(1).alias("p"), "occurred_at", "event_id", "source_type"),
            )
        ).alias("primary"),
    )
    return run


def list_traces(events: DataFrame) -> DataFrame:
    """Per trace: interval, counts, anomalies, display status, sources, primary source, title and integrity.

    Several per-trace look-ups of a row store become one aggregate; integrity comes from a join on the process.
    """
    run = _per_trace(events)
    open_run = F.col("started") & ~F.col("finished") & F.col("run_id").isNotNull()
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    trace = run.groupBy("trace_id").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("event_count").alias("event_count"),
        F.count("run_id").alias("run_count"),
        zero(F.sum("anomaly_count")).alias("anomaly_count"),
        F.max(open_run & ~F.col("orphaned")).alias("active"),
        F.max(open_run).alias("incomplete"),
        flat("statuses").alias("statuses"),
        flat("sources").alias("sources"),
        F.min("session_key").alias("session_key"),
        F.coalesce(F.min("primary")["source_type"], F.lit("system")).alias("primary_source"),
    )
    process = events.filter("trace_id is not null").select("trace_id", "process_instance_id").distinct()
    known = process.join(process_integrity(events), "process_instance_id", "left").groupBy("trace_id").agg(worst(F.col("integrity")).alias("integrity"))
    out = trace.join(known, "trace_id", "left")
    status = display_status(F.col("statuses"), F.col("active"), F.col("incomplete"), F.col("anomaly_count") > 0)
    return out.select(
        "trace_id", "first_seen", "last_seen", "event_count", "run_count", "anomaly_count", status.alias("display_status"),
        F.array_join("sources", ",").alias("sources"), "primary_source", "session_key", F.coalesce("integrity", F.lit("valid")).alias("integrity"),
        F.concat_ws(" / ", "primary_source", F.date_format("last_seen", "HH:mm"), F.substring("trace_id", 1, 8)).alias("title"),
    )


def list_sessions(events: DataFrame) -> DataFrame:
    """Per session: interval, traces, active, erroneous and warned traces, the latest trace, and the worst integrity of its processes.
    Aggregates only, no list of events."""
    keyed = events.filter("session_key is not null and session_key <> '' and trace_id is not null")
    status = F.col("status")
    trace = keyed.groupBy("session_key", "trace_id").agg(
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
        F.max(F.coalesce(status.isin("failed", "exhausted"), F.lit(False))).alias("failed"),
        F.max(F.coalesce(status.isin(*ABNORMAL), F.lit(False))).alias("warned"),
    )
    active = keyed.select("session_key", "trace_id", "run_id").distinct().join(open_runs(events).select("run_id"), "run_id", "left_semi").select("session_key", "trace_id").distinct().withColumn("active", F.lit(1))
    process = keyed.select("session_key", "process_instance_id").distinct().join(process_integrity(events), "process_instance_id")
    integrity = process.groupBy("session_key").agg(worst(F.col("integrity")).alias("integrity"))
    listed = (
        trace.join(active, ["session_key", "trace_id"], "left")
        .groupBy("session_key")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.count("*").alias("trace_count"),
            F.count("active").alias("active_trace_count"),
            zero(F.sum(F.col("failed").cast("int"))).alias("error_count"),
            zero(F.sum((~F.col("failed") & F.col("warned")).cast("int"))).alias("warning_count"),
            F.max(F.struct("last_seen", "trace_id"))["trace_id"].alias("latest_trace_id"),
        )
    )
    return listed.join(integrity, "session_key", "left").withColumn("integrity", F.coalesce("integrity", F.lit("valid")))


def first_anomaly(events: DataFrame) -> DataFrame:
    """Per trace its earliest qualifying event: ``trace_id, event_id, category``."""
    kind, status = F.col("event_type"), F.col("status")
    bad = kind.startswith("orphan_") | kind.isin("audit_degraded", "policy_blocked", "retry_scheduled") | F.coalesce(status.isin(*ABNORMAL, "failed", "exhausted"), F.lit(False))
    first = F.min(F.struct("occurred_at", "segment_sequence", "event_id", "event_type")).alias("f")
    return events.filter(bad & F.col("trace_id").isNotNull()).groupBy("trace_id").agg(first).select("trace_id", "f.event_id", F.col("f.event_type").alias("category"))


def trace_summary(events: DataFrame) -> DataFrame:
    """Per trace: distinct tools and types, failures, and the outcome (last run end, else last turn end, else running)."""
    kind = F.col("event_type")
    end = lambda name: F.max(F.when((kind == name) & F.col("status").isNotNull(), F.struct("occurred_at", "event_id", "status")))["status"]
    return events.filter("trace_id is not null").groupBy("trace_id").agg(
        F.count("*").alias("event_count"),
        zero(F.count(F.when(kind == "tool_finished", 1))).alias("tool_count"),
        F.array_join(F.sort_array(F.collect_set("tool_name")), ",").alias("tools"),
        F.size(F.collect_set("event_type")).alias("type_count"),
        zero(F.sum(anomaly(kind, F.col("status")).cast("int"))).alias("failure_count"),
        F.coalesce(end("run_finished"), end("turn_finished"), F.lit("running")).alias("outcome"),
        F.greatest(F.coalesce(F.max("elapsed_ms"), F.unix_millis(F.max("occurred_at")) - F.unix_millis(F.min("occurred_at"))), F.lit(0)).alias("elapsed_ms"),
    )


def sequence_edges(events: DataFrame) -> DataFrame:
    """Within each run the step from every event to the next one: ``run_id, source, target, gap_ms``. No task orders a whole run."""
    rows = events.filter("run_id is not null").select("run_id", "event_id", "occurred_at", "segment_sequence")
    near = with_neighbours(rows, ["run_id"], ["occurred_at", "segment_sequence", "event_id"], ["event_id", "occurred_at"]).filter("has_next")
    return near.select("run_id", F.col("event_id").alias("source"), F.col("next_event_id").alias("target"), (F.unix_millis("next_occurred_at") - F.unix_millis("occurred_at")).alias("gap_ms"))


def collapse_groups(events: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` neighbouring successful tool calls in a run, as one row each (gaps and islands)."""
    by_run = Window.partitionBy("run_id").orderBy("occurred_at", "segment_sequence", "event_id")
    tools = events.filter("run_id is not null and event_type = 'tool_finished'")
    numbered = tools.withColumn("at", F.row_number().over(by_run)).filter("status = 'ok'")
    islands = numbered.withColumn("island", F.col("at") - F.row_number().over(by_run))
    grouped = islands.groupBy("run_id", "island").agg(F.count("*").alias("members"), F.min("at").alias("first_at"), zero(F.sum("elapsed_ms")).alias("elapsed_ms"))
    return grouped.filter(F.col("members") >= least).drop("island")
