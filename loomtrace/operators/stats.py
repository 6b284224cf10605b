"""Statistics of the event log by a column, and what follows from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = {"source": "source_type", "source_type": "source_type", "status": "status", "model": "model", "tool": "tool_name"}


def zero(total: Column) -> Column:
    """A sum with 0 for no rows."""
    return F.coalesce(total, F.lit(0)).cast("bigint")


def stats(events: DataFrame, group_by: str = "source_type") -> DataFrame:
    """Counts, distinct counts, conditional sums and the mean latency per value of a column; a missing value is ``unknown``.

    events: one row per event. The mean is null where no event has a latency. An unknown ``group_by`` raises ValueError.
    """
    if group_by not in GROUPS:
        raise ValueError(f"unsupported group: {group_by}")
    kind, status = F.col("event_type"), F.col("status")
    flag = lambda c: zero(F.sum(F.when(c, 1).otherwise(0)))
    return events.groupBy(F.coalesce(GROUPS[group_by], F.lit("unknown")).alias("group_name")).agg(
        F.count("*").alias("event_count"),
        F.count_distinct("trace_id").alias("trace_count"),
        F.count_distinct(F.when(kind == "run_started", F.col("run_id"))).alias("run_count"),
        flag((kind == "run_finished") & (status == "failed")).alias("error_count"),
        flag((kind == "run_finished") & (status == "cancelled")).alias("cancellation_count"),
        flag(kind == "iteration_started").alias("iteration_count"),
        *[zero(F.sum(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.round(F.avg("elapsed_ms"), 4).alias("average_latency_ms"),
    )


def lifecycle_cardinality(events: DataFrame) -> DataFrame:
    """Starts against ends per identity: ``span, identity, starts, ends, verdict`` for those that are not one to one at most.

    verdict ``lifecycle_cardinality``: not exactly one start, or several ends; ``open_span``: a start without an end.
    """
    spans = [
        ("run", "run_started", ("run_finished",), F.col("run_id")),
        ("iteration", "iteration_started", ("iteration_finished",), F.concat_ws("/", "run_id", F.col("iteration").cast("string"))),
        ("model_call", "model_request_started", ("model_response_received", "model_request_failed"), F.col("model_call_id")),
        ("model_attempt", "model_attempt_started", ("model_attempt_finished",), F.col("attempt_id")),
        ("tool_call", "tool_started", ("tool_finished",), F.col("tool_call_id")),
    ]
    kind = F.col("event_type")
    rows = F.filter(
        F.array(
            *[
                F.when(kind.isin(start, *ends), F.struct(F.lit(name).alias("span"), identity.alias("identity"), F.when(kind == start, 1).otherwise(0).alias("start")))
                for name, start, ends, identity in spans
            ]
        ),
        lambda x: x.isNotNull(),
    )
    counted = events.select(F.inline(rows)).groupBy("span", "identity").agg(zero(F.sum("start")).alias("starts"), zero(F.sum(1 - F.col("start"))).alias("ends"))
    verdict = F.when((F.col("starts") != 1) | (F.col("ends") > 1), "lifecycle_cardinality").when(F.col("ends") == 0, "open_span")
    return counted.filter("starts > 0").withColumn("verdict", verdict).filter("verdict is not null")


def daily_usage(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Tokens per local day and source of the session: ``day, source, requests`` and the token sums.

    Negative counts are 0; a total of 0 falls back to prompt plus completion; events that then have none are no requests.
    """
    key = F.coalesce("session_key", F.lit(""))
    source = (
        F.when(key.startswith("dream:"), "dream").when((key == "heartbeat") | key.startswith("cron:"), "cron").when(key.startswith("api:"), "api").when(key.startswith("system:"), "system").otherwise("user")
    )
    least = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    used = events.select(F.to_date(F.from_utc_timestamp("occurred_at", zone)).alias("day"), source.alias("source"), *[least(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
    used = used.withColumn("total_tokens", F.when(F.col("total_tokens") > 0, F.col("total_tokens")).otherwise(F.col("prompt_tokens") + F.col("completion_tokens")))
    return used.filter("total_tokens > 0").groupBy("day", "source").agg(F.count("*").alias("requests"), *[zero(F.sum(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def usage_summary(daily: DataFrame, today: str) -> DataFrame:
    """One row: totals of all, 30 and 365 days up to ``today``, the peak day, active days and requests of 30 days."""
    day = daily.groupBy("day").agg(F.sum("total_tokens").alias("tokens"), F.sum("requests").alias("requests"))
    now = F.lit(today).cast("date")
    within = lambda n: (F.col("day") <= now) & (F.col("day") > F.date_sub(now, n))
    return day.agg(
        zero(F.sum("tokens")).alias("total_tokens"),
        zero(F.sum(F.when(within(30), F.col("tokens")))).alias("total_tokens_30d"),
        zero(F.sum(F.when(within(365), F.col("tokens")))).alias("total_tokens_365d"),
        zero(F.max("tokens")).alias("peak_day_tokens"),
        zero(F.sum(F.when(within(30) & (F.col("tokens") > 0), 1))).alias("active_days_30d"),
        zero(F.sum(F.when(within(30), F.col("requests")))).alias("requests_30d"),
    )


def streaks(active: DataFrame, today: str, *keys: str) -> DataFrame:
    """Per key the current (ending ``today``, else 0) and the longest run of consecutive days of ``keys, day``.

    The days of a key are numbered over few rows: one per day it was active.
    """
    from pyspark.sql import Window

    days = active.select(*keys, "day").distinct()
    islands = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(*keys).orderBy("day"))))
    runs = islands.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("last") == F.lit(today).cast("date"), F.col("n"))), F.lit(0)).alias("current_streak_days"), F.max("n").alias("longest_streak_days"))


def operational_report(rows: DataFrame, since: str, until: str, created: str, status: str, good: str, bad: tuple[str, ...]) -> DataFrame:
    """One row of counts in ``[since, until)`` and their ratios, which are 0 where there is nothing to divide by."""
    inside = rows.filter((F.col(created) >= F.lit(since).cast("timestamp")) & (F.col(created) < F.lit(until).cast("timestamp")))
    counts = inside.agg(
        F.count("*").alias("n_all"), F.count(status).alias("n_judged"), zero(F.sum(F.when(F.col(status) == good, 1))).alias("n_good"), zero(F.sum(F.when(F.col(status).isin(*bad), 1))).alias("n_bad")
    )
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)), 6)
    return counts.withColumn("good_rate", ratio("n_good", "n_judged")).withColumn("bad_rate", ratio("n_bad", "n_all"))


def operational_overview(events: DataFrame, since: str, until: str) -> DataFrame:
    """One row for ``[since, until)``: runs, deliveries, tool calls and subagents that ended, how many of them badly, and the rates
    (0 where nothing ended). One aggregate over the rows instead of one query each."""
    inside = events.filter((F.col("occurred_at") >= F.lit(since).cast("timestamp")) & (F.col("occurred_at") < F.lit(until).cast("timestamp")))
    kinds = {"runs": ("run_finished", ("failed", "exhausted")), "deliveries": ("delivery_finished", ("failed",)), "tools": ("tool_finished", ("error", "timeout", "blocked")), "subagents": ("subagent_terminal", ("failed", "lost", "cancelled"))}
    ended = lambda kind: F.col("event_type") == kind
    counts = inside.agg(
        *[F.count(F.when(ended(kind), 1)).alias(f"n_{name}") for name, (kind, _) in kinds.items()],
        *[F.count(F.when(ended(kind) & F.col("status").isin(*bad), 1)).alias(f"bad_{name}") for name, (kind, bad) in kinds.items()],
    )
    rate = lambda n: F.round(F.when(F.col(f"n_{n}") > 0, F.col(f"bad_{n}") / F.col(f"n_{n}")).otherwise(F.lit(0.0)), 6)
    return counts.select("*", *[rate(n).alias(f"rate_{n}") for n in kinds])
