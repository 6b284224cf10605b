"""Correlating events in time: failures with later recoveries, child runs with the calls that spawned them, repeats, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.neighbours import with_neighbours
from loomtrace.operators.stats import zero
from loomtrace.session import written


def latest_before(late: DataFrame, early: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """As-of, backward, with a tolerance: each row of ``late`` with the latest row of ``early`` of its key at most ``minutes``
    older (and not younger): ``late`` plus ``early_id, early_at``, null if there is none. Both have ``id``, key and time.

    Time is cut into slots of the tolerance; a row of ``early`` also goes to the next slot, so that one window over (key,
    slot) sees every match: a key with a third of all rows is spread over its slots.
    """
    width = minutes * 60 * 1_000_000
    us = F.unix_micros(at)
    slot = F.floor(us / width)
    a = early.select(key, F.explode(F.array(slot, slot + 1)).alias("slot"), F.col(at).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("late_id"), F.col("id").alias("early_id"))
    b = late.select(key, slot.alias("slot"), F.col(at).alias("t"), F.lit(1).alias("kind"), F.col("id").alias("late_id"), F.lit(None).cast("string").alias("early_id"))
    order = Window.partitionBy(key, "slot").orderBy("t", "kind", F.coalesce("early_id", "late_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("kind") == 0, F.struct("early_id", F.col("t").alias("early_at"))), ignorenulls=True).over(order)
    matched = a.unionByName(b).withColumn("m", last).filter("kind = 1")
    near = F.unix_micros("t") - F.unix_micros("m.early_at") <= width
    return matched.select(key, F.col("late_id").alias("id"), F.col("t").alias(at), F.when(near, F.col("m.early_id")).alias("early_id"), F.when(near, F.col("m.early_at")).alias("early_at"))


def recoveries(runs: DataFrame, minutes: int = 120) -> DataFrame:
    """Successful runs linked to the latest failed run of their session: ``run_id, failed_run_id, lag_ms``.

    runs: ``id, session_key, at, status, family``. The latest failure alone is judged: if its family differs, an older one
    that would fit is not taken.
    """
    keyed = written(runs.filter("session_key is not null"))  # read four times below
    good, bad = keyed.filter("status = 'succeeded'"), keyed.filter("status in ('failed', 'interrupted', 'exhausted')")
    linked = latest_before(good, bad, "session_key", "at", minutes).filter("early_id is not null")
    family = bad.select(F.col("id").alias("early_id"), F.col("family").alias("bad_family"))
    out = linked.join(good.select("id", "family"), "id").join(family, "early_id").filter(F.col("family").eqNullSafe(F.col("bad_family")))
    return out.select(F.col("id").alias("run_id"), F.col("early_id").alias("failed_run_id"), (F.unix_millis("at") - F.unix_millis("early_at")).alias("lag_ms"))


def spawned_between(events: DataFrame) -> DataFrame:
    """Child runs that started strictly after a finished ``spawn`` call of their parent run and before the parent's next
    event, if exactly one call fits: ``run_id, parent_run_id, spawn_event_id``."""
    rows = events.filter("run_id is not null").select("run_id", "event_id", "event_type", "tool_name", "occurred_at", "segment_sequence")
    near = with_neighbours(rows, ["run_id"], ["occurred_at", "segment_sequence", "event_id"], ["occurred_at"])
    gaps = near.withColumnRenamed("occurred_at", "from_at").withColumnRenamed("next_occurred_at", "to_at")
    spawn = gaps.filter("event_type = 'tool_finished' and tool_name = 'spawn'").select(F.col("run_id").alias("parent_run_id"), F.col("event_id").alias("spawn_event_id"), "from_at", "to_at")
    child = events.filter("event_type = 'run_started' and parent_run_id is not null").select("run_id", "parent_run_id", "occurred_at")
    # The gaps of a run lie apart, so a child fits the last spawn before it or none: no child meets every call of its parent.
    nothing = F.lit(None)
    a = spawn.select("parent_run_id", F.col("from_at").alias("t"), F.lit(1).alias("kind"), nothing.cast("string").alias("run_id"), F.struct("spawn_event_id", "to_at").alias("spawn"))
    b = child.select("parent_run_id", F.col("occurred_at").alias("t"), F.lit(0).alias("kind"), "run_id", nothing.cast(a.schema["spawn"].dataType).alias("spawn"))
    order = Window.partitionBy("parent_run_id").orderBy("t", "kind", F.asc_nulls_last("spawn.to_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = a.unionByName(b).withColumn("s", F.last("spawn", ignorenulls=True).over(order)).filter("kind = 0 and s is not null")
    inside = matched.filter(F.col("s.to_at").isNull() | (F.col("t") < F.col("s.to_at")))
    return inside.groupBy("run_id", "parent_run_id").agg(F.count("*").alias("n"), F.min("s.spawn_event_id").alias("spawn_event_id")).filter("n = 1").drop("n")


def repeated_groups(rows: DataFrame, keys: list[str], least: int, least_sessions: int = 1) -> DataFrame:
    """Groups seen at least ``least`` times in at least ``least_sessions`` sessions, with a digest of their key as id."""
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("episodes"), F.count_distinct("session_key").alias("sessions"))
    return grouped.filter((F.col("episodes") >= least) & (F.col("sessions") >= least_sessions)).withColumn("group_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in keys]), 256))


def reference_integrity(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """Events against payloads by id (full outer): ``payload_id, verdict`` of ``missing_payload``, ``orphan_payload``, ``wrong_event``."""
    a = events.filter("payload_id is not null").groupBy("payload_id").agg(F.min("event_id").alias("event_id"))
    b = payloads.filter("payload_id is not null").groupBy("payload_id").agg(F.min("event_id").alias("stored_event_id"))
    verdict = (
        F.when(F.col("stored_event_id").isNull() & F.col("event_id").isNotNull(), "missing_payload").when(F.col("event_id").isNull(), "orphan_payload").when(F.col("event_id") != F.col("stored_event_id"), "wrong_event")
    )
    return a.join(b, "payload_id", "full_outer").select("payload_id", verdict.alias("verdict")).filter("verdict is not null")


def sequence_faults(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Per key the first fault of its numbering from 1: ``duplicate_sequence`` or ``sequence_gap`` with its number, and the rows.

    Counts first: a chain without a fault has as many rows as its largest number, each once, and is not ordered.
    """
    per = rows.groupBy(*keys, sequence).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(sequence)
    step = per.withColumn("gap", F.col(sequence) - F.coalesce(F.lag(sequence).over(order), F.lit(0)) != 1)
    fault = F.when(F.col("gap"), F.struct(F.col(sequence).alias("at"), F.lit("sequence_gap").alias("fault"))).when(F.col("n") > 1, F.struct(F.col(sequence).alias("at"), F.lit("duplicate_sequence").alias("fault")))
    out = step.groupBy(*keys).agg(zero(F.sum("n")).alias("n_rows"), F.min(fault).alias("f"))
    return out.select(*keys, "n_rows", F.coalesce("f.fault", F.lit("valid")).alias("verdict"), F.col("f.at").alias("at_sequence"))


def verify_hash_chain(rows: DataFrame, keys: list[str], sequence: str, previous: str, own: str, computed: Column) -> DataFrame:
    """Per key the first record whose predecessor hash or own hash is wrong: ``verdict, at_sequence``."""
    order = Window.partitionBy(*keys).orderBy(sequence)
    wrong_before = ~F.col(previous).eqNullSafe(F.lag(own).over(order))
    judged = rows.withColumn("_f", F.when(wrong_before, "previous_hash_mismatch").when(F.col(own) != computed, "record_hash_mismatch"))
    return judged.groupBy(*keys).agg(F.min(F.when(F.col("_f").isNotNull(), F.struct(F.col(sequence).alias("at"), F.col("_f").alias("fault")))).alias("f")).select(
        *keys, F.coalesce("f.fault", F.lit("valid")).alias("verdict"), F.col("f.at").alias("at_sequence")
    )


def assign_splits(cases: DataFrame, key: str, pack: str) -> DataFrame:
    """train, validation or holdout by the rank of the case's digest in its pack: 50, 25 and 25 percent from 4 cases on; of 3
    one each; fewer are all train. The same cases get the same split wherever and in whatever order they come."""
    digest = F.sha2(F.concat_ws("|", F.col(pack).cast("string"), F.col(key).cast("string")), 256)
    by = Window.partitionBy(pack)
    ranked = cases.withColumn("_r", F.row_number().over(by.orderBy(digest, key))).withColumn("_n", F.count("*").over(by))
    train = F.when(F.col("_n") < 3, F.col("_n")).when(F.col("_n") == 3, 1).otherwise(F.floor(F.col("_n") / 2))
    validation = F.when(F.col("_n") < 3, 0).when(F.col("_n") == 3, 1).otherwise(F.floor((F.col("_n") - train) / 2))
    return ranked.withColumn("split", F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + validation, "validation").otherwise("holdout")).drop("_r", "_n")


def holdout_gate(results: DataFrame, key: str, least_score: float = 0.8, cost: float = 0.15, latency: float = 0.20) -> DataFrame:
    """Per run: the mean score of its holdout cases, any violation in all cases, and whether it passes (needs a holdout case).

    With columns ``baseline_tokens, tokens`` or ``baseline_ms, ms`` the growth of their sums must stay within ``cost`` or ``latency``
    too; a baseline of 0 or null sets no limit.
    """
    growths = {"cost_growth": ("baseline_tokens", "tokens", cost), "latency_growth": ("baseline_ms", "ms", latency)}
    known = {name: x for name, x in growths.items() if set(x[:2]) <= set(results.columns)}
    agg = results.groupBy(key).agg(
        F.round(F.avg(F.when(F.col("split") == "holdout", F.col("score"))), 6).alias("holdout_score"),
        F.coalesce(F.max("violation"), F.lit(False)).alias("any_violation"),
        *[F.round(F.sum(new) / F.nullif(F.sum(old), F.lit(0)) - 1, 6).alias(name) for name, (old, new, _) in known.items()],
    )
    fine = (F.col("holdout_score") >= least_score) & ~F.col("any_violation")
    for name, (_, _, most) in known.items():
        fine = fine & (F.coalesce(name, F.lit(0.0)) <= most)
    return agg.withColumn("passed", F.coalesce(fine, F.lit(False)))


def replay_consistency(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: whether two replays have the same keys and for each the same digest and violation flag, and how many differ."""
    a, b = first.select(key, F.struct("digest", "violation").alias("x")), second.select(key, F.struct("digest", "violation").alias("y"))
    both = a.join(b, key, "full_outer").agg(F.count("*").alias("n_keys"), zero(F.count(F.when(~F.col("x").eqNullSafe(F.col("y")), 1))).alias("n_different"))
    return both.withColumn("verdict", F.when(F.col("n_different") == 0, "consistent").otherwise("inconsistent"))


def answer_score(response: Column, expected: Column) -> Column:
    """1 equal, 0.8 contained, 0.5 if half of the expected words occur, else 0 (trimmed, lower case; an empty target is 0)."""
    actual, target = F.lower(F.trim(response)), F.lower(F.trim(expected))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    overlap = F.size(F.array_intersect(words(target), words(actual))) / F.size(words(target))
    return F.when(target == "", 0.0).when(actual == target, 1.0).when(F.contains(actual, target), 0.8).when(overlap >= 0.5, 0.5).otherwise(0.0)


def session_debounce(events: DataFrame, key: str, at: str, idle_minutes: int) -> DataFrame:
    """One job per session and pause: ``key, first_at, due_at, n`` (due when the idle time has passed since the last activity).

    Events are first counted by slots as long as the idle time, with a map-side combine: within a slot nobody pauses, so only
    slots are ordered, and a session with a third of all events moves as few rows as it has slots. Null times are left out.
    """
    width = idle_minutes * 60_000_000
    us = F.unix_micros(at)
    slots = events.filter(F.col(at).isNotNull()).groupBy(key, (us - F.pmod(us, F.lit(width))).alias("slot")).agg(F.min(us).alias("first"), F.max(us).alias("last"), F.count("*").alias("m"))
    order = Window.partitionBy(key).orderBy("slot")
    begins = F.coalesce(F.col("first") - F.lag("last").over(order) >= width, F.lit(True)).cast("int")
    numbered = slots.withColumn("begins", begins).withColumn("job", F.sum("begins").over(order))
    jobs = numbered.groupBy(key, "job").agg(F.timestamp_micros(F.min("first")).alias("first_at"), F.timestamp_micros(F.max("last") + width).alias("due_at"), F.sum("m").alias("n"))
    return jobs.select(key, "first_at", "due_at", "n")
