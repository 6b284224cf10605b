"""The causal graph of the event log as two tables: nodes, each event owned by exactly one, and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.classify import run_lanes
from loomtrace.operators.hierarchy import solve_hierarchy
from loomtrace.operators.neighbours import with_neighbours
from loomtrace.operators.stats import zero
from loomtrace.session import written

# Event types by the kind of node they make.
MODEL_CALL = ("model_request_started", "model_first_output", "model_response_received", "model_request_failed")
TOOL_CALL = ("tool_started", "tool_finished")
DECISIONS = ("provider_route_decision", "policy_blocked", "retry_scheduled", "continuation_requested", "finalization_requested", "cancel_requested")
TURN_RESULTS = ("turn_response_prepared", "returned_to_caller", "turn_finished")
LEFT_OUT = ("run_started", "run_finished", "process_instance_started", "process_instance_closed", "segment_started", "segment_closed")
ABNORMAL = ("error", "timeout", "blocked", "failed", "exhausted")


def owned_events(events: DataFrame) -> DataFrame:
    """Adds ``node_type`` and ``node_key`` to every event of a run: the first kind that applies owns it; null where none does."""
    kind = F.col("event_type")
    rules = [
        ("model_attempt", F.col("attempt_id").isNotNull(), F.col("attempt_id")),
        ("model_call", kind.isin(*MODEL_CALL) & F.col("model_call_id").isNotNull(), F.col("model_call_id")),
        ("tool_call", kind.isin(*TOOL_CALL) & F.col("tool_call_id").isNotNull(), F.col("tool_call_id")),
        ("decision", kind.isin(*DECISIONS), F.col("event_id")),
        ("checkpoint", F.col("checkpoint_id").isNotNull(), F.col("checkpoint_id")),
        ("anomaly", kind.startswith("checkpoint_"), F.col("event_id")),
        ("goal", F.col("goal_id").isNotNull(), F.col("goal_id")),
        ("delivery", F.col("delivery_id").isNotNull(), F.col("delivery_id")),
        ("turn_result", kind.isin(*TURN_RESULTS), F.coalesce("turn_id", "run_id")),
        ("anomaly", kind.startswith("orphan_") | (kind == "audit_degraded"), F.col("event_id")),
        (None, kind.isin(*LEFT_OUT), F.lit(None)),
    ]
    node_type, node_key = F, F
    for name, rule, key in rules:
        node_type, node_key = node_type.when(F.coalesce(rule, F.lit(False)), F.lit(name)), node_key.when(F.coalesce(rule, F.lit(False)), key)
    return events.filter("run_id is not null").withColumn("node_type", node_type.otherwise("decision")).withColumn("node_key", node_key.otherwise(F.col("event_id")))


#: Nodes that begin and end; without both events they are incomplete whatever their status.
SPANS = ("model_call", "model_attempt", "tool_call")


def node_status(kind: Column, node_type: Column, status: Column) -> Column:
    """Aggregate: the status of a node from its events: the first that applies."""
    has = lambda *s: F.max(F.coalesce(status.isin(*s), F.lit(False)))
    whole = F.max(kind.endswith("_started")) & F.max(kind.endswith("_finished") | kind.endswith("_received") | kind.endswith("_failed"))
    return (
        F.when(F.max(node_type.isin(*SPANS)) & ~whole, "incomplete").when(has("failed", "exhausted", "error"), "failed").when(has("interrupted"), "interrupted").when(has("cancelled"), "cancelled")
        .when(has("timeout", "blocked"), "warning").otherwise("succeeded")
    )


def run_nodes(events: DataFrame) -> DataFrame:
    """One row per node of a run: ``run_id, node_type, node_key, n_events, first_at, status, elapsed_ms``."""
    owned = owned_events(events).filter("node_type is not null").withColumn("_type", F.col("node_type"))
    return owned.groupBy("run_id", "node_type", "node_key").agg(
        F.count("*").alias("n_events"),
        F.min("occurred_at").alias("first_at"),
        node_status(F.col("event_type"), F.col("_type"), F.col("status")).alias("status"),
        F.greatest(F.coalesce(F.max("elapsed_ms"), F.unix_millis(F.max("occurred_at")) - F.unix_millis(F.min("occurred_at"))), F.lit(0)).alias("elapsed_ms"),
    )


def trace_nodes(events: DataFrame) -> DataFrame:
    """One row per run of a trace with its distinct iterations, model calls and tools: the collapsed level of the graph."""
    return events.filter("trace_id is not null and run_id is not null").groupBy("trace_id", "run_id").agg(
        F.min("turn_id").alias("turn_id"),
        F.min("occurred_at").alias("first_at"),
        F.count_distinct("iteration").alias("n_iterations"),
        F.count_distinct("model_call_id").alias("n_model_calls"),
        F.count_distinct("tool_call_id").alias("n_tool_calls"),
        zero(F.count(F.when(F.col("status").isin(*ABNORMAL), 1))).alias("n_failed"),
    )


def edges(events: DataFrame) -> DataFrame:
    """``edge_type, source, target`` between runs and between nodes of a run.

    ``parent_run`` and ``resumed_from`` (run to run), ``caused_by`` (event to event), ``sequence`` (node to the next node of
    its run), ``retry`` (attempt to the next attempt of its model call).
    """
    started = events.filter("event_type = 'run_started'")
    runs = [
        started.filter(F.col(c).isNotNull()).select(F.lit(name).alias("edge_type"), F.col(c).alias("source"), F.col("run_id").alias("target")).distinct()
        for name, c in (("parent_run", "parent_run_id"), ("resumed_from", "resumed_from_run_id"))
    ]
    caused = events.filter("caused_by_event_id is not null").select(F.lit("caused_by").alias("edge_type"), F.col("caused_by_event_id").alias("source"), F.col("event_id").alias("target"))
    node_id = F.concat_ws(":", "node_type", "node_key")
    nodes = run_nodes(events)
    near = with_neighbours(nodes.select("run_id", "first_at", "node_type", "node_key", node_id.alias("node")), ["run_id"], ["first_at", "node_type", "node_key"], ["node"])
    follows = near.filter("has_next").select(F.lit("sequence").alias("edge_type"), F.col("node").alias("source"), F.col("next_node").alias("target"))
    attempts = events.filter("event_type = 'model_attempt_started' and model_call_id is not null and attempt_id is not null").groupBy("model_call_id", "attempt_id").agg(F.min("occurred_at").alias("at"))
    in_call = Window.partitionBy("model_call_id").orderBy("at", "attempt_id")
    retries = attempts.select(F.lit("retry").alias("edge_type"), F.col("attempt_id").alias("source"), F.lead("attempt_id").over(in_call).alias("target")).filter("target is not null")
    return reduce(DataFrame.unionByName, [*runs, caused, follows, retries])


def membership_faults(owned: DataFrame) -> DataFrame:
    """Events owned by more than one node (none, by construction): ``event_id, n_owners``."""
    return owned.filter("node_type is not null").groupBy("event_id").agg(F.count_distinct("node_type", "node_key").alias("n_owners")).filter("n_owners > 1")


def orphan_marks(events: DataFrame, dead_processes: DataFrame, suspected_after: str, now: str) -> DataFrame:
    """Open spans whose owner is gone: ``span, identity, mark`` (``detected`` for dead processes, ``suspected`` for silent ones).

    dead_processes: ``process_instance_id``. A process is silent if it wrote nothing in ``suspected_after`` before ``now``.
    """
    quiet = events.groupBy("process_instance_id").agg(F.max("occurred_at").alias("last_at"))
    silent = quiet.filter(F.col("last_at") < F.expr(f"timestamp'{now}' - interval {suspected_after}")).select("process_instance_id", F.lit("suspected").alias("mark"))
    owner = silent.join(dead_processes, "process_instance_id", "left_anti").unionByName(dead_processes.select("process_instance_id", F.lit("detected").alias("mark")).distinct())
    out = []
    for span, start, end, key in (("run", "run_started", "run_finished", "run_id"), ("model_call", "model_request_started", "model_response_received", "model_call_id"), ("tool_call", "tool_started", "tool_finished", "tool_call_id")):
        opened = events.filter((F.col("event_type") == start) & F.col(key).isNotNull()).select(F.col(key).alias("identity"), "process_instance_id").distinct()
        closed = events.filter(F.col("event_type").isin(end, "model_request_failed") & F.col(key).isNotNull()).select(F.col(key).alias("identity")).distinct()
        out.append(opened.join(closed, "identity", "left_anti").join(owner, "process_instance_id").select(F.lit(span).alias("span"), "identity", "mark"))
    return reduce(DataFrame.unionByName, out)


#: Array columns that name earlier tool calls, with the edges they make.
TOOL_RELATIONS = {"retry_of_tool_call_ids": "tool_retry", "continuation_of_tool_call_ids": "tool_continuation", "recovery_of_tool_call_ids": "tool_recovery"}


def tool_relations(events: DataFrame) -> DataFrame:
    """``edge_type, source, target``: tool calls joined to the earlier calls of their run that their arrays name.

    A source counts if its call ended abnormally before the target; of several named by one relation the latest counts.
    Null and empty arrays make no edge.
    """
    named = F.array(*[F.struct(F.lit(edge).alias("edge_type"), F.col(c).alias("ids")) for c, edge in TOOL_RELATIONS.items()])
    target = events.filter("tool_call_id is not null and run_id is not null").select("run_id", "occurred_at", F.col("tool_call_id").alias("target"), F.inline(named))
    target = target.select("run_id", "occurred_at", "target", "edge_type", F.explode("ids").alias("source")).filter("source is not null and source <> target").distinct()
    ended = events.filter((F.col("event_type") == "tool_finished") & F.col("status").isin(*ABNORMAL)).groupBy("run_id", F.col("tool_call_id").alias("source")).agg(F.max(F.struct("occurred_at", "event_id")).alias("end"))
    both = target.join(ended, ["run_id", "source"]).filter(F.col("end.occurred_at") <= F.col("occurred_at"))
    latest = F.max(F.struct("end", "source"))["source"].alias("source")
    return both.groupBy("run_id", "edge_type", "target").agg(latest).select("edge_type", "source", "target")


def node_names(owned: DataFrame) -> Column:
    """How edges name a node."""
    return F.concat_ws(":", "node_type", "node_key")


def result_returns(events: DataFrame) -> DataFrame:
    """``edge_type, source, target``: from where a resumed run ended to the run that goes on with it.

    The source is the resumed run's last node that began before the run finished, else the run itself.
    """
    started = events.filter("event_type = 'run_started' and resumed_from_run_id is not null").select(F.col("resumed_from_run_id").alias("run_id"), F.col("run_id").alias("next_run")).distinct()
    finished = events.filter("event_type = 'run_finished' and run_id is not null").groupBy("run_id").agg(F.max("occurred_at").alias("finished_at"))
    nodes = run_nodes(events).select("run_id", "first_at", node_names(events).alias("node"))
    last = nodes.join(finished, "run_id").filter(F.col("first_at") <= F.col("finished_at")).groupBy("run_id").agg(F.max(F.struct("first_at", "node"))["node"].alias("node"))
    known = events.filter("event_type = 'run_started'").select("run_id").distinct()
    out = started.join(known, "run_id").join(last, "run_id", "left")
    return out.select(F.lit("result_return").alias("edge_type"), F.coalesce("node", F.concat(F.lit("run:"), "run_id")).alias("source"), F.concat(F.lit("run:"), "next_run").alias("target"))


def retries_of(events: DataFrame) -> DataFrame:
    """``edge_type, source, target``: at every scheduled retry of a model call the attempt before it and the first one after it."""
    attempts = events.filter("event_type = 'model_attempt_started' and model_call_id is not null and attempt_id is not null").groupBy("model_call_id", "attempt_id").agg(F.min("occurred_at").alias("at"))
    scheduled = events.filter("event_type = 'retry_scheduled' and model_call_id is not null").select("model_call_id", "event_id", F.col("occurred_at").alias("retry_at"))
    moment = F.struct("at", "attempt_id")
    both = scheduled.join(attempts, "model_call_id").groupBy("event_id").agg(F.max(F.when(F.col("at") <= F.col("retry_at"), moment)).alias("before"), F.min(F.when(F.col("at") > F.col("retry_at"), moment)).alias("after"))
    found = both.filter("before is not null and after is not null")
    return found.select(F.lit("retry_of").alias("edge_type"), F.concat(F.lit("model_attempt:"), "before.attempt_id").alias("source"), F.concat(F.lit("model_attempt:"), "after.attempt_id").alias("target")).distinct()


def spawn_branches(spawned: DataFrame, events: DataFrame) -> DataFrame:
    """``edge_type, source, target``: from the spawning tool call (:func:`evidence.spawned_between`) to the child run."""
    call = events.filter("tool_call_id is not null").select(F.col("event_id").alias("spawn_event_id"), "tool_call_id").distinct()
    return spawned.join(call, "spawn_event_id").select(F.lit("spawn_branch").alias("edge_type"), F.concat(F.lit("tool_call:"), "tool_call_id").alias("source"), F.concat(F.lit("run:"), "run_id").alias("target"))


def task_edges(events: DataFrame) -> DataFrame:
    """``edge_type, source, target`` of subagent tasks: ``task_execution`` (task to its run), ``task_recovery`` (the same, if the
    task was recovered) and ``task_replacement`` (a task to the one that replaces it).

    events: ``event_type, subagent_task_id, child_run_id, replaces_task_id``. A task whose run or predecessor no event names has no such edge.
    """
    task = events.filter("subagent_task_id is not null").groupBy("subagent_task_id").agg(
        F.max("child_run_id").alias("child"), F.max("replaces_task_id").alias("replaces"), F.max(F.col("event_type") == "subagent_recovered").alias("recovered")
    )
    own = F.concat(F.lit("task:"), "subagent_task_id")
    run = F.concat(F.lit("run:"), "child")
    kinds = F.array(F.struct(F.lit("task_execution").alias("edge_type"), F.lit(True).alias("is")), F.struct(F.lit("task_recovery").alias("edge_type"), F.col("recovered").alias("is")))
    ran = task.filter("child is not null").select(own.alias("source"), run.alias("target"), F.inline(kinds)).filter("is").select("edge_type", "source", "target")
    known = task.select(F.col("subagent_task_id").alias("replaces"))
    replaced = task.filter("replaces is not null").join(known, "replaces", "left_semi")
    return ran.unionByName(replaced.select(F.lit("task_replacement").alias("edge_type"), F.concat(F.lit("task:"), "replaces").alias("source"), own.alias("target")))


def node_causes(events: DataFrame) -> DataFrame:
    """``source, target, resolution``: of every ``caused_by_event_id`` the nodes of both events: ``linked``, ``same_node`` (no edge),
    or ``unresolved`` (the cause is no owned event)."""
    owned = owned_events(events).filter("node_type is not null")
    name = owned.select("event_id", node_names(owned).alias("node")).distinct()
    asked = owned.filter("caused_by_event_id is not null").select("event_id", F.col("caused_by_event_id").alias("cause"), node_names(owned).alias("target")).distinct()
    both = asked.join(name.select(F.col("event_id").alias("cause"), F.col("node").alias("source")), "cause", "left")
    resolution = F.when(F.col("source").isNull(), "unresolved").when(F.col("source") == F.col("target"), "same_node").otherwise("linked")
    return both.select("event_id", "source", "target", resolution.alias("resolution"))


def collapse_chains(events: DataFrame, least: int = 3) -> DataFrame:
    """Neighbouring succeeded nodes of a run that no cause or retry touches, ``least`` or more in a row, as one row each:
    ``run_id, first_at, members, elapsed_ms``. Neighbours are found without a window over a whole run (gaps and islands by seams)."""
    nodes = run_nodes(events)
    linked = node_causes(events).filter("resolution = 'linked'")
    touched = linked.select(F.explode(F.array("source", "target")).alias("node"))
    touched = touched.unionByName(retries_of(events).select(F.explode(F.array("source", "target")).alias("node"))).distinct().withColumn("touched", F.lit(True))
    named = nodes.withColumn("node", node_names(nodes)).join(touched, "node", "left")
    plain = (F.col("status") == "succeeded") & (F.col("node_type") != "anomaly") & F.col("touched").isNull()
    order = Window.partitionBy("run_id").orderBy("first_at", "node_type", "node_key")
    numbered = named.select("run_id", "first_at", "node_type", "node_key", "elapsed_ms", plain.alias("plain")).withColumn("at", F.row_number().over(order)).filter("plain")
    islands = numbered.withColumn("island", F.col("at") - F.row_number().over(order))
    grouped = islands.groupBy("run_id", "island").agg(F.count("*").alias("members"), F.min("first_at").alias("first_at"), zero(F.sum("elapsed_ms")).alias("elapsed_ms"))
    return grouped.filter(F.col("members") >= least).drop("island")


# What begins and what ends a span, and which column tells spans apart.
LIFECYCLES = {
    "run": ("run_id", ("run_started",), ("run_finished",)), "model_call": ("model_call_id", ("model_request_started",), ("model_response_received", "model_request_failed")),
    "model_attempt": ("attempt_id", ("model_attempt_started",), ("model_attempt_finished",)), "tool_call": ("tool_call_id", ("tool_started",), ("tool_finished",)),
}


def anomaly_starts(events: DataFrame, integrity: DataFrame) -> DataFrame:
    """Per trace where its trouble starts: ``trace_id, event_id, category``.

    First a span with a wrong life cycle (a run not begun exactly once or ended twice, a call without beginning or end): its
    second beginning, else its second end, else its first event; the earliest of a trace. Else the earliest abnormal event.
    Else, if the trace's ``integrity`` (``trace_id, integrity``) is not valid, its first event.
    """
    rows = events.filter("trace_id is not null").withColumn("o", F.struct("occurred_at", "segment_sequence", "event_id"))
    kind, spans = F.col("event_type"), []
    for span, (key, starts, ends) in LIFECYCLES.items():
        own = rows.filter(F.col(key).isNotNull())
        if span != "run":
            own = own.filter(kind.isin(*starts, *ends))
        role = F.when(kind.isin(*starts), "s").when(kind.isin(*ends), "e")
        spans.append(own.select("trace_id", F.lit(span).alias("span"), F.col(key).alias("key"), role.alias("role"), "o"))
    every = reduce(DataFrame.unionByName, spans)
    nth = F.row_number().over(Window.partitionBy("trace_id", "span", "key", "role").orderBy("o"))
    second = every.filter("role is not null").withColumn("n", nth).filter("n = 2").groupBy("trace_id", "span", "key").agg(F.min(F.when(F.col("role") == "s", F.col("o"))).alias("s2"), F.min(F.when(F.col("role") == "e", F.col("o"))).alias("e2"))
    count = lambda r: F.count(F.when(F.col("role") == r, 1))
    life = every.groupBy("trace_id", "span", "key").agg(count("s").alias("n_s"), count("e").alias("n_e"), F.min("o").alias("first"))
    wrong = F.when(F.col("span") == "run", (F.col("n_s") != 1) | (F.col("n_e") > 1)).otherwise((F.col("n_s") == 0) | (F.col("n_e") == 0))
    broken = life.filter(wrong).join(second, ["trace_id", "span", "key"], "left").groupBy("trace_id").agg(F.min(F.coalesce("s2", "e2", "first")).alias("broken"))
    bad = kind.startswith("orphan_") | kind.isin("audit_degraded", "policy_blocked", "retry_scheduled") | F.coalesce(F.col("status").isin(*ABNORMAL), F.lit(False))
    whole = rows.groupBy("trace_id").agg(F.min("o").alias("first"), F.min(F.when(bad, F.struct("o", "event_type"))).alias("bad"))
    out = whole.join(broken, "trace_id", "left").join(integrity.select("trace_id", "integrity"), "trace_id", "left")
    unsound = F.col("integrity").isin("invalid", "incomplete", "degraded")
    event = F.coalesce(F.col("broken.event_id"), F.col("bad.o.event_id"), F.when(unsound, F.col("first.event_id")))
    category = F.when(F.col("broken").isNotNull(), "lifecycle_mismatch").when(F.col("bad").isNotNull(), F.col("bad.event_type")).when(unsound, "integrity")
    return out.select("trace_id", event.alias("event_id"), category.alias("category")).filter("event_id is not null")


def build(events: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a level: ``trace`` (runs and how they follow from each other), ``run`` (what happens in runs), or
    ``trace_full`` (both, with the side of each run and the returns and retries between them)."""
    started = events.filter("event_type = 'run_started'")
    runs = trace_nodes(events).select("run_id", F.lit("run").alias("node_type"), F.col("run_id").alias("node_key"), "first_at")
    all_edges = edges(events)
    between = all_edges.filter("edge_type in ('parent_run', 'resumed_from')")
    if level == "trace":
        return runs, between
    inner = run_nodes(events).select("run_id", "node_type", "node_key", "first_at")
    if level == "run":
        return inner, all_edges.filter("edge_type not in ('parent_run', 'resumed_from')")
    if level != "trace_full":
        raise ValueError(f"no level {level}")
    lanes = run_lanes(started.select("run_id", "parent_run_id", "resumed_from_run_id", "occurred_at").distinct())
    placed = runs.unionByName(inner).join(lanes.groupBy("run_id").agg(F.min("kind").alias("kind"), F.min("side").alias("side")), "run_id", "left")
    return placed, all_edges.unionByName(result_returns(events)).unionByName(retries_of(events))


def lane_orders(started: DataFrame) -> DataFrame:
    """``run_id, kind, lane``: in which column a run is drawn, 0 for the middle, negative to the left.

    started: ``run_id, parent_run_id, resumed_from_run_id, occurred_at``, the earliest row of a run counts. Main runs are in the
    middle; children of a run in the middle alternate left and right, outward by their start; deeper ones stand one column further
    out than their parent; a continuation stays with the run it resumes, or in column 1 beside the middle. A lane needs no walk
    level by level: it is the lane of the first run on the path that left the middle, and how many children follow it. Runs on
    or below cycles, and children of unknown runs with all below them, are in column 1.
    """
    first = started.filter("run_id is not null").groupBy("run_id").agg(F.min(F.struct("occurred_at", "parent_run_id", "resumed_from_run_id")).alias("s")).select("run_id", "s.*")
    kind = F.when(F.col("parent_run_id").isNotNull(), "child_agent").when(F.col("resumed_from_run_id").isNotNull(), "continuation").otherwise("main")
    runs = written(first.withColumn("kind", kind))
    nth = F.row_number().over(Window.partitionBy("parent_run_id").orderBy("occurred_at", "run_id")) - 1
    side = F.when(nth % 2 == 0, -1).otherwise(1) * (F.floor(nth / 2) + 1)
    own = runs.filter("kind = 'child_agent'").select("run_id", "kind", side.cast("int").alias("side")).unionByName(runs.filter("kind <> 'child_agent'").select("run_id", "kind", F.lit(1).alias("side")))
    solved = solve_hierarchy(runs.select(F.col("run_id").alias("id"), F.coalesce("parent_run_id", "resumed_from_run_id").alias("parent")))
    steps = solved.filter("status = 'tree'").select("id", F.posexplode("path").alias("pos", "run_id")).join(own, "run_id")
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c)))
    below = lambda k: F.count(F.when((F.col("pos") >= k) & (F.col("kind") == "child_agent"), 1))
    top = steps.groupBy(F.col("id").alias("run_id")).agg(at(0, "kind").alias("root"), at(1, "side").alias("base"), below(1).alias("c1"), below(2).alias("c2"))
    lane = F.when(F.col("root") == "main", F.when(F.col("base").isNull(), 0).otherwise(F.signum("base") * (F.abs("base") + F.col("c2")))).when(F.col("root") == "continuation", 1 + F.col("c1")).otherwise(1)
    return runs.select("run_id", "kind").join(top, "run_id", "left").select("run_id", "kind", F.coalesce(lane, F.lit(1)).cast("int").alias("lane"))
