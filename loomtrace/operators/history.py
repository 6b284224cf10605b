"""Conversation history under budgets. No operator numbers a whole session: every message has at least 4 tokens, so a budget
bounds how many of a session's newest (or oldest) messages can matter, and Spark prunes to that many before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import written

LEAST_TOKENS = 4


def _newest(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])


def last_messages(messages: DataFrame, key: str, order: list[str], n: int, extend_to_user: bool = True) -> DataFrame:
    """The last ``n`` messages of each session with ``from_end`` (1 is the newest); if no user message is among them and
    ``extend_to_user``, also those back to the session's last user message."""
    tail = messages.withColumn("from_end", F.row_number().over(_newest(key, order))).filter(F.col("from_end") <= n)
    if not extend_to_user:
        return tail
    at = F.struct(*order)
    spoken = tail.groupBy(key).agg(F.max(F.col("role") == "user").alias("has_user"), F.min(at).alias("start"))
    last_user = messages.filter("role = 'user'").groupBy(key).agg(F.max(at).alias("last_user"))
    early = spoken.filter("not has_user").join(last_user, key)
    more = messages.join(early.select(key, "start", "last_user"), key).filter((at >= F.col("last_user")) & (at < F.col("start")))
    return tail.unionByName(more.select(*messages.columns, F.lit(None).cast("int").alias("from_end")))


def within_budget(messages: DataFrame, key: str, order: list[str], tokens: Column, budget: int) -> DataFrame:
    """The newest messages whose tokens together stay within ``budget``; always at least one: adds ``tokens_upto``."""
    few = messages.withColumn("from_end", F.row_number().over(_newest(key, order))).filter(F.col("from_end") <= max(1, budget // LEAST_TOKENS + 1))
    upto = F.sum(tokens).over(_newest(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return few.withColumn("tokens_upto", upto).filter((F.col("tokens_upto") <= budget) | (F.col("from_end") == 1))


def consolidation_boundary(messages: DataFrame, key: str, order: list[str], tokens: Column, target: int) -> DataFrame:
    """Per session the first user message (not the first message) before which at least ``target`` tokens lie, else the last
    user message: ``key, boundary_id, enough``. Sessions without such a user message have no row."""
    at = F.struct(*order, "message_id")
    oldest = Window.partitionBy(key).orderBy(*order, "message_id")
    few = messages.withColumn("from_start", F.row_number().over(oldest)).filter(F.col("from_start") <= target // LEAST_TOKENS + 2)
    before = F.coalesce(F.sum(tokens).over(oldest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = few.withColumn("before", before).withColumn("at", at)
    head = cut.groupBy(key).agg(F.min("at").alias("first"), F.min(F.when(F.col("before") >= target, F.col("at"))).alias("reached"))
    users = messages.filter("role = 'user'").select(key, at.alias("at")).join(head, key).filter(F.col("at") > F.col("first"))
    found = users.groupBy(key).agg(F.min(F.when(F.col("at") >= F.col("reached"), F.col("at"))).alias("enough"), F.max("at").alias("last"))
    return found.select(key, F.coalesce("enough", "last")["message_id"].alias("boundary_id"), F.col("enough").isNotNull().alias("enough"))


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results without an earlier call of the same id: ``results`` rows; calls: ``call_id, at``; results: ``call_id, at, ...``."""
    first = calls.groupBy("call_id").agg(F.min("at").alias("called_at"))
    return results.join(first, "call_id", "left").filter(F.col("called_at").isNull() | (F.col("called_at") >= F.col("at"))).drop("called_at")


def missing_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls that no result answers."""
    return calls.join(results.select("call_id").distinct(), "call_id", "left_anti")


def turns(rows: DataFrame, key: str, order: list[str], ends: Column) -> DataFrame:
    """Rows numbered by turn: a turn goes on to the row for which ``ends`` holds (``turn_no`` from 0)."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("turn_no", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)))


def newest_by_key(rows: DataFrame, keys: list[str], order: list[str], k: int = 1) -> DataFrame:
    """The last ``k`` rows of each key by ``order`` (upsert with k = 1: the latest version wins)."""
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_nr", nr).filter(F.col("_nr") <= k).drop("_nr")


def legal_start(messages: DataFrame, key: str, seq: str) -> DataFrame:
    """Per session the first ``seq`` from which every tool result has its call: ``key, legal_from`` (null: from the start).

    messages: the rows of :func:`within_budget` (the budget bounds a session's rows) with ``call_ids`` (array, what an
    assistant message calls) and ``result_id`` (what a tool message answers). A result whose call isn't declared since the
    last such result cuts off everything up to itself. Found as a fixpoint: a result is cut if a cut lies after its call.
    """
    calls = messages.select(key, F.col(seq).alias("called"), F.explode("call_ids").alias("call_id"))
    results = messages.filter("result_id is not null").select(key, F.col(seq).alias("at"), F.col("result_id").alias("call_id"))
    latest = results.join(calls, [key, "call_id"], "left").groupBy(key, "at").agg(F.max(F.when(F.col("called") < F.col("at"), F.col("called"))).alias("called"))
    earlier = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last, n = -1, 0
    while n != last:
        cut_before = F.max(F.when(F.col("called").isNull(), F.col("at"))).over(earlier)
        judged = latest.withColumn("_cut", cut_before).withColumn("called", F.when(F.col("called") > F.coalesce("_cut", F.lit(-1)), F.col("called")))
        latest = written(judged.drop("_cut"))
        last, n = n, latest.filter("called is null").count() + 1
    cuts = latest.filter("called is null").groupBy(key).agg(F.max("at").alias("_cut"))
    return messages.select(key).distinct().join(cuts, key, "left").select(key, (F.col("_cut") + 1).alias("legal_from"))


def compact_results(messages: DataFrame, key: str, order: list[str], tokens: Column, budget: int, stub_tokens: int = 8) -> DataFrame:
    """Tool results replaced by stubs, oldest first, until the session's tokens are within ``budget``: adds ``compacted``.

    The greedy choice is a prefix of the tool results, so it is a running sum of what each replacement saves.
    """
    total = messages.groupBy(key).agg(F.sum(tokens).alias("_total"))
    saving = F.when(F.col("role") == "tool", F.greatest(tokens - stub_tokens, F.lit(0))).otherwise(F.lit(0))
    before = F.coalesce(F.sum(saving).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return messages.join(total, key).withColumn("compacted", (saving > 0) & (F.col("_total") - before > budget)).drop("_total")


def merge_tool_events(rows: DataFrame, keys: list[str], rank: Column, order: str, fields: list[str]) -> DataFrame:
    """One row per tool call from its progress events: of each field the value of the highest phase, then the latest, that has one."""
    best = [F.max(F.when(F.col(f).isNotNull(), F.struct(rank.alias("r"), F.col(order).alias("o"), F.col(f).alias("x"))))["x"].alias(f) for f in fields]
    return rows.groupBy(*keys).agg(*best)


def reconcile(cached: DataFrame, present: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """A cached index against what is there (full outer): ``key, action`` of ``reuse``, ``read``, ``drop``."""
    a, b = cached.select(key, F.struct(*signature).alias("old")), present.select(key, F.struct(*signature).alias("new"))
    action = F.when(F.col("new").isNull(), "drop").when(F.col("old").eqNullSafe(F.col("new")), "reuse").otherwise("read")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def last_turns(turn_rows: DataFrame, key: str, turn: str, least: int) -> DataFrame:
    """The newest whole turns that together have at least ``least`` messages (``key, turn, n``), or all of a shorter session."""
    sizes = turn_rows.groupBy(key, turn).agg(F.count("*").alias("n"))
    newest = Window.partitionBy(key).orderBy(F.desc(turn))
    few = sizes.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= least)
    after = F.coalesce(F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("_after", after).filter(F.col("_after") < least).drop("_r", "_after")


def legal_suffix(messages: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """Every message with ``kept``: whether it is among the session's last ``n`` and not before its :func:`legal_start`."""
    newest = messages.select(key, seq).withColumn("_r", F.row_number().over(_newest(key, [seq]))).filter(F.col("_r") <= n)
    first = newest.groupBy(key).agg(F.min(seq).alias("_first")).join(legal_start(messages, key, seq), key)
    start = F.greatest("_first", F.coalesce("legal_from", F.lit(0)))
    return messages.join(first, key).withColumn("kept", F.col(seq) >= start).drop("_first", "legal_from")


# What stands for a result that never came, and for a reply that says nothing.
NO_RESULT, PLACEHOLDER = "[no result]", "[placeholder]"


def backfill_results(messages: DataFrame, key: str, seq: str) -> DataFrame:
    """Messages with a tool message ``NO_RESULT`` after each call that no result answers, renumbered as ``position`` (from 1).

    messages: ``role, content, call_ids, result_id``. Several missing results of one message stand in the order of its calls.
    """
    calls = messages.select(key, seq, F.posexplode("call_ids").alias("_nth", "result_id"))
    missing = calls.join(messages.filter("result_id is not null").select(key, "result_id").distinct(), [key, "result_id"], "left_anti")
    filled = missing.select(key, seq, (F.col("_nth") + 1).alias("_nth"), F.lit("tool").alias("role"), F.lit(NO_RESULT).alias("content"), "result_id")
    own = messages.select(key, seq, F.lit(0).alias("_nth"), "role", "content", "result_id")
    return own.unionByName(filled).withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(seq, "_nth"))).drop("_nth")


def well_formed(messages: DataFrame) -> DataFrame:
    """Messages without calls that name no tool, and without assistant messages that then have neither a call nor a text.

    messages: ``role, content, call_ids, call_names`` (two arrays of equal length).
    """
    pairs = F.filter(F.arrays_zip("call_ids", "call_names"), lambda p: F.trim(F.coalesce(p["call_names"], F.lit(""))) != "")
    kept = messages.withColumn("_calls", pairs)
    kept = kept.withColumn("call_ids", F.transform("_calls", lambda p: p["call_ids"])).withColumn("call_names", F.transform("_calls", lambda p: p["call_names"]))
    says = ~F.trim(F.coalesce("content", F.lit(""))).isin("", PLACEHOLDER)
    return kept.filter((F.col("role") != "assistant") | (F.size(F.coalesce("_calls", F.array())) > 0) | says).drop("_calls")


def history_window(messages: DataFrame, key: str, order: list[str], tokens: Column, budget: int, most: int, keep_system: bool = False) -> DataFrame:
    """The newest messages within ``budget`` tokens and ``most`` messages, from a user message on if there is one among them.

    With ``keep_system`` the system messages of a session stay whatever their age, and their tokens are taken from the budget.
    Always at least the newest message. Adds ``tokens_upto`` (null for system messages that are kept so).
    """
    if not keep_system:
        few = within_budget(messages, key, order, tokens, budget)
    else:
        system = messages.filter("role = 'system'")
        used = system.groupBy(key).agg(F.sum(tokens).alias("_used"))
        others = within_budget(messages.filter("role is null or role <> 'system'"), key, order, tokens, budget).join(used, key, "left")
        few = others.filter((F.col("tokens_upto") <= budget - F.coalesce("_used", F.lit(0))) | (F.col("from_end") == 1)).drop("_used")
    few = few.filter(F.col("from_end") <= most)
    first_user = few.groupBy(key).agg(F.max(F.when(F.col("role") == "user", F.col("from_end"))).alias("_user"))
    kept = few.join(first_user, key).filter(F.col("_user").isNull() | (F.col("from_end") <= F.col("_user"))).drop("_user", "from_end")
    return kept.unionByName(system, allowMissingColumns=True) if keep_system else kept
