"""What failed, what came of it, and to which family of tasks and corrections it belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.graph import ABNORMAL

# Families of step failures with the parts of words that show them, in order; statuses that are no failure.
STEP_FAILURES = (
    ("resource_not_found", ("file_not_found", "filenotfound", "not found")), ("permission_denied", ("permission", "access_denied", "forbidden")), ("invalid_arguments", ("invalid", "validation")), ("timeout", ("timeout",)),
    ("rate_limited", ("rate", "429")), ("policy_blocked", ("policy", "blocked", "boundary")),
)
FINE = ("ok", "success", "completed", "done")
# Families of corrections with the words that show them, in order.
CORRECTIONS = (
    ("correct_path", ("路径", "文件名", "改成", "写错", "重新读取", "换成")), ("correct_skill_name", ("skill 名称", "技能名称", "skill名", "名称写错")), ("correct_arguments", ("参数", "补充参数", "参数不完整")),
    ("narrow_scope", ("范围", "只看", "限定", "缩小")), ("change_target", ("改为", "换一个", "换目标")),
)
# Words of tasks about skills and folders.
SKILL_SEARCH, SKILL_CONTENT, FOLDERS = ("找", "查", "搜", "目录"), ("读取", "查看", "内容"), ("目录", "文件夹", "有哪些文件")
#: A failed row is tried so often.
ATTEMPTS = 5


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _first(text: Column, table: tuple[tuple[str, tuple[str, ...]], ...], other: str) -> Column:
    out = F
    for name, words in table:
        out = out.when(_any(text, words), F.lit(name))
    return out.otherwise(F.lit(other))


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def step_failure(status: Column, *details: Column) -> Column:
    """The family of a failed step by the words of its details; null for steps that went well or say nothing."""
    said = F.trim(F.concat_ws(" ", *[_low(c) for c in details]))
    return F.when(F.trim(_low(status)).isin(*FINE) | (said == ""), F.lit(None)).otherwise(_first(said, STEP_FAILURES, "tool_exception"))


def operation_family(tools: Column) -> Column:
    """The kind of operation of a set of tools: reading a file comes first, then listing, then skills."""
    has = lambda t: F.array_contains(F.coalesce(tools, F.array().cast("array<string>")), t)
    return (
        F.when(has("read_file") & has("skill_read"), "skill_read").when(has("read_file"), "file_read").when(has("list_dir"), "directory_list").when(has("skill_catalog_search"), "skill_search")
        .when(has("skill_read"), "skill_read").otherwise("unknown_operation")
    )


def task_family(text: Column, tools: Column) -> Column:
    """What a task is about, by its tools and words."""
    said, does = _low(text), operation_family(tools)
    skill = F.contains(said, F.lit("skill"))
    return (
        F.when((does == "skill_search") | (skill & _any(said, SKILL_SEARCH)), "skill_discovery").when((does == "skill_read") | (skill & _any(said, SKILL_CONTENT)), "skill_content_lookup")
        .when((does == "directory_list") | _any(said, FOLDERS), "workspace_directory_inventory").when(does == "file_read", "workspace_file_lookup").otherwise("unknown_task")
    )


def correction_family(text: Column) -> Column:
    """What a correction changes, by its words."""
    return _first(_low(text), CORRECTIONS, "general_correction")


def candidate_use(risk: Column, status: Column, verified: Column) -> Column:
    """What a step may serve for, by its risk, its end, and whether something verified it."""
    fine = F.coalesce(status.isin("ok", "success"), F.lit(False))
    return F.when(risk == "R4", "archive_only").when(~fine, "unverified").when(risk.isin("R2", "R3"), "abstract_only").when(verified.isNotNull(), "reusable").otherwise("unverified")


def retry_state(attempts: Column) -> Column:
    """A failed row waits for its next try, or is dead after ``ATTEMPTS``."""
    return F.when(attempts >= ATTEMPTS, "dead_letter").otherwise("pending")


def error_note(tool: Column, code: Column, kind: Column, timeout_ms: Column, target: Column) -> Column:
    """One line for a reader: null where there is no error."""
    reason = F.concat(F.lit("("), F.coalesce(kind, F.lit("unknown error")), F.lit(")"))
    seconds = F.regexp_replace((timeout_ms / 1000).cast("string"), r"\.0$", "")
    return (
        F.when(code.isNull() & kind.isNull(), F.lit(None)).when((code == "web_search_timeout") & timeout_ms.isNotNull(), F.concat(F.lit("Web search timed out after "), seconds, F.lit("s")))
        .when(code == "file_not_found", F.concat(F.lit("File not found ("), F.coalesce(target, F.lit("path unavailable")), F.lit(")"))).otherwise(F.concat_ws(" ", tool, F.lit("failed"), reason))
    )


def page_note(limit: int | None, offset: int, truncated: bool) -> str | None:
    """The line under a page of matches that says where it stands; None for a whole result."""
    if not truncated and not offset:
        return None
    return f"(pagination: {f'limit={limit}, ' if truncated and limit is not None else ''}offset={offset})"


def tool_failures(events: DataFrame) -> DataFrame:
    """Per tool call of a run that failed its last abnormal event and what came of the run: ``run_id, tool_call_id, failed_event_id,
    failure_kind, impact``. impact is ``pending`` while the run goes on, ``run_continued`` if it succeeded, else ``unknown``."""
    order = F.struct("occurred_at", "segment_sequence", "event_id", "status")
    calls = events.filter("run_id is not null and tool_call_id is not null").filter(F.col("status").isin(*ABNORMAL))
    last = calls.groupBy("run_id", "tool_call_id").agg(F.max(order).alias("f"))
    ends = events.filter("event_type = 'run_finished' and run_id is not null").groupBy("run_id").agg(F.max(order)["status"].alias("run_status"), F.lit(True).alias("ended"))
    impact = F.when(F.col("ended").isNull(), "pending").when(F.col("run_status") == "succeeded", "run_continued").otherwise("unknown")
    kind = F.when(F.col("f.status") == "blocked", "policy_error").otherwise("tool_error")
    return last.join(ends, "run_id", "left").select("run_id", "tool_call_id", F.col("f.event_id").alias("failed_event_id"), kind.alias("failure_kind"), impact.alias("impact"))


def repeated_tasks(rows: DataFrame, keys: list[str], trace: str, score: str, least: int, limit: int) -> DataFrame:
    """The tasks that several traces repeat, the best first: ``keys, traces, best_score`` (a top-n)."""
    grouped = rows.groupBy(*keys).agg(F.count_distinct(trace).alias("traces"), F.max(score).alias("best_score"))
    return grouped.filter(F.col("traces") >= least).orderBy(F.desc("traces"), F.desc("best_score"), *keys).limit(limit)


def coerced(params: Column, spec: dict[str, str], required: tuple[str, ...] = ()) -> list[Column]:
    """A map of texts as typed columns (``spec``: name to SQL type), and ``errors``: the names that lack a value or have none of the type."""
    typed = {name: F.try_element_at(params, F.lit(name)).try_cast(kind) for name, kind in spec.items()}
    wrong = [F.when(F.try_element_at(params, F.lit(n)).isNotNull() & c.isNull(), F.lit(f"{n}: no {spec[n]}")) for n, c in typed.items()]
    absent = [F.when(F.try_element_at(params, F.lit(n)).isNull(), F.lit(f"{n}: missing")) for n in required]
    return [*[c.alias(n) for n, c in typed.items()], F.array_compact(F.array(*wrong, *absent)).alias("errors")]
