"""Comparing and locating texts: line differences, fuzzy windows, match cascades, canonical JSON, schedules.

These are folds over the characters or lines of one value, which no built-in expresses; they run over Arrow batches.
"""

from __future__ import annotations

import datetime as dt
import difflib
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTES = str.maketrans("‘’“”«»", "''\"\"\"\"")


def canonical_json(text: str | None) -> str | None:
    """JSON text with sorted keys and no blanks; None for null and for what is no JSON."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def json_digest(texts: pd.Series) -> pd.Series:
    """``sha256:`` and the digest of the canonical JSON: equal for equal values however they are written."""

    def one(text):
        canonical = canonical_json(text)
        return None if canonical is None else "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()

    return texts.map(one)


def line_changes(before: str | None, after: str | None) -> tuple[int, int]:
    """Lines added and deleted; with a null on either side there is nothing to compare: none."""
    added = deleted = 0
    if before is None or after is None:
        return 0, 0
    for tag, i, j, k, m in difflib.SequenceMatcher(None, before.splitlines(), after.splitlines(), autojunk=False).get_opcodes():
        if tag != "equal":
            deleted, added = deleted + j - i, added + m - k
    return added, deleted


@F.pandas_udf(T.StructType([T.StructField("added", T.IntegerType()), T.StructField("deleted", T.IntegerType())]))
def diff_stats(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """:func:`line_changes` of two columns."""
    return pd.DataFrame([line_changes(a, b) for a, b in zip(before, after)], columns=["added", "deleted"])


def unified_diff(before: str | None, after: str | None, max_lines: int = 400) -> str:
    """A unified diff of at most ``max_lines`` lines, with a note of how many are missing."""
    lines = list(difflib.unified_diff((before or "").splitlines(), (after or "").splitlines(), lineterm="", n=3))
    return "\n".join(lines[:max_lines] + ([f"... {len(lines) - max_lines} more lines"] if len(lines) > max_lines else []))


def best_window(text: str, wanted: str) -> tuple[float, int]:
    """The ratio and first line (from 1) of the window of as many lines as ``wanted`` has that shares most lines with it."""
    lines, want = text.splitlines(keepends=True), wanted.splitlines(keepends=True)
    if not lines or not want:
        return 0.0, 0
    best = (0.0, 0)
    matcher = difflib.SequenceMatcher()
    matcher.set_seq2(want)
    for i in range(max(1, len(lines) - len(want) + 1)):
        matcher.set_seq1(lines[i : i + len(want)])
        if matcher.real_quick_ratio() > best[0] and matcher.quick_ratio() > best[0] and (ratio := matcher.ratio()) > best[0]:
            best = (ratio, i + 1)
    return best


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("line", T.IntegerType())]))
def nearest_lines(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    """:func:`best_window` of two columns; null on either side finds nothing."""
    return pd.DataFrame([best_window(t or "", w or "") for t, w in zip(texts, wanted)], columns=["ratio", "line"])


@F.pandas_udf(T.IntegerType())
def match_count(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    """How often :func:`find_spans` finds one column's text in the other's."""
    return pd.Series([len(find_spans(t or "", w or "")) for t, w in zip(texts, wanted)])


def find_spans(text: str, wanted: str) -> list[tuple[int, int]]:
    """Where ``wanted`` stands: exactly, else line by line with outer blanks aside, else with quotation marks made plain (as it
    stands, then line by line)."""
    if not wanted:
        return []
    exact = [(m.start(), m.end()) for m in re.finditer(re.escape(wanted), text)]
    if exact:
        return exact
    plain = [(m.start(), m.end()) for m in re.finditer(re.escape(wanted.translate(QUOTES)), text.translate(QUOTES))]
    for tidy in (str.strip, None, lambda s: s.strip().translate(QUOTES)):
        if tidy is None:  # quotation marks alone; every one is a character for a character
            if plain:
                return plain
            continue
        lines = text.splitlines(keepends=True)
        starts = [0]
        for line in lines:
            starts.append(starts[-1] + len(line))
        want = [tidy(x) for x in wanted.splitlines()]
        have = [tidy(x) for x in lines]
        found = [(starts[i], starts[i + len(want)]) for i in range(len(have) - len(want) + 1) if have[i : i + len(want)] == want]
        if found:
            return found
    return []


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]))
        if step and span != "*" and "-" not in span:
            b = high
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def next_cron(expression: str, after: dt.datetime) -> dt.datetime | None:
    """The first minute after ``after`` that a five-field cron expression names (Sunday is 0 or 7); None within four years."""
    minute, hour, day, month, weekday = expression.split()
    minutes, hours, days, months = _field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12)
    weekdays = {d % 7 for d in _field(weekday, 0, 7)}
    at = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    end = after + dt.timedelta(days=4 * 366)
    while at < end:
        own, named = at.day in days, at.isoweekday() % 7 in weekdays
        fits = (own or named) if day != "*" and weekday != "*" else own and named
        if at.month not in months or not fits:
            at = (at + dt.timedelta(days=1)).replace(hour=0, minute=0)
        elif at.hour not in hours:
            at = (at + dt.timedelta(hours=1)).replace(minute=0)
        elif at.minute not in minutes:
            at += dt.timedelta(minutes=1)
        else:
            return at
    return None


@F.pandas_udf(T.TimestampType())
def next_run(expressions: pd.Series, after: pd.Series) -> pd.Series:
    """:func:`next_cron` of a column of expressions; null for null and for what is no expression."""

    def one(expression, at):
        try:
            return next_cron(expression, at.to_pydatetime()) if expression and at is not pd.NaT else None
        except ValueError:
            return None

    return pd.Series([one(e, a) for e, a in zip(expressions, after)], dtype="datetime64[us]")
