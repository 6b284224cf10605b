"""References: values that are UUIDs once white space, letter case, braces and a ``urn:uuid:`` prefix are put aside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a UUID and what may stand around it.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
BLANK = r"[\s\p{Z}​﻿]*"
DRESSED = rf"(?i)^{BLANK}(?:urn:uuid:)?{BLANK}(?:\{{{BLANK}(?:urn:uuid:)?({UUID}){BLANK}\}}|({UUID})){BLANK}$"


def reference(value: Column) -> Column:
    """``value`` in the form in which ids are compared, or null where it is no reference.

    A lone brace, a UUID without dashes and any other text are no references. Null stays null.
    """
    bare = F.lower(F.regexp_replace(value, DRESSED, "$1$2"))
    dressed = F.when((F.length(bare) == 36) & bare.rlike(f"^{UUID}$"), bare)
    # Most values are in that form already; only the others go through the slower pattern.
    return F.when(value.rlike(rf"\A{UUID}\z"), value).otherwise(dressed)


def canonical(value: Column) -> Column:
    """An id column's own value in comparable form: as :func:`reference`, other texts trimmed; null stays null."""
    return F.when(value.rlike(rf"\A{UUID}\z"), value).otherwise(F.coalesce(reference(value), F.trim(value)))


def _half(ref: Column, first: bool) -> Column:
    digits = (
        F.concat(F.substring(ref, 1, 8), F.substring(ref, 10, 4), F.substring(ref, 15, 4))
        if first
        else F.concat(F.substring(ref, 20, 4), F.substring(ref, 25, 12))
    )
    return F.conv(digits, 16, -10).cast("bigint")


def halves(ref: Column, prefix: str) -> list[Column]:
    """The two signed 64-bit halves of a reference, as ``<prefix>_hi`` and ``<prefix>_lo``."""
    return [_half(ref, True).alias(f"{prefix}_hi"), _half(ref, False).alias(f"{prefix}_lo")]


def text_of(hi: Column, lo: Column) -> Column:
    """The canonical text of two halves."""
    a, b = F.lpad(F.lower(F.hex(hi)), 16, "0"), F.lpad(F.lower(F.hex(lo)), 16, "0")
    return F.concat_ws("-", F.substring(a, 1, 8), F.substring(a, 9, 4), F.substring(a, 13, 4), F.substring(b, 1, 4), F.substring(b, 5, 12))
