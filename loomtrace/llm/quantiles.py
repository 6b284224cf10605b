"""Exact and bounded-error percentiles per group over very large columns, in a form that combines across days.

Form: a summary is a set of rows ``metric, dim, grp, day, value, n``: how often a value (or value bucket) occurs on a day. Summaries
of other days or partitions are combined by putting their rows together. With ``bits=None`` the values are exact; with ``bits=b``
a value keeps its b leading binary digits, so a group has at most 2^b buckets per power of two whatever the number of rows,
and the bucket's midpoint is off by at most 2^-b of the value; values below 2^b in size stay exact.

Method: distributed multi-select. The counted values lie in sorted chunks, at least one for each day and partition of a group; in
each round the chunks count three ways (below, equal to and above the pivot of each wanted rank) and propose their local weighted
medians within the range that stays possible on either side of it; the range ruled out is discarded, and the weighted median of
the other side's proposals becomes the next pivot, per group until the rank is found. There is no other way to a result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.session import settled, written

GROUP = ["metric", "dim", "grp"]
#: Values in a chunk at most: bounds a row of the chunk table (16 bytes a value), whatever a group holds.
CHUNK = 512
#: A state of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


def bucketed(value: Column, bits: int | None) -> Column:
    """The lower end of the bucket of an integer value: its ``bits`` leading binary digits, sign kept."""
    if bits is None:
        return value
    size = F.abs(value)
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - bits).cast("int")
    low = F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)
    return F.when(value < 0, -low).otherwise(low)


def bucket_width(low: Column, bits: int | None) -> Column:
    """How many integers share the bucket that starts (toward zero) at ``low``."""
    if bits is None:
        return F.lit(1).cast("bigint")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), F.length(F.bin(F.abs(low))) - bits).cast("int"))


def summaries(values: DataFrame, bits: int | None = None) -> DataFrame:
    """Rows ``metric, dim, grp, day, value`` counted as ``n``; null values are left out, null names of a group are ``(none)``."""
    named = [F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in GROUP]
    kept = values.filter("value is not null").select(*named, "day", bucketed(F.col("value").cast("bigint"), bits).alias("value"))
    return kept.groupBy(*GROUP, "day", "value").agg(F.count("*").alias("n"))


def combine(summary: DataFrame, *others: DataFrame) -> DataFrame:
    """Summaries of separate days or partitions as one: their rows together, in one form."""
    columns = [*GROUP, "day", "value", "n"]
    summary = summary.select(*columns)
    for other in others:
        summary = summary.unionByName(other.select(*columns))
    return summary


def chunked(combined: DataFrame) -> DataFrame:
    """``metric, dim, grp, values, counts``: the counted values of a group and day in a partition, in sorted chunks of ``CHUNK`` or fewer.

    The rows stay in the partitions in which they were counted. Equal values in several chunks are as good as one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in [*GROUP, "day"]])
            starts = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(0)]))
            ends = np.append(starts[1:], batch.num_rows)
            begin = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(starts, ends)])
            offsets = pa.array(np.append(begin, batch.num_rows).astype(np.int32))
            named = [batch.column(c).take(pa.array(begin)) for c in GROUP]
            yield pa.RecordBatch.from_arrays([*named, *[pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("value", "n")]], [*GROUP, "values", "counts"])

    typed = combined.select(*GROUP, "day", F.col("value").cast("bigint").alias("value"), F.col("n").cast("bigint").alias("n"))
    return typed.sortWithinPartitions(*GROUP, "day", "value").mapInArrow(pack, "metric string, dim string, grp string, values array<bigint>, counts array<bigint>")


def search(values: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """For each k the place of ``x[k]`` in the sorted stretch ``values[a[k]:b[k]]``, all stretches halved together."""
    a, b = a.copy(), b.copy()
    while (a < b).any():
        mid = np.minimum((a + b) >> 1, len(values) - 1)
        go = (a < b) & ((values[mid] <= x) if right else (values[mid] < x))
        a, b = np.where(go, mid + 1, a), np.where((a < b) & ~go, mid, b)
    return a


class _Met:
    """A batch of chunks that met their groups' wanted ranks, one entry for each chunk and rank."""

    def __init__(self, batch: pa.RecordBatch, asked: Sequence[str]):
        lists, wanted = batch.column("values"), batch.column("qs")
        self.values, counts = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
        self.upto = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(lists.value_lengths().to_numpy())
        of = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
        self.begin, self.end = np.concatenate([[0], ends[:-1]])[of], ends[of]
        self.q, self.asked = wanted.flatten().to_numpy(), [batch.column(c).flatten().to_numpy() for c in asked]
        names = pa.StructArray.from_arrays([batch.column(c) for c in GROUP], GROUP)
        codes = np.stack([batch.column(c).dictionary_encode().indices.to_numpy() for c in GROUP])
        _, first, code = np.unique(codes, axis=1, return_index=True, return_inverse=True)
        self.pair, at = np.unique(np.stack([code.reshape(-1)[of].astype(float), self.q]), axis=1, return_inverse=True)
        self.at = at.reshape(-1)
        self.names = names.take(pa.array(first[self.pair[0].astype(np.int64)]))

    def medians(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the stretches ``a:b`` of all chunks the weighted median of their weighted medians for each wanted rank, and the weight."""
        out, total = np.zeros(self.pair.shape[1], np.int64), np.zeros(self.pair.shape[1], np.int64)
        some = np.flatnonzero(b > a)
        if not len(some):
            return out, total
        a, b, at = a[some], b[some], self.at[some]
        weight = self.upto[b] - self.upto[a]
        median = self.values[np.searchsorted(self.upto, self.upto[a] + (weight + 1) // 2) - 1]
        order = np.lexsort((median, at))
        at, median, upto = at[order], median[order], np.cumsum(weight[order])
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        before = np.concatenate([[0], upto])[first]
        total[at[first]] = np.diff(np.append(before, upto[-1]))
        out[at[first]] = median[np.searchsorted(upto, before + (total[at[first]] + 1) // 2)]
        return out, total

    def sums(self, n: np.ndarray) -> np.ndarray:
        out = np.zeros(self.pair.shape[1], np.int64)
        np.add.at(out, self.at, n)
        return out


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the batch's chunks below and equal to each pivot, and proposals for the next one on either side of it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        met = _Met(batch, ["los", "pivots", "his"])
        lo, pivot, hi = met.asked
        start, end = search(met.values, met.begin, met.end, lo, False), search(met.values, met.begin, met.end, hi, True)
        low, high = search(met.values, met.begin, met.end, pivot, False), search(met.values, met.begin, met.end, pivot, True)
        left, right = met.medians(start, np.maximum(low, start)), met.medians(np.minimum(high, end), end)
        keys = [met.names.field(c) for c in GROUP]
        numbers = [met.sums(met.upto[low] - met.upto[met.begin]), met.sums(met.upto[high] - met.upto[low]), *left, *right]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(met.pair[1]), *map(pa.array, numbers)], [*GROUP, "q", "below", "equal", "left", "left_n", "right", "right_n"])


_ROUND = "metric string, dim string, grp string, q double, below bigint, equal bigint, left bigint, left_n bigint, right bigint, right_n bigint"


def _weighted_median(side: str) -> Column:
    """Aggregate: the weighted median of the proposals of one side (one a batch of chunks), null if there is none."""
    proposed = F.array_sort(F.collect_list(F.when(F.col(f"{side}_n") > 0, F.struct(F.col(side).alias("m"), F.col(f"{side}_n").alias("w")))))
    total = F.aggregate(proposed, F.lit(0).cast("bigint"), lambda acc, x: acc + x["w"])
    # The sum so far until it reaches half of all; then it stays below zero, and the median is kept.
    begin = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("m"))
    step = lambda acc, x: F.struct((acc["upto"] + x["w"]).alias("upto"), F.when(acc["m"].isNull() & (2 * (acc["upto"] + x["w"]) >= total), x["m"]).otherwise(acc["m"]).alias("m"))
    return F.aggregate(proposed, begin, step)["m"]


def _meet(chunks: DataFrame, state: DataFrame, n_state: int, columns: Sequence[str]) -> DataFrame:
    """Chunks with their group's wanted ranks, one row a chunk; the state is broadcast only while it is small."""
    wanted = state.groupBy(*GROUP).agg(F.collect_list(F.struct(*columns)).alias("w"))
    wanted = wanted.select(*GROUP, *[F.col(f"w.{c}").alias(f"{c}s") for c in columns])
    return chunks.join(F.broadcast(wanted) if n_state <= BROADCAST_ROWS else wanted, GROUP)


def multi_select(combined: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """``metric, dim, grp, q, n, value``: for each q the smallest value with at least ceil(q * n) of the group's n rows at or
    below it (at least rank 1). Exact over ``combined`` (:func:`combine`). A group without values has no row. Ties need no rule:
    equal values are one, on whatever days. Without rows nothing comes out.
    """
    return settled(combined.sparkSession, lambda: _select(combined, fractions))


def _select(combined: DataFrame, fractions: Sequence[float]) -> DataFrame:
    chunks = written(chunked(combined))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    group = chunks.groupBy(*GROUP).agg(F.sum(total).alias("n"), F.min(F.element_at("values", 1)).alias("lo"), F.max(F.element_at("values", -1)).alias("hi"))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in fractions])).alias("q")
    # Rank by integers, so that no rounding of q * n moves it.
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 6))).cast("bigint")
    # The first pivot lies before all values, so that the first round only proposes.
    state = written(group.select(*GROUP, asked, "n", "lo", "hi", F.coalesce(F.try_subtract("lo", F.lit(1).cast("bigint")), "lo").alias("pivot")).withColumn("rank", rank))
    found: list[DataFrame] = []
    while n_state := state.count():
        counted = _meet(chunks, state, n_state, ["q", "lo", "pivot", "hi"]).mapInArrow(_round, _ROUND)
        ways = counted.groupBy(*GROUP, "q").agg(F.sum("below").alias("below"), F.sum("equal").alias("equal"), _weighted_median("left").alias("left"), _weighted_median("right").alias("right"))
        judged = written(state.join(ways, [*GROUP, "q"]))
        here = (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("equal"))
        found.append(judged.filter(here).select(*GROUP, "q", "n", F.col("pivot").alias("value")))
        down = F.col("rank") <= F.col("below")
        lo, hi = F.when(down, F.col("lo")).otherwise(F.col("pivot") + 1), F.when(down, F.col("pivot") - 1).otherwise(F.col("hi"))
        state = judged.filter(~here).select(*GROUP, "q", "n", lo.alias("lo"), hi.alias("hi"), F.when(down, F.col("left")).otherwise(F.col("right")).alias("pivot"), "rank")
    out = state.select(*GROUP, "q", "n", F.col("lo").alias("value"))
    for part in found:
        out = out.unionByName(part)
    return out


def with_bounds(result: DataFrame, bits: int | None) -> DataFrame:
    """Percentiles of bucketed values with ``low, high`` (the true percentile lies between them) and the midpoint ``estimate``."""
    far = F.col("value") + F.when(F.col("value") < 0, -1).otherwise(1) * (bucket_width(F.col("value"), bits) - 1)
    return result.withColumn("low", F.least("value", far)).withColumn("high", F.greatest("value", far)).withColumn("estimate", (F.col("low") + F.col("high")) / 2).drop("value")


def log_values(audit_events: DataFrame) -> DataFrame:
    """elapsed_ms and total_tokens of every event per model and per tool: ``metric, dim, grp, day, value``.

    Repeated deliveries count once. Model and tool names are compared trimmed and in lower case; a missing name is the group
    ``(none)``. Zero, negative and very large values count as they are; null values don't count. day is the UTC date.
    """
    name = lambda c: F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit("(none)"))
    rows = audit_events.filter("elapsed_ms is not null or total_tokens is not null")
    once = rows.select("event_id", name("model").alias("model"), name("tool_name").alias("tool_name"), F.to_date("occurred_at").alias("day"), "elapsed_ms", "total_tokens").distinct()
    pairs = [
        F.struct(F.lit(m).alias("metric"), F.lit(d).alias("dim"), F.col(d).alias("grp"), F.col(m).alias("value"))
        for m in ("elapsed_ms", "total_tokens")
        for d in ("model", "tool_name")
    ]
    return once.select("day", F.inline(F.array(*pairs))).filter("value is not null")
