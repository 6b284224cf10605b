"""References to records that do not exist: missing, deleted, or recorded only later.

Method: parent keys are integers (space, hi, lo). Parent keys and referenced keys are sorted together by a range partitioning;
in the sorted stream live parent keys are compressed into runs of contiguous integers, and every referenced key is matched
as-of to the last run that starts at or before it: it is missing if that run ends before it, else its parent's own time is the
one at its distance from the run's start. Runs are cut at the borders of ranges, which changes no match, since a key and the
run that could hold it lie in the same range. Random keys make runs of length 1, dense keys (:func:`dense`) long ones.

Skew: parent keys are made unique before they move (map-side); ranges are cut by the keys themselves, so no block of ids,
however alike, meets in one task. The rows of a key that very many refer to stay where they are: one row stands for them in
the stream, and what it finds is joined back by a broadcast of at most ``skew.HOT`` keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.functions.ids import canonical, halves, reference
from loomtrace.operators.skew import crowded_values
from loomtrace.session import written

KEY = ["space", "hi", "lo"]
#: Low bits of a plain integer key that are its offset in a block.
BLOCK_BITS = 16


def dense(key: Column) -> list[Column]:
    """``hi`` and ``lo`` of a plain integer key."""
    return [F.shiftright(key, BLOCK_BITS).alias("hi"), key.alias("lo")]


def key_runs(parents: DataFrame) -> DataFrame:
    """Unique parent keys ``space, hi, lo, at`` as runs ``space, hi, lo (start), run_end, run_size, first_at, last_at``.

    A table of all runs, for reports on dense keys: a run ends where its ``hi`` does, so no window holds more than a block
    (65 536 keys of the dense mapping).
    """
    order = Window.partitionBy("space", "hi").orderBy("lo")
    # Two keys at the ends of the 64-bit range are further apart than 64 bits hold: no neighbours either.
    starts = F.coalesce(F.try_subtract("lo", F.lag("lo").over(order)) != 1, F.lit(True)).cast("int")
    numbered = parents.withColumn("_starts", starts).withColumn("_island", F.sum("_starts").over(order))
    return (
        numbered.groupBy("space", "hi", "_island")
        .agg(F.min("lo").alias("lo"), F.max("lo").alias("run_end"), F.count("*").alias("run_size"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
        .drop("_island")
    )


def _changes(column: pa.Array) -> np.ndarray:
    """Where a sorted column's value differs from the one before (the first row counts as different)."""
    codes = column.dictionary_encode().indices.to_numpy()
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows ``space, hi, lo, kind, at, gone``: the referenced keys (kind 1) beyond a run, or older than their parent.

    Kind 0 are known keys (``at`` null where only a deletion names them). Between batches only the last known key is carried:
    a later reference can lie in a run that began before only if it equals that key.
    """
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        skip = 0 if carry is None else 1
        hi, lo, kind = (table.column(c).to_numpy() for c in ("hi", "lo", "kind"))
        there, gone = (table.column(c).to_numpy(zero_copy_only=False) for c in ("there", "gone"))
        at, timed = table.column("at").fill_null(0).to_numpy(), table.column("at").is_valid().to_numpy(zero_copy_only=False)
        block = np.cumsum(_changes(table.column("space")) | np.concatenate([[True], hi[1:] != hi[:-1]]))

        # Runs of live keys: contiguous integers of one block; differences of 64-bit keys wrap, so none overflows.
        live = np.flatnonzero((kind == 0) & there & ~gone)
        key = lo[live].view(np.uint64)
        starts = np.concatenate([[True], (block[live][1:] != block[live][:-1]) | (key[1:] - key[:-1] != 1)])[: len(live)]
        first = np.flatnonzero(starts)
        size = np.diff(np.append(first, len(live)))

        asked = np.flatnonzero(kind == 1)
        asked = asked[asked >= skip]
        # As-of: the last run that starts at or before the key; then how far beyond its start the key lies.
        run = np.searchsorted(live[first], asked, "right") - 1
        safe = np.maximum(run, 0)
        if len(first):
            start = live[first][safe]
            far = lo[asked].view(np.uint64) - lo[start].view(np.uint64)
            inside = (run >= 0) & (block[start] == block[asked]) & (far < size[safe].astype(np.uint64))
            own = live[np.where(inside, first[safe] + far.astype(np.int64) * inside, 0)]
        else:
            inside, own = np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        later = inside & timed[own] & timed[asked] & (at[own] > at[asked])
        # A key beyond its run was deleted if a deletion names it: such a row stands right before it.
        known = np.flatnonzero(kind == 0)
        before = np.searchsorted(known, asked) - 1
        last = known[np.maximum(before, 0)] if len(known) else np.zeros(len(asked), np.int64)
        same = (before >= 0) & (block[last] == block[asked]) & (lo[last] == lo[asked])
        out = ~inside | later
        rows = pa.array(asked[out])
        target = pa.array(at[own[out]], mask=~(inside[out] & timed[own[out]]))
        yield pa.RecordBatch.from_arrays([*[table.column(c).take(rows) for c in [*KEY, "row"]], pa.array(~inside[out]), pa.array((same & gone[last])[out]), target], [*KEY, "row", "beyond", "gone", "target_at"])
        carry = table.slice(int(known[-1]), 1) if len(known) else None


def orphan_references(references: DataFrame, parents: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The rows of ``references`` whose target is missing, deleted or younger, with ``reason`` and ``target_at``.

    references: ``space, hi, lo`` (the key referred to), ``at`` (bigint, when the row was recorded) and any other columns.
    parents: ``space, hi, lo, at``, in any number of rows per key; the earliest counts. deleted: ``space, hi, lo``.
    reason is ``missing`` (no such parent), ``deleted``, or ``later`` (the parent's ``at`` is greater than the row's).
    Rows with a null key are no references and never come out; a null ``at`` on either side is never later. Repeated rows of
    ``references`` come out as often as they go in. Empty tables: without parents all references are missing. ``space`` may be
    of any type; ``hi`` and ``lo`` are bigint, over their whole range.
    """
    whole = F.col("hi").isNotNull() & F.col("lo").isNotNull() & F.col("space").isNotNull()
    integers = ["space", F.col("hi").cast("bigint").alias("hi"), F.col("lo").cast("bigint").alias("lo")]
    spaces = parents.filter(whole).select(*integers, F.col("at").cast("bigint").alias("at"), F.lit(False).alias("gone"), F.lit(True).alias("there"))
    if deleted is not None:
        spaces = spaces.unionByName(deleted.filter(whole).select(*integers, F.lit(None).cast("bigint").alias("at"), F.lit(True).alias("gone"), F.lit(False).alias("there")))
    known = written(spaces.groupBy(*KEY).agg(F.min("at").alias("at"), F.max("gone").alias("gone"), F.max("there").alias("there")))
    rows = written(references.filter(whole).withColumn("hi", F.col("hi").cast("bigint")).withColumn("lo", F.col("lo").cast("bigint")))
    row, none = F.struct(*[c for c in rows.columns if c not in KEY]), F.lit(False)
    hashed = F.xxhash64(*KEY)
    crowded = crowded_values(rows.select(hashed.alias("h")))
    asked = rows.filter(~hashed.isin(crowded)) if crowded else rows
    asked = asked.select(*KEY, F.lit(1).alias("kind"), F.col("at").cast("bigint").alias("at"), none.alias("gone"), none.alias("there"), row.alias("row"))
    if crowded:  # one row stands for all rows of a crowded key
        once = rows.filter(hashed.isin(crowded)).groupBy(*KEY).agg(F.min("at").cast("bigint").alias("at"))
        asked = asked.unionByName(once.select(*KEY, F.lit(1).alias("kind"), "at", none.alias("gone"), none.alias("there")), allowMissingColumns=True)
    both = known.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    ordered = both.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "kind")
    kept = [*KEY, "row"]
    shape = T.StructType([*[T.StructField(c, both.schema[c].dataType) for c in kept], T.StructField("beyond", T.BooleanType()), T.StructField("gone", T.BooleanType()), T.StructField("target_at", T.LongType())])
    matched = ordered.mapInArrow(_match, shape)
    found = matched
    if crowded:
        matched = written(matched)
        found = matched.filter("row is not null")
    found = found.select(*[F.col(c) if c in KEY else F.col(f"row.{c}").alias(c) for c in rows.columns], "beyond", "gone", "target_at")
    if crowded:  # at most ``HOT`` keys
        found = found.unionByName(rows.join(F.broadcast(matched.filter("row is null").drop("row")), KEY))
    reason = F.when(F.col("beyond") & F.col("gone"), "deleted").when(F.col("beyond"), "missing").when(F.col("target_at") > F.col("at"), "later")
    return found.withColumn("reason", reason).filter("reason is not null").drop("beyond", "gone")


def log_references(audit_events: DataFrame, node_relations: DataFrame) -> DataFrame:
    """All references of the event log: ``ref_table, ref_field, ref_key, space, hi, lo, at``.

    One row per event (or relation) and referenced value; repeated deliveries count once, with their earliest time. Texts
    that are no references are left out. Rows without a key are left out, since nothing could name them.
    """
    event = audit_events.select(
        canonical(F.col("event_id")).alias("ref_key"), F.unix_micros("recorded_at").alias("at"), reference(F.col("caused_by_event_id")).alias("caused"), reference(F.col("parent_run_id")).alias("parent")
    )
    named = F.array(
        F.struct(F.lit("caused_by_event_id").alias("ref_field"), F.lit(0).alias("space"), F.col("caused").alias("ref")),
        F.struct(F.lit("parent_run_id").alias("ref_field"), F.lit(1).alias("space"), F.col("parent").alias("ref")),
    )
    of_events = event.filter("caused is not null or parent is not null").select(F.lit("audit_events").alias("ref_table"), "ref_key", "at", F.inline(named))
    of_relations = node_relations.select(
        F.lit("node_relations").alias("ref_table"), F.col("relation_id").cast("string").alias("ref_key"), F.unix_micros("built_at").alias("at"),
        F.lit("raw_target_event_id").alias("ref_field"), F.lit(0).alias("space"), reference(F.col("raw_target_event_id")).alias("ref"),
    )
    every = of_events.unionByName(of_relations).filter("ref is not null and ref_key is not null")
    hi, lo = halves(F.col("ref"), "k")
    keyed = every.select("ref_table", "ref_field", "ref_key", "space", hi.alias("hi"), lo.alias("lo"), "at")
    return keyed.groupBy("ref_table", "ref_field", "ref_key", *KEY).agg(F.min("at").alias("at"))


def log_parents(audit_events: DataFrame) -> DataFrame:
    """What can be referred to: events (space 0) by event_id and started runs (space 1) by run_id."""
    hi, lo = halves(reference(F.col("event_id")), "k")
    events = audit_events.select(F.lit(0).alias("space"), hi.alias("hi"), lo.alias("lo"), F.unix_micros("recorded_at").alias("at"))
    hi, lo = halves(reference(F.col("run_id")), "k")
    runs = audit_events.filter(F.col("event_type") == "run_started").select(F.lit(1).alias("space"), hi.alias("hi"), lo.alias("lo"), F.unix_micros("recorded_at").alias("at"))
    return events.unionByName(runs)


def log_deletions(tombstones: DataFrame) -> DataFrame:
    """Deleted events and runs as keys."""
    hi, lo = halves(reference(F.col("object_id")), "k")
    space = F.when(F.col("object_type") == "event", 0).when(F.col("object_type") == "run", 1)
    return tombstones.select(space.alias("space"), hi.alias("hi"), lo.alias("lo")).filter("space is not null")


def log_orphans(audit_events: DataFrame, node_relations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Orphan references of the event log: ``ref_table, ref_field, ref_key, reason, at`` (one row per referring row)."""
    return orphan_references(log_references(audit_events, node_relations), log_parents(audit_events), log_deletions(tombstones))


def orphans_per_week(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, week of the referring row (Monday, UTC) and reason."""
    week = F.date_trunc("week", F.timestamp_micros("at")).cast("date").alias("week")
    return orphans.groupBy("ref_table", "ref_field", week, "reason").agg(F.count("*").alias("n_orphans"))


def sequence_parents(audit_events: DataFrame) -> DataFrame:
    """The places of segments that hold an event, as dense keys: ``space`` (segment_id), ``hi, lo`` (segment_sequence), ``at``."""
    placed = audit_events.filter("segment_id is not null and segment_sequence is not null")
    return placed.select(F.col("segment_id").alias("space"), *dense(F.col("segment_sequence")), F.unix_micros("recorded_at").alias("at"))


def sequence_orphans(audit_events: DataFrame) -> DataFrame:
    """Events whose predecessor in the segment is missing or was recorded only later: ``segment_id, segment_sequence, event_id, reason``.

    An event at place n > 1 refers to place n - 1 of its segment. Deliveries of an event count once, with their earliest time.
    """
    once = audit_events.filter("segment_id is not null and segment_sequence > 1").groupBy("event_id", "segment_id", "segment_sequence")
    rows = once.agg(F.min(F.unix_micros("recorded_at")).alias("at"))
    references = rows.select("event_id", "segment_sequence", F.col("segment_id").alias("space"), *dense(F.col("segment_sequence") - 1), "at")
    return orphan_references(references, sequence_parents(audit_events)).select(F.col("space").alias("segment_id"), "segment_sequence", "event_id", "reason")


def sequence_runs(audit_events: DataFrame) -> DataFrame:
    """The unbroken stretches of every segment: ``segment_id, first_sequence, last_sequence, n_places``."""
    places = sequence_parents(audit_events).groupBy(*KEY).agg(F.min("at").alias("at"))
    return key_runs(places).select(F.col("space").alias("segment_id"), F.col("lo").alias("first_sequence"), F.col("run_end").alias("last_sequence"), F.col("run_size").alias("n_places"))
