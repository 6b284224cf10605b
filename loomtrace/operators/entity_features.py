"""One wide row per entity from an event log: count, recency and totals of every event type and its status.

Method: deliveries are made unique, then counted per (entity, type, status) with a map-side combine, so that an entity with a
third of all events moves as a few cells; entities are hash-bucketed over the tasks; in each bucket cells are scattered by
numpy (bincount for sums, maximum scatter for recency) into dense blocks of entities x features, emitted as Arrow columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.functions.ids import canonical

#: The type under which event types that no catalog lists are counted.
UNLISTED = "unlisted"
#: Cells (entities x types x statuses) of a dense block.
CELLS = 1_000_000
#: A catalog may list so many types; they become columns.
MAX_TYPES = 2_000
#: So many statuses may occur; they become slots of arrays.
MAX_STATUSES = 2_000


def catalog_types(catalog: DataFrame) -> list[str]:
    """The catalog's types, trimmed, in lower case, sorted. More than ``MAX_TYPES`` is an error: columns are no place for them."""
    names = catalog.select(F.lower(F.trim("event_type")).alias("t")).filter("t is not null and t <> ''").distinct().limit(MAX_TYPES + 1).collect()
    if len(names) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    return sorted({r.t for r in names} - {UNLISTED}) + [UNLISTED]


def _status() -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("none"))


def occurring_statuses(events: DataFrame) -> list[str]:
    """The statuses of events of runs, trimmed, in lower case, sorted, then ``none``. More than ``MAX_STATUSES`` is an error."""
    names = events.filter("run_id is not null").select(_status().alias("s")).distinct().limit(MAX_STATUSES + 1).collect()
    if len(names) > MAX_STATUSES:
        raise ValueError(f"more than {MAX_STATUSES} statuses")
    return sorted({r.s for r in names} - {"none"}) + ["none"]


def cells(events: DataFrame) -> DataFrame:
    """``run_id, event_type, status, n, last_at, elapsed_ms, total_tokens``: one row per run, type and status that occurs.

    Deliveries of an event count once. Types and statuses are trimmed and in lower case; a missing status is ``none``, a
    missing type ``unlisted``. Events without a run belong to no entity. Null and negative totals add nothing.
    """
    kind = F.coalesce(F.lower(F.trim("event_type")), F.lit(UNLISTED))
    own = ["event_id", canonical(F.col("run_id")).alias("run_id"), kind.alias("event_type"), _status().alias("status"), F.unix_micros("occurred_at").alias("at"), "elapsed_ms", "total_tokens"]
    once = events.filter("run_id is not null").select(*own).distinct()
    total = lambda c: F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))).cast("bigint").alias(c)
    return once.groupBy("run_id", "event_type", "status").agg(F.count("*").alias("n"), F.max("at").alias("last_at"), total("elapsed_ms"), total("total_tokens"))


#: Prefixes of the arrays by status slot and the types of their elements; times as microseconds since 1970, null where none.
BY_STATUS = {"statuses": T.IntegerType(), "status_last": T.LongType(), "status_elapsed_ms": T.LongType(), "status_total_tokens": T.LongType()}


def schema(types: Sequence[str]) -> T.StructType:
    """run_id, n_events, last_at, ``status_slots`` (the names of the slots), then per type ``n_, last_, elapsed_ms_, total_tokens_``
    and by status slot ``statuses_`` (counts) and the arrays of ``BY_STATUS``."""
    fields = [T.StructField("run_id", T.StringType()), T.StructField("n_events", T.LongType()), T.StructField("last_at", T.TimestampType()), T.StructField("status_slots", T.ArrayType(T.StringType()))]
    for t in types:
        fields += [T.StructField(f"n_{t}", T.LongType()), T.StructField(f"last_{t}", T.TimestampType()), T.StructField(f"elapsed_ms_{t}", T.LongType()), T.StructField(f"total_tokens_{t}", T.LongType())]
        fields += [T.StructField(f"{p}_{t}", T.ArrayType(kind)) for p, kind in BY_STATUS.items()]
    return T.StructType(fields)


def _dense(types: Sequence[str], slots: Sequence[str]):
    n_t, n_s = len(types), len(slots)
    # More columns, fewer entities in a block: its size stays.
    entities = max(1, CELLS // (n_t * n_s))
    known_types, known_slots = pa.array(types), pa.array(slots)

    def block(table: pa.Table) -> pa.RecordBatch:
        # Rows come sorted by run, so a change of the run starts the next entity.
        runs = table.column("run_id").combine_chunks()
        codes = runs.dictionary_encode()
        entity, names = codes.indices.to_numpy(), codes.dictionary
        kind = pc.fill_null(pc.index_in(table.column("event_type"), known_types), n_t - 1).to_numpy().astype(np.int64)
        slot = pc.fill_null(pc.index_in(table.column("status"), known_slots), n_s - 1).to_numpy().astype(np.int64)
        of = {c: table.column(c).to_numpy() for c in ("n", "last_at", "elapsed_ms", "total_tokens")}
        n_e, cell = len(names), entity * n_t + kind

        def add(at: np.ndarray, width: int, values: np.ndarray) -> np.ndarray:
            # bincount sums in floating point: halves of 2^26 keep it exact for any 64-bit total of cells.
            low = np.bincount(at, values & 0x3FFFFFF, n_e * width).astype(np.int64)
            high = np.bincount(at, values >> 26, n_e * width).astype(np.int64)
            return (low + (high << 26)).reshape(n_e, width)

        counts, elapsed, tokens = add(cell, n_t, of["n"]), add(cell, n_t, of["elapsed_ms"]), add(cell, n_t, of["total_tokens"])
        place, never = cell * n_s + slot, np.iinfo(np.int64).min
        seen = ~pd_isnull(of["last_at"])

        def by_slot(values: np.ndarray) -> np.ndarray:
            # Types first, so that each type's array is one piece.
            return np.ascontiguousarray(values.reshape(n_e, n_t, n_s).transpose(1, 0, 2)).reshape(n_t, -1)

        def latest(at: np.ndarray, width: int) -> np.ndarray:
            out = np.full(n_e * width, never)
            np.maximum.at(out, at[seen], of["last_at"][seen].astype(np.int64))
            return out

        slot_counts = by_slot(add(place, n_t * n_s, of["n"]).astype(np.int32))
        last = latest(cell, n_t).reshape(n_e, n_t)
        utc = pa.timestamp("us", "UTC")
        moment = lambda v: pa.array(v, mask=v == never).cast(utc)
        slot_last, slot_elapsed, slot_tokens = by_slot(latest(place, n_t * n_s)), *(by_slot(add(place, n_t * n_s, of[c])) for c in ("elapsed_ms", "total_tokens"))
        offsets = pa.array(np.arange(n_e + 1, dtype=np.int32) * n_s)
        columns = [names, pa.array(counts.sum(1)), moment(last.max(1)), pa.ListArray.from_arrays(offsets, pa.array(list(slots) * n_e, pa.string()))]
        for j in range(n_t):
            columns += [pa.array(counts[:, j]), moment(np.ascontiguousarray(last[:, j])), pa.array(elapsed[:, j]), pa.array(tokens[:, j])]
            by_slots = (pa.array(slot_counts[j]), pa.array(slot_last[j], mask=slot_last[j] == never), pa.array(slot_elapsed[j]), pa.array(slot_tokens[j]))
            columns += [pa.ListArray.from_arrays(offsets, v) for v in by_slots]
        return pa.RecordBatch.from_arrays(columns, schema(types).names)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            runs = table.column("run_id").combine_chunks()
            starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(runs[1:], runs[:-1]).to_numpy(zero_copy_only=False)]))
            done = 0  # all entities but the last, which may go on in the next batch
            for first in range(0, len(starts) - 1, entities):
                upto = min(first + entities, len(starts) - 1)
                yield block(table.slice(starts[first], starts[upto] - starts[first]))
                done = starts[upto]
            held = table.slice(done).combine_chunks().to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    return scatter


def pd_isnull(values: np.ndarray) -> np.ndarray:
    """Nulls of a numeric Arrow column as it comes to numpy (NaN where there are any)."""
    return np.isnan(values) if values.dtype.kind == "f" else np.zeros(len(values), bool)


def run_features(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per run with the columns of :func:`schema`.

    Types of the catalog that a run never saw have counts and totals 0 and recency null; types that no catalog lists share
    ``unlisted``. ``status_slots`` names the statuses that occur in the data, sorted, and last ``none`` for events without one;
    the arrays by status stand in that order. No events: no rows.
    """
    types, slots = catalog_types(catalog), occurring_statuses(events)
    bucketed = cells(events).repartition("run_id").sortWithinPartitions("run_id")
    return bucketed.mapInArrow(_dense(types, slots), schema(types))
