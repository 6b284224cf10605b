"""The row before and after each row of a group, without a task that sees a whole group.

Rows are range-partitioned over group and order, so a group with a third of all rows lies in many partitions; neighbours within
a partition come from its sorted batches, those across a seam from the partitions' first and last rows (two rows each).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.session import written


def with_neighbours(rows: DataFrame, group: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Adds ``prev_<c>`` and ``next_<c>`` for the columns ``carry``, and ``has_prev``, ``has_next``: the neighbours by ``order``
    within ``group`` (null and false at its ends). ``group`` and ``order`` together should be unique; ties keep any order.

    Null group values are a group of their own. Column names must not begin with ``_part``, ``_edge``, ``_prev_`` or ``_next_``.
    """
    seen = list(dict.fromkeys([*group, *carry]))
    types = [rows.schema[c].dataType for c in seen]
    fields = [*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.IntegerType())]
    fields += [T.StructField(f"_{side}_{c}", t) for side in ("prev", "next") for c, t in zip(seen, types)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, first = TaskContext.get().partitionId(), None, None, True

        def out(batch: pa.RecordBatch, after: pa.RecordBatch | None) -> pa.RecordBatch:
            nonlocal first
            n = batch.num_rows
            edge = [0] * n
            edge[0] += int(first)
            edge[-1] += 2 * int(after is None)
            first = False
            columns = [pa.array([part] * n, pa.int32()), pa.array(edge, pa.int32())]
            for c in seen:
                own = batch.column(c)
                columns.append(pa.concat_arrays([before.column(c).slice(before.num_rows - 1) if before is not None else pa.nulls(1, own.type), own.slice(0, n - 1)]))
            for c in seen:
                own = batch.column(c)
                columns.append(pa.concat_arrays([own.slice(1), after.column(c).slice(0, 1) if after is not None else pa.nulls(1, own.type)]))
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield out(held, batch)
                before, held = held, batch
        if held is not None:
            yield out(held, None)

    by = [*group, *order]
    near = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, T.StructType(fields)))
    edges = near.filter("_edge > 0").select("_part", "_edge", *seen).collect()  # two rows a partition
    first, last = ({r["_part"]: r for r in edges if r["_edge"] & bit} for bit in (1, 2))
    parts = sorted(first)
    nothing = (None,) * len(seen)
    seams = []
    for k, p in enumerate(parts):
        left = last[parts[k - 1]] if k else None
        right = first[parts[k + 1]] if k + 1 < len(parts) else None
        seams.append((p, left is not None, right is not None, *([left[c] for c in seen] if left else nothing), *([right[c] for c in seen] if right else nothing)))
    schema = [T.StructField("_part", T.IntegerType()), T.StructField("_left", T.BooleanType()), T.StructField("_right", T.BooleanType())]
    schema += [T.StructField(f"_{side}_{c}", t) for side in ("before", "after") for c, t in zip(seen, types)]
    joined = near.join(F.broadcast(near.sparkSession.createDataFrame(seams, T.StructType(schema))), "_part", "left")  # a row a partition
    at_first, at_last = F.col("_edge").bitwiseAND(1) > 0, F.col("_edge").bitwiseAND(2) > 0
    prev = {c: F.when(at_first, F.col(f"_before_{c}")).otherwise(F.col(f"_prev_{c}")) for c in seen}
    nxt = {c: F.when(at_last, F.col(f"_after_{c}")).otherwise(F.col(f"_next_{c}")) for c in seen}
    has_prev, has_next = ~at_first | F.coalesce("_left", F.lit(False)), ~at_last | F.coalesce("_right", F.lit(False))
    for c in group:
        has_prev, has_next = has_prev & prev[c].eqNullSafe(F.col(c)), has_next & nxt[c].eqNullSafe(F.col(c))
    return joined.select(
        *rows.columns, has_prev.alias("has_prev"), has_next.alias("has_next"),
        *[F.when(has_prev, prev[c]).alias(f"prev_{c}") for c in carry], *[F.when(has_next, nxt[c]).alias(f"next_{c}") for c in carry],
    )
