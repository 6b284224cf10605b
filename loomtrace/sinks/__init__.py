"""Writers: segments, upserts, rebuilds, exports and offloaded values."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.history import newest_by_key


#: How instants are written: all six digits, which the default of the JSON writer cuts to three.
INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_segments(records: DataFrame, path: str, date: str = "occurred_at") -> None:
    """Append as JSON lines, one directory a day."""
    records.withColumn("date", F.to_date(date)).write.mode("append").option("timestampFormat", INSTANT).partitionBy("date").json(path)


def insert_new(records: DataFrame, existing: DataFrame, key: str = "event_id") -> DataFrame:
    """The records whose key is neither there yet nor repeated among them (of repeated ones any: they agree)."""
    return records.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table after ``changes``: the newest version of each key, a change wins over an equal version."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return newest_by_key(both, keys, [version, "_new"]).drop("_new")


def supersede(outbox: DataFrame, content_hash: Column, key: str, order: str) -> DataFrame:
    """Pending outbox rows of an object that a later one with another content replaces get the status ``superseded``."""
    rows = outbox.withColumn("_hash", content_hash)
    latest = rows.groupBy(key).agg(F.max(F.struct(order, "_hash")).alias("_last"))
    old = (F.col("status") == "pending") & (F.col(order) < F.col(f"_last.{order}")) & (F.col("_hash") != F.col("_last._hash"))
    return rows.join(latest, key).withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("_hash", "_last")


def _replace(spark, beside: str, path: str) -> None:
    """Put the files at ``beside`` in the place of those at ``path``.

    The old ones leave last: whenever this stops, whole files lie under one of the names.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, live, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, f"{beside}_old"))
    fs = live.getFileSystem(conf)
    moved = fs.exists(live) and fs.rename(live, old)
    if not fs.rename(new, live):
        if moved:
            fs.rename(old, live)
        raise OSError(f"{path} could not be replaced")
    if moved:
        fs.delete(old, True)


def rebuild(df: DataFrame, path: str, least_rows: int = 1) -> int:
    """Replace the table at ``path`` as a whole: written beside it, counted, then renamed; returns the rows.

    With fewer than ``least_rows`` the old table stays and ValueError is raised.
    """
    spark = df.sparkSession
    beside = f"{path}_rebuild_{uuid.uuid4().hex}"
    df.write.parquet(beside)
    n = spark.read.schema(df.schema).parquet(beside).count()
    if n < least_rows:
        remove(spark, beside)
        raise ValueError(f"rebuild of {path} has {n} rows")
    _replace(spark, beside, path)
    return n


def remove(spark, path: str) -> bool:
    """Delete a table or file tree; whether there was one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))


def export_json(df: DataFrame, path: str, hidden: tuple[str, ...] = ()) -> None:
    """One JSON document a row, without the ``hidden`` columns."""
    df.drop(*hidden).write.mode("overwrite").option("timestampFormat", INSTANT).json(path)


def offload(df: DataFrame, key: str, text: str, limit: int, preview: int = 200) -> tuple[DataFrame, DataFrame]:
    """``(rows, values)``: texts longer than ``limit`` leave a preview and a reference to ``values`` (``reference, value``)."""
    long = F.length(text) > limit
    reference = F.sha2(F.concat_ws("|", F.col(key).cast("string"), text), 256)
    rows = df.withColumn("reference", F.when(long, reference)).withColumn(text, F.when(long, F.concat(F.substring(text, 1, preview), F.lit("..."))).otherwise(F.col(text)))
    values = df.filter(long).select(reference.alias("reference"), F.col(text).alias("value"))
    return rows, values


def write_state(spark, state: dict, path: str, max_bytes: int = 1 << 20) -> None:
    """A small state document, replaced as a whole; ValueError above ``max_bytes``."""
    raw = json.dumps(state, sort_keys=True, ensure_ascii=False)
    if len(raw.encode()) > max_bytes:
        raise ValueError("state is too large")
    beside = f"{path}_{uuid.uuid4().hex}"
    spark.createDataFrame([(raw,)], "value string").coalesce(1).write.text(beside)
    _replace(spark, beside, path)


def write_sessions(messages: DataFrame, path: str, newest: int | None = None, archive: str | None = None) -> None:
    """Messages by session bucket, replaced as a whole; with ``newest`` only each session's last ones stay.

    The older ones are appended to ``archive``, by bucket too, before the table is replaced: a stop in between keeps a message
    in both places rather than in none. ``messages`` must not be read from ``path`` itself when it is replaced in place.
    """
    bucketed = messages.withColumn("bucket", F.pmod(F.xxhash64("session_key"), F.lit(256)))
    kept = newest_by_key(bucketed, ["session_key"], ["seq"], newest) if newest else bucketed
    if newest and archive:
        older = bucketed.join(kept.select("session_key", "seq"), ["session_key", "seq"], "left_anti")
        older.write.mode("append").partitionBy("bucket").parquet(archive)
    beside = f"{path}_{uuid.uuid4().hex}"
    kept.write.partitionBy("bucket").parquet(beside)
    _replace(messages.sparkSession, beside, path)
