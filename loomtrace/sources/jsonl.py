"""Line-delimited JSON segments with a commit catalog, and the JSON stores beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

EVENT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("event_id", "event_type", "trace_id", "turn_id", "run_id", "parent_run_id", "resumed_from_run_id", "caused_by_event_id", "model_call_id", "attempt_id", "tool_call_id", "session_key", "source_type", "status", "stop_reason", "provider", "model", "requested_provider", "requested_model", "tool_name", "payload_id", "process_instance_id", "segment_id", "previous_event_hash", "event_hash")]
    + [T.StructField(c, T.LongType()) for c in ("segment_sequence", "durability_epoch", "elapsed_ms")]
    + [T.StructField("iteration", T.IntegerType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("usage", T.MapType(T.StringType(), T.LongType()))]
)

CATALOG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("catalog_record_type", "catalog_record_id", "process_instance_id", "segment_id", "previous_catalog_hash", "catalog_record_hash")]
    + [T.StructField(c, T.LongType()) for c in ("catalog_sequence", "durability_epoch", "record_count")]
)


def read_segments(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """All records under ``path`` with an explicit schema (no inference pass); lines that are no JSON keep their text in
    ``_corrupt_record``. Adds ``source_file``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(path).withColumn("source_file", F.input_file_name())


def flatten_usage(events: DataFrame) -> DataFrame:
    """The flat row of an event: requested provider and model where the actual ones are missing, token counts out of the map."""
    tokens = [F.coalesce(F.col("usage")[c], F.lit(None).cast("bigint")).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    kept = [c for c in events.columns if c not in ("usage", "provider", "model", "requested_provider", "requested_model")]
    return events.select(*kept, F.coalesce("provider", "requested_provider").alias("provider"), F.coalesce("model", "requested_model").alias("model"), *tokens)


def committed(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """The records of the committed prefix: those whose sequence the segment's last committed epoch counts."""
    upto = catalog.filter("catalog_record_type = 'epoch_committed'").groupBy("process_instance_id", "segment_id").agg(F.max("record_count").alias("_upto"))
    return records.join(upto, ["process_instance_id", "segment_id"]).filter(F.col("segment_sequence") <= F.col("_upto")).drop("_upto")


def diagnostics(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """``process_instance_id, segment_id, code, n``: missing_segment, offset_beyond_file, uncataloged_tail, invalid_record."""
    upto = catalog.filter("catalog_record_type = 'epoch_committed'").groupBy("process_instance_id", "segment_id").agg(F.max("record_count").alias("upto"))
    good = records.filter(F.col(CORRUPT).isNull()) if CORRUPT in records.columns else records
    there = good.groupBy("process_instance_id", "segment_id").agg(F.max("segment_sequence").alias("last"), F.count("*").alias("n"))
    code = F.when(F.col("last").isNull(), "missing_segment").when(F.col("last") < F.col("upto"), "offset_beyond_file").when(F.col("upto").isNull() | (F.col("last") > F.col("upto")), "uncataloged_tail")
    found = upto.join(there, ["process_instance_id", "segment_id"], "full_outer").select("process_instance_id", "segment_id", code.alias("code"), F.abs(F.coalesce("last", F.lit(0)) - F.coalesce("upto", F.lit(0))).alias("n")).filter("code is not null")
    if CORRUPT not in records.columns:
        return found
    nothing = F.lit(None).cast("string")
    # Spark reads the corrupt column only together with another one.
    counted = records.agg(F.count(CORRUPT).alias("n"), F.count("segment_sequence").alias("good"))
    broken = counted.filter("n > 0 and good >= 0").select(nothing.alias("process_instance_id"), nothing.alias("segment_id"), F.lit("invalid_record").alias("code"), "n")
    return found.unionByName(broken)


def catalog_faults(catalog: DataFrame) -> DataFrame:
    """Faults of the hash-linked catalog of each process: ``bad_root`` (not one root, or not process_started), ``fork`` (a
    record with several successors), ``unlinked`` (a predecessor that is no record)."""
    key = "process_instance_id"
    roots = catalog.filter("previous_catalog_hash is null").groupBy(key).agg(F.count("*").alias("n"), F.max(F.col("catalog_record_type") == "process_started").alias("ok"))
    bad_root = catalog.select(key).distinct().join(roots, key, "left").filter("n is null or n <> 1 or not ok").select(key, F.lit("bad_root").alias("fault"), F.lit(None).cast("string").alias("at_hash"))
    linked = catalog.filter("previous_catalog_hash is not null")
    fork = linked.groupBy(key, "previous_catalog_hash").agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("fork").alias("fault"), F.col("previous_catalog_hash").alias("at_hash"))
    own = catalog.select(key, F.col("catalog_record_hash").alias("previous_catalog_hash"))
    unlinked = linked.join(own, [key, "previous_catalog_hash"], "left_anti").select(key, F.lit("unlinked").alias("fault"), F.col("catalog_record_hash").alias("at_hash"))
    return bad_root.unionByName(fork).unionByName(unlinked)


def read_history(spark: SparkSession, path: str, since: int = -1) -> DataFrame:
    """History rows ``cursor, timestamp, content, session_key`` after ``since``; broken lines and rows without a cursor are left out."""
    return spark.read.schema("cursor long, timestamp string, content string, session_key string").option("mode", "DROPMALFORMED").json(path).filter(F.col("cursor") > since)


def visible_history(history: DataFrame, session_key: str, internal: tuple[str, ...] = ("cron:", "dream:", "system:")) -> DataFrame:
    """Rows of a session and those of no session, without the sessions that the system runs for itself."""
    hidden = F.coalesce(F.lit(False), F.lit(False))
    for prefix in internal:
        hidden = hidden | F.coalesce(F.col("session_key").startswith(prefix), F.lit(False))
    return history.filter((F.col("session_key").isNull() | (F.col("session_key") == session_key)) & ~hidden)


def session_previews(messages: DataFrame, chars: int = 120) -> DataFrame:
    """Per session its newest time and a preview: the first user text, else the first assistant text (``session_key, seq, role, content``)."""
    first = lambda role: F.min(F.when((F.col("role") == role) & (F.trim("content") != ""), F.struct("seq", "content")))["content"]
    return messages.groupBy("session_key").agg(F.max("timestamp").alias("updated_at"), F.count("*").alias("n_messages"), F.substring(F.coalesce(first("user"), first("assistant")), 1, chars).alias("preview"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents (job and usage stores), one or many rows a file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def transcript_turns(rows: DataFrame) -> DataFrame:
    """Transcript rows ``session_key, seq, event`` numbered by turn; a turn goes on to its ``turn_end``."""
    before = Window.partitionBy("session_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("turn_no", F.coalesce(F.sum(F.when(F.col("event") == "turn_end", 1).otherwise(0)).over(before), F.lit(0)))
