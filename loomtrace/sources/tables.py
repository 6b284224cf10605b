"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "audit_events", "turn_input_payloads", "node_relations", "tombstones", "event_type_catalog", "model_catalog",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``. Only the columns a plan uses are read (Parquet column pruning)."""
    if name not in TABLES:
        raise KeyError(f"no such table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as an event log: trace = user and day, session = user, tokens from ``props``."""
    events = load(spark, sf_dir, "events")
    return events.select(
        F.col("event_id"),
        F.col("event_type"),
        F.col("ts"),
        F.col("user_id"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )
