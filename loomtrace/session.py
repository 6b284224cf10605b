"""Session construction and the two ways in which a long plan is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomtrace", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset (tests) a local folder is made.

    On a cluster an unset folder is an error: no folder of one machine can be read by all executors.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if configured is None:
        configured = "file://" + os.path.join(tempfile.gettempdir(), f"loomtrace-{uuid.uuid4().hex}")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` now and go on from its reliable checkpoint in the shared folder.

    Executors may be lost afterwards: the files are read again, nothing is recomputed.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_tables: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that :func:`written` made in this process; call it when their results are no longer needed."""
    return _drop(spark, 0, len(_tables))


def _drop(spark: SparkSession, first: int, upto: int) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _tables[first:upto]
    del _tables[first:upto]
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, which :func:`drop_written` deletes."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def written(df: DataFrame, *sort: str) -> DataFrame:
    """Like :func:`cut`, as a Parquet table in the shared folder: smaller on disk and read by column.

    The table stays until :func:`drop_written` or until the folder is cleared, since later plans read it.
    """
    spark = df.sparkSession
    path = scratch(spark)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written down; the tables it went through on the way are deleted, so that rounds leave nothing behind."""
    first = len(_tables)
    result = written(build())
    _drop(spark, first, len(_tables) - 1)
    return result
