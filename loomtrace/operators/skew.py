"""Many-to-one joins whose many side may have keys that hold a large share of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are treated as hot, so the broadcast set has a fixed bound. Any other key holds less than 1/HOT of the rows.
HOT = 512
#: Parts into which the rows of a hot key are split.
SALTS = 64


def hot_keys(counted: DataFrame, keys: Sequence[str], count: str, least: int = 20_000) -> DataFrame:
    """Of one row per key with its number of rows: the at most ``HOT`` largest keys that have ``least`` rows or more."""
    return counted.filter(F.col(count) >= least).orderBy(F.desc(count), *keys).limit(HOT).select(*keys)


def crowded_values(values: DataFrame, least: int = 20_000) -> list[int]:
    """The values of a bigint column that stand in at least ``least`` rows and in more than one in ``HOT`` of all: at most ``HOT``.

    Candidates come from one pass of counters without a shuffle (every value above the share is among them), then they alone
    are counted. What is crowded decides where rows go, never what comes out.
    """
    name = values.columns[0]
    candidates = values.stat.freqItems([name], 1 / HOT).first()[0]
    if not candidates:
        return []
    counted = values.filter(F.col(name).isin(candidates)).groupBy(name).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return [r[0] for r in counted.orderBy(F.desc("n"), name).limit(HOT).collect()]


def salted_join(many: DataFrame, one: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (unique in ``keys``) on equal ``keys``; rows of hot keys are spread over ``SALTS`` parts.

    ``hot`` has at most ``HOT`` rows (:func:`hot_keys`), hence the broadcast. The rows of ``one`` with hot keys are repeated
    ``SALTS`` times, at most ``HOT * SALTS`` rows. The part follows from the row's other columns alone, so a task that is
    run again sends each row to the same place. Null keys match nothing; with ``how='left'`` their rows are kept.
    """
    mark = hot.withColumn("_hot", F.lit(True))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in many.columns if c not in keys]), F.lit(SALTS))).otherwise(F.lit(0))
    left = many.join(F.broadcast(mark), list(keys), "left").withColumn("_salt", spread.cast("int")).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(F.broadcast(mark), list(keys), "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
