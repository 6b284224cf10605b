"""Percentiles by multi-select against sorting, over groups of many chunks, and the bounds of bucketed values."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import quantiles as Q

SHAPE = "metric string, dim string, grp string, day date, value long"
DAYS = [dt.date(2026, 1, d) for d in (1, 2, 3)]


def nearest_rank(values, q):
    return sorted(values)[max(1, math.ceil(round(q * len(values), 6))) - 1]


@pytest.mark.parametrize("chunk,broadcast", [(512, 50_000), (7, 50_000), (7, 1)])
def test_random(spark, monkeypatch, chunk, broadcast):
    monkeypatch.setattr(Q, "CHUNK", chunk)
    monkeypatch.setattr(Q, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    rows = [("m", "d", g, rng.choice(DAYS), rng.choice([0, -1, rng.randrange(200), int(rng.lognormvariate(8, 3))])) for g, n in (("hot", 700), ("two", 2), ("one", 1)) for _ in range(n)]
    rows += [("m", "d", "same", DAYS[0], 5)] * 20 + [("m", "d", "nothing", DAYS[0], None), ("m", "d", "edge", DAYS[0], 2**62), ("m", "d", "edge", DAYS[1], -(2**62))]
    rows += [("m", "d", None, None, 4), ("m", None, "hot", DAYS[2], 9)]
    frames = [spark.createDataFrame([r for r in rows if r[3] == d], SHAPE) for d in [*DAYS, None]]
    combined = Q.combine(*[Q.summaries(f) for f in frames])
    fractions = (0.0, 0.01, 0.5, 0.9, 1.0)
    got = {(r.dim, r.grp, r.q): (r.n, r.value) for r in Q.multi_select(combined, fractions).collect()}
    groups = defaultdict(list)
    for r in rows:
        if r[4] is not None:
            groups[r[1] or "(none)", r[2] or "(none)"].append(r[4])
    assert got == {(*g, q): (len(v), nearest_rank(v, q)) for g, v in groups.items() for q in fractions}


def test_many_medians_meet(spark, monkeypatch):
    """Every day and partition of a group has chunks of its own, so that pivots come from many proposals."""
    monkeypatch.setattr(Q, "CHUNK", 50)
    rng = random.Random(4)
    values = [rng.randrange(10_000) for _ in range(3_000)]
    frame = spark.createDataFrame([("m", "d", "g", rng.choice(DAYS), v) for v in values], SHAPE)
    chunks = Q.chunked(Q.summaries(frame)).collect()
    assert len(chunks) > 40 and max(len(c["values"]) for c in chunks) <= 50
    assert all(list(c["values"]) == sorted(c["values"]) for c in chunks) and sum(sum(c.counts) for c in chunks) == 3_000
    got = {r.q: r.value for r in Q.multi_select(Q.summaries(frame), (0.25, 0.5, 0.99)).collect()}
    assert got == {q: nearest_rank(values, q) for q in got} and len(got) == 3


def test_search():
    rng = np.random.default_rng(1)
    stretches = [np.sort(rng.integers(0, 9, n)) for n in (1, 5, 0, 30)]
    ends = np.cumsum([len(s) for s in stretches])
    begin = ends - [len(s) for s in stretches]
    for right in (False, True):
        for x in range(-1, 10):
            got = Q.search(np.concatenate(stretches), begin, ends, np.full(4, x), right)
            assert (got - begin).tolist() == [int(np.searchsorted(s, x, "right" if right else "left")) for s in stretches]


def test_bounds(spark):
    rng, bits = random.Random(8), 6
    values = sorted(int(rng.lognormvariate(9, 3)) * rng.choice([1, -1]) for _ in range(500))
    frame = spark.createDataFrame([("m", "d", "g", DAYS[0], v) for v in values], SHAPE)
    result = Q.with_bounds(Q.multi_select(Q.combine(Q.summaries(frame, bits)), (0.1, 0.5, 0.99)), bits)
    for r in result.collect():
        true = nearest_rank(values, r.q)
        assert r.low <= true <= r.high and abs(r.estimate - true) <= max(0.5, abs(true) * 2**-bits)


def test_empty(spark):
    assert Q.multi_select(Q.combine(Q.summaries(spark.createDataFrame([], SHAPE))), (0.5,)).count() == 0
    none = spark.createDataFrame([("m", "d", "g", DAYS[0], None)], SHAPE).withColumn("n", F.lit("clashes"))
    assert Q.multi_select(Q.summaries(none), (0.5,)).count() == 0
