"""Orphans, features and hierarchies against brute force on small tables, with their odd cases."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomtrace.functions.ids import canonical, halves, reference, text_of
from loomtrace.operators import entity_features as E
from loomtrace.operators import hierarchy as H
from loomtrace.operators import orphans as O
from loomtrace.operators import skew

U = "019ca6b1-dc00-75ba-99b5-296b75fb65{:02x}".format


def test_reference_forms(spark):
    u = U(7)
    cases = {
        u: u, u.upper(): u, f" {u}\n": u, f"{{{u}}}": u, f"urn:uuid:{u}": u, f"URN:UUID:{u.upper()}": u, f"{{urn:uuid:{u}}}": u, f"urn:uuid:{{{u}}}": u, f" {u} ": u,
        f"{{{u}": None, f"{u}}}": None, u.replace("-", ""): None, "": None, " ": None, "null": None, "0": None, "n/a": None, u + "0": None, None: None, f"x{u}": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "v string, want string")
    assert rows.filter(~reference(F.col("v")).eqNullSafe(F.col("want"))).count() == 0
    back = rows.filter("want is not null").select("want", *halves(F.col("want"), "k")).filter(text_of(F.col("k_hi"), F.col("k_lo")) != F.col("want"))
    assert back.count() == 0
    assert spark.createDataFrame([("  t1 ",)], "v string").select(canonical(F.col("v"))).first()[0] == "t1"


def orphan_rows(spark, refs, parents, deleted=()):
    r = spark.createDataFrame(refs, "ref string, k long, at long").select("ref", F.lit(0).alias("space"), *O.dense(F.col("k")), "at")
    p = spark.createDataFrame(parents, "k long, at long").select(F.lit(0).alias("space"), *O.dense(F.col("k")), "at")
    d = spark.createDataFrame([(k,) for k in deleted], "k long").select(F.lit(0).alias("space"), *O.dense(F.col("k")))
    return sorted((x.ref, x.reason) for x in O.orphan_references(r, p, d).collect())


def test_orphans_random(spark, monkeypatch):
    monkeypatch.setattr(O, "crowded_values", lambda v: skew.crowded_values(v, least=5))
    rng = random.Random(5)
    parents = [(rng.choice([rng.randrange(300), 65_530 + rng.randrange(20), -rng.randrange(9)]), rng.randrange(100)) for _ in range(400)]
    deleted = [rng.randrange(300) for _ in range(20)]
    refs = [(f"r{i}", rng.choice([rng.randrange(-12, 310), 65_520 + rng.randrange(40), 7, 7]), rng.randrange(100)) for i in range(600)]
    at = {}
    for k, t in parents:
        at[k] = min(t, at.get(k, t))
    want = [(r, "deleted" if k in deleted else "missing" if k not in at else "later") for r, k, t in refs if k in deleted or k not in at or at[k] > t]
    assert orphan_rows(spark, refs, parents, deleted) == sorted(want)


def test_orphans_at_the_ends_of_the_key_range(spark):
    zero, big, small = "00000000-0000-4000-8000-000000000000", "ffffffff-ffff-4fff-bfff-ffffffffffff", "00000000-0000-4000-7fff-ffffffffffff"
    keyed = lambda rows: spark.createDataFrame(rows, "ref string, k string, at long").select("ref", F.lit(0).alias("space"), *[h.alias(n) for h, n in zip(halves(F.col("k"), "k"), ("hi", "lo"))], "at")
    parents = keyed([("", zero, 1), ("", small, 1)]).drop("ref")
    got = O.orphan_references(keyed([("a", zero, 5), ("b", big, 5), ("c", small, 5), ("d", zero, 0)]), parents)
    assert sorted((r.ref, r.reason) for r in got.collect()) == [("b", "missing"), ("d", "later")]
    ends = spark.createDataFrame([(k, 0) for k in (-(2**63), -(2**63) + 1, 2**63 - 1)], "lo long, at long").select(F.lit("x").alias("space"), F.lit(0).alias("hi"), "lo", "at")
    assert sorted((r.lo, r.run_size) for r in O.key_runs(ends).collect()) == [(-(2**63), 2), (2**63 - 1, 1)]


def test_orphans_over_many_batches(spark):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "3")
    try:
        refs = [(f"r{k}", k, 5) for k in range(40)]
        parents, gone = [(k, 9 if k % 10 == 3 else 1) for k in range(40) if k % 7], [0, 8, 9, 70]
        want = [(f"r{k}", "deleted" if k in gone else "missing" if not k % 7 else "later") for k in range(40) if k in gone or not k % 7 or k % 10 == 3]
        assert orphan_rows(spark, refs, parents, gone) == sorted(want)
    finally:
        spark.conf.set(batch, before)


def test_orphans_of_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(O, "crowded_values", lambda v: skew.crowded_values(v, least=50))
    refs = [(f"m{i}", 7, i) for i in range(300)] + [(f"x{i}", 8, 1) for i in range(200)] + [(f"d{i}", 3, 1) for i in range(60)] + [(f"n{i}", 9, None) for i in range(60)] + [("a", 100, 1), ("b", 101, 1)]
    assert len(skew.crowded_values(spark.createDataFrame([(k,) for _, k, _ in refs], "k long"), least=50)) == 4
    want = [(f"m{i}", "later") for i in range(150)] + [(f"x{i}", "missing") for i in range(200)] + [(f"d{i}", "deleted") for i in range(60)] + [("b", "missing")]
    assert orphan_rows(spark, refs, [(7, 150), (3, 0), (9, 5), (100, 1)], [3]) == sorted(want)


def test_orphans_odd_cases(spark):
    assert orphan_rows(spark, [], [(1, 1)]) == []
    assert orphan_rows(spark, [("a", 1, 5), ("b", None, 5)], []) == [("a", "missing")]
    # Ties are not later; a null time is never later; repeated rows come out as often as they go in.
    assert orphan_rows(spark, [("a", 1, 5), ("c", 2, None), ("d", 9, 1), ("d", 9, 1)], [(1, 5), (2, 7), (1, 9), (None, 3)]) == [("d", "missing"), ("d", "missing")]
    # A tombstone without a parent is a deletion.
    assert orphan_rows(spark, [("a", 4, 1)], [(1, 5)], [4]) == [("a", "deleted")]


def test_runs_are_contiguous(spark):
    keys = [1, 2, 3, 7, 8, 65_535, 65_536]
    p = spark.createDataFrame([(k, k * 10) for k in keys], "k long, at long").select(F.lit(0).alias("space"), *O.dense(F.col("k")), "at")
    got = sorted((r.lo, r.run_end, r.run_size, r.first_at, r.last_at) for r in O.key_runs(p).collect())
    assert got == [(1, 3, 3, 10, 30), (7, 8, 2, 70, 80), (65_535, 65_535, 1, 655_350, 655_350), (65_536, 65_536, 1, 655_360, 655_360)]


LOG = "event_id string, event_type string, run_id string, status string, occurred_at timestamp, elapsed_ms long, total_tokens long, n string"


def test_features(spark, monkeypatch):
    monkeypatch.setattr(E, "CELLS", 2 * 4 * 4)
    t = [dt.datetime(2026, 1, 1, 0, i) for i in range(9)]
    rows = [
        ("e1", "a", "r1", "ok", t[1], 5, None, "x"), ("e1", "a", "r1", "ok", t[1], 5, None, "x"), ("e2", " A", "r1", "OK ", t[3], -1, 7, None), ("e3", "b", "r1", None, t[2], None, 3, "x"),
        ("e4", "zz", "r2", "odd", None, 2**40, 2**40, "x"), ("e5", None, "r2", "", t[4], 2**40, 1, "x"), ("e6", "a", None, "ok", t[5], 1, 1, "x"), ("e7", "a", "r3", "failed", t[6], 1, 1, "x"),
    ]
    events = spark.createDataFrame(rows, LOG)
    catalog = spark.createDataFrame([("a",), ("b ",), ("never",), (None,)], "event_type string")
    got = {r.run_id: r for r in E.run_features(events, catalog).collect()}
    assert sorted(got) == ["r1", "r2", "r3"]
    one, two = got["r1"], got["r2"]
    assert (one.n_events, one.n_a, one.n_b, one.n_never, one.n_unlisted) == (3, 2, 1, 0, 0)
    assert (one.last_a, one.last_at, one.last_never, one.elapsed_ms_a, one.total_tokens_a) == (t[3], t[3], None, 5, 7)
    slots = one.status_slots
    assert slots == ["failed", "odd", "ok", "none"]
    assert one.statuses_a[slots.index("ok")] == 2 and sum(one.statuses_a) == 2 and one.statuses_b[slots.index("none")] == 1
    assert (two.n_unlisted, two.elapsed_ms_unlisted, two.total_tokens_unlisted, two.last_unlisted) == (2, 2**41, 2**40 + 1, t[4])
    assert two.statuses_unlisted[slots.index("odd")] == 1 and two.statuses_unlisted[slots.index("none")] == 1
    assert E.run_features(spark.createDataFrame([], LOG), catalog).count() == 0


def test_features_by_status(spark, monkeypatch):
    monkeypatch.setattr(E, "CELLS", 2 * 4 * 4)
    t = [dt.datetime(2026, 1, 1, 0, i) for i in range(9)]
    us = [int(x.timestamp()) * 1_000_000 for x in t]
    rows = [
        ("e1", "a", "r1", "ok", t[1], 5, 1, "x"), ("e1", "a", "r1", "ok", t[1], 5, 1, "x"), ("e2", "a", "r1", " OK", t[4], 2, -7, "x"), ("e3", "a", "r1", "failed", t[3], 2**40, 2, "x"), ("e4", "a", "r1", "odd", t[2], 7, 4, "x"),
        ("e5", "a", "r1", "strange", None, 1, 2**40, "x"), ("e6", "a", "r1", None, t[5], None, 8, "x"), ("e7", "zz", "r2", "ok", t[6], 3, 9, "x"), ("e8", "a", "r3", "ok", t[7], 3, 9, "x"), ("e9", "a", None, "unrun", t[8], 3, 9, "x"),
    ]
    events, catalog = spark.createDataFrame(rows, LOG), spark.createDataFrame([("a",), ("never",)], "event_type string")
    got = {r.run_id: r for r in E.run_features(events, catalog).collect()}
    one = got["r1"]
    assert sorted(got) == ["r1", "r2", "r3"] and one.status_slots == ["failed", "odd", "ok", "strange", "none"]
    assert one.statuses_a == [1, 1, 2, 1, 1] and one.status_last_a == [us[3], us[2], us[4], None, us[5]]
    assert one.status_elapsed_ms_a == [2**40, 7, 7, 1, 0] and one.status_total_tokens_a == [2, 4, 1, 2**40, 8]
    assert (one.n_a, one.last_a, one.elapsed_ms_a) == (6, t[5], 2**40 + 15)
    assert one.statuses_never == one.status_elapsed_ms_never == one.status_total_tokens_never == [0] * 5 and one.status_last_never == [None] * 5
    assert got["r2"].status_last_unlisted == [None, None, us[6], None, None] and got["r2"].status_total_tokens_unlisted == [0, 0, 9, 0, 0]
    assert E.run_features(spark.createDataFrame([], LOG), catalog).count() == 0


def brute(links):
    parent = {}
    for i, p in links:
        if i is not None:
            parent[i] = p if parent.get(i) is None else parent[i] if p is None else min(parent[i], p)
    out = {}
    for i in parent:
        path, at = [i], i
        while True:
            p = parent[at]
            if p is None or p not in parent:
                out[i] = (path[-1], len(path) - 1, path[::-1], "tree")
                break
            if p in path:
                out[i] = (None, None, None, "cycle" if p == i else "below_cycle")
                break
            path.append(p)
            at = p
    return out


@pytest.mark.parametrize("seed,spacing,hub", [(1, 8, 20_000), (2, 2, 4), (3, 10**9, 20_000)])
def test_hierarchy_random(spark, monkeypatch, seed, spacing, hub):
    monkeypatch.setattr(H, "SPACING", spacing)
    monkeypatch.setattr(H, "HUB_CHILDREN", hub)
    rng = random.Random(seed)
    links = [(f"n{i}", rng.choice([None, f"n{rng.randrange(150)}", f"n{max(0, i - 1)}", "gone", "n3"])) for i in range(150)]
    links += [(f"c{i}", f"c{i - 1}" if i else None) for i in range(90)] + [(f"k{i}", f"k{(i + 1) % 41}") for i in range(41)] + [("own", "own"), ("below", "own"), (None, "n1"), ("n5", "n6")]
    solved = H.solve_hierarchy(spark.createDataFrame(links, "id string, parent string").withColumn("root", F.lit("clash")))
    rows = H.with_descendant_counts(solved).collect()
    want = brute(links)
    assert {r.id: (r.root, r.depth, r.path, r.status) for r in rows} == want and len(rows) == len(want)
    assert sorted(r.id for r in H.cycle_nodes(spark.createDataFrame(links, "id string, parent string")).collect()) == sorted(i for i, v in want.items() if v[3] == "cycle")
    below = defaultdict(int)
    for root, depth, path, status in want.values():
        for a in (path or [])[:-1]:
            below[a] += 1
    assert all(r.n_descendants == (below[r.id] if r.status == "tree" else None) for r in rows)
    pairs = {(r.ancestor, r.id, r.distance) for r in H.descendants(solved).collect()}
    assert pairs == {(a, i, v[1] - k) for i, v in want.items() if v[3] == "tree" for k, a in enumerate(v[2][:-1])}


def test_hierarchy_empty(spark):
    assert H.cycle_nodes(spark.createDataFrame([], "id string, parent string")).count() == 0
    assert H.solve_hierarchy(spark.createDataFrame([], "id string, parent string")).count() == 0


def test_run_links(spark):
    cols = "event_id string, event_type string, run_id string, parent_run_id string, resumed_from_run_id string, caused_by_event_id string, recorded_at timestamp"
    t = [dt.datetime(2026, 1, 1, i) for i in range(4)]
    rows = [
        ("e1", "run_started", U(1), None, None, None, t[0]),
        ("e2", "run_started", U(2), f"{{{U(1)}}}", U(9), None, t[0]),
        ("e3", "run_started", U(3), "n/a", U(2).upper(), U(20), t[0]),
        ("e4", "run_started", U(4), "", None, U(20), t[1]),
        ("e4", "run_started", U(4), "", None, U(20), t[0]),
        (U(20), "tool_finished", U(3), None, None, None, t[0]),
        (U(20), "tool_finished", U(3), None, None, None, t[1]),
        ("e6", "tool_finished", U(8), None, None, None, t[0]),
    ]
    solved = {r.id: r.root for r in H.run_hierarchy(spark.createDataFrame(rows, cols)).collect()}
    assert solved == dict.fromkeys((U(1), U(2), U(3), U(4)), U(1))


def test_salted_join_keeps_all(spark):
    many = spark.createDataFrame([(1 if i % 2 else i, i, None) for i in range(400)], "k long, v long, w string")
    one = spark.createDataFrame([(i, i * 10) for i in range(0, 400, 3)] + [(1, 7)], "k long, x long").dropDuplicates(["k"])
    hot = skew.hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", least=100)
    assert [r.k for r in hot.collect()] == [1]
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew.salted_join(many, one, ["k"], hot, how).select("k", "v", "x").collect()), key=str)
        assert got == sorted(map(tuple, many.join(one, "k", how).select("k", "v", "x").collect()), key=str)
