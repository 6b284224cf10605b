"""Conversations against a plain walk over random turns, and their odd cases."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from loomtrace.llm import conversations as C
from loomtrace.llm.queries import QUERIES, SQL
from tests.oracle import difference, duck

MESSAGES = "payload_id string, event_id string, role string, content string, media_refs array<string>, blank boolean"
EVENTS = "event_id string, turn_id string, session_key string, occurred_at timestamp, segment_sequence long"
T0 = dt.datetime(2026, 1, 1)


def found(spark, messages, events):
    paths, dropped = C.conversations(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(events, EVENTS))
    order = defaultdict(list)
    for r in paths.collect():
        order[r.session_key].append((r.depth, r.payload_id))
    return {s: [p for _, p in sorted(v)] for s, v in order.items()}, sorted(r.session_key for r in dropped.collect())


def test_cases(spark):
    events, messages = [], []

    def turn(session, name, *spoken):
        for i, (role, content, media) in enumerate(spoken):
            e = f"{name}-{i}"
            events.append((e, name, session if i == 0 else None, T0 + dt.timedelta(minutes=len(events)), 1))
            messages.append((f"p-{e}", f" {e} ", role, content, media, None))

    turn("good", "t1", (" Human", "hi", []), ("BOT ", "yes", []))
    turn("good", "t2", ("system", "rules", []), ("user", None, ["pic"]), ("tool", "x", None), ("model", '[{"type": "text", "text": "done"}]', []))
    turn("no reply", "t3", ("user", "hi", []), ("assistant", "​ \n", []))
    turn("reply first", "t4", ("assistant", "hi", []), ("user", "hi", []), ("assistant", "yes", []))
    turn("unknown", "t5", ("user", "hi", []), ("narrator", "so", []), ("assistant", "yes", []))
    turn("null role", "t6", ("user", "hi", []), (None, "so", []), ("assistant", "yes", []))
    turn("empty", "t7", ("user", "  ﻿", []), ("assistant", "[]", []))
    turn("no user", "t8", ("system", "rules", []))
    turn("second turn bad", "t9", ("user", "hi", []), ("assistant", "yes", []))
    turn("second turn bad", "t10", ("user", "hi", []), ("assistant", "yes", []), ("user", "and?", []))
    turn("blank unknown", "t11", ("user", "[urgent] now", []), ("narrator", "", []), ("assistant", "yes", []))
    turn(None, "t12", ("user", "nowhere", []))
    events.append(("lone", None, "good", T0, 1))
    messages += [("p-lone", "lone", "narrator", "x", [], None), ("p-gone", "no such event", "user", "x", [], None), ("p-null", None, "user", "x", [], None), (None, "t1-0", "narrator", "x", [], None)]
    messages += messages[:3]  # repeated rows
    events += events[:5]
    order, dropped = found(spark, messages, events)
    assert dropped == sorted(["no reply", "reply first", "unknown", "null role", "empty", "no user", "second turn bad"])
    assert order["good"] == ["p-t1-0", "p-t1-1", "p-t2-0", "p-t2-1", "p-t2-2", "p-t2-3"] and "empty" not in order


def test_random(spark):
    rng = random.Random(11)
    events, messages, turns = [], [], defaultdict(list)
    for i in range(900):
        session = rng.choice(["hot", "hot", f"s{rng.randrange(40)}"])
        turn = f"{session}-{rng.randrange(60 if session == 'hot' else 3)}"
        at, seq = T0 + dt.timedelta(minutes=rng.randrange(500)), rng.randrange(3)
        role = rng.choice(["user"] * 6 + ["assistant"] * 6 + ["system", "tool"] + ["odd"] * (i % 90 == 0))
        events.append((f"e{i}", turn, session, at, seq))
        messages.append((f"p{i:03}", f"e{i}", role, rng.choice(["text", "text", "text", " "]), [], None))
        turns[session, turn].append((at, seq, f"p{i:03}", role, messages[-1][3] == " "))
    want, order = set(), defaultdict(list)
    for (session, turn), rows in turns.items():
        start = min(r[0] for r in rows)
        order[session] += [(start, turn, *r[:3]) for r in rows if not r[4]]
        left = [r[3] for r in sorted(rows) if not r[4]]
        plain = [r for r in left if r != "system"]
        users = [i for i, r in enumerate(left) if r == "user"]
        if (plain and plain[0] != "user") or (users and "assistant" not in left[users[-1] :]) or "odd" in left:
            want.add(session)
    for session in {s for s, _ in turns}:
        if not any(r[3] == "user" and not r[4] for (s, _), rows in turns.items() if s == session for r in rows):
            want.add(session)
    got, dropped = found(spark, messages, events)
    assert dropped == sorted(want)
    assert got == {s: [x[-1] for x in sorted(v)] for s, v in order.items() if v}


def test_empty(spark):
    assert found(spark, [], []) == ({}, [])


def test_orphan_and_cyclic_pointers(spark):
    rows = [("s", 1, "a", None), ("s", 2, "b", "a"), ("s", 3, "c", "gone"), ("s", 4, "x", "y"), ("s", 5, "y", "x")]
    linked = spark.createDataFrame([(s, p, "user", q, False, True, False) for s, _, p, q in rows], "session_key string, payload_id string, role string, parent string, same_turn boolean, turn_leaf boolean, session_leaf boolean")
    assert {r.payload_id: r.broken_pointer for r in C.resolve(linked).collect()} == {"a": False, "b": False, "c": True, "x": True, "y": True}


def test_sql(spark, sf):
    con = duck(sf)
    for name, sql in SQL.items():
        assert difference(spark, con, QUERIES[name], sql, sf) == ""
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, sf).count() > 0
