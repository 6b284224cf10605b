"""Message rows rebuilt into ordered conversations, and the conversations that are broken, empty or lack a reply.

Method: every remaining message gets a pointer to its parent, the message before it in its session; pointer-jumping joins
follow these pointers in doubling steps to the root, adding up the distance (the message's position on the root-to-leaf
path) and what lies on the way: users, unknown roles, and within the turn its first speaker and whether its last user
message is answered. The state at the leaf of a turn or session decides whether the conversation is dropped.

Scale: order comes from a range partitioning over session, turn and time, so a session with a third of all rows is spread
over many tasks and no task sees it as a whole; every message is the parent of one other, so the joins have no hot keys;
rows leave the loop when they reach their root, and only sessions still open are joined again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.ids import canonical
from loomtrace.operators.neighbours import with_neighbours
from loomtrace.operators.skew import hot_keys, salted_join
from loomtrace.session import settled, written

# Spellings of the speaker roles, and what counts as invisible.
ROLES = {
    "user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "model": "assistant",
    "system": "system", "developer": "system", "tool": "tool", "function": "tool",
}
UNSEEN = r"[\s\p{Z}\x1C-\x1F\x85​-‍⁠﻿]"
ORDER = ["session_key", "turn_start", "turn_id", "occurred_at", "segment_sequence", "payload_id"]


def speaker(role: Column) -> Column:
    """The role ignoring case and outer blanks: user, assistant, system, tool or unknown (null and anything else)."""
    bare = F.lower(F.regexp_replace(role, rf"^{UNSEEN}+|{UNSEEN}+$", ""))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.coalesce(bare, F.lit(""))], F.lit("unknown"))


def shown_text(content: Column) -> Column:
    """The text of a content: of the JSON text of a list of blocks the text blocks together, else the content itself."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    is_list = F.ltrim(content).startswith("[") & blocks.isNotNull() & F.forall(blocks, lambda b: b["type"].isNotNull())
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(is_list, F.concat_ws("", texts)).otherwise(content)


def is_blank(content: Column, media_refs: Column) -> Column:
    """True if there are no media and nothing visible in the text."""
    none = F.coalesce(F.size(media_refs), F.lit(0)) <= 0
    return none & F.coalesce(shown_text(content), F.lit("")).rlike(rf"\A{UNSEEN}*\z")


def place(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Messages with a place: ``payload_id, session_key, turn_start, turn_id, occurred_at, segment_sequence, role, blank``.

    A message belongs to its event's turn, a turn to the session found on any of its rows (of several the smallest); a message
    whose event, turn or session is missing has no place and is left out. Repeated rows of a payload_id count once.
    """
    own = F.struct(canonical(F.col("event_id")).alias("event_id"), speaker(F.col("role")).alias("role"), is_blank(F.col("content"), F.col("media_refs")).alias("blank"))
    once = written(messages.filter("payload_id is not null and event_id is not null").groupBy("payload_id").agg(F.min(own).alias("m")).select("payload_id", "m.*"))
    rows = events.filter("turn_id is not null")
    of_event = rows.select(canonical(F.col("event_id")).alias("event_id"), "turn_id", "occurred_at", "segment_sequence").filter("event_id is not null")
    busy = hot_keys(once.groupBy("event_id").agg(F.count("*").alias("n")), ["event_id"], "n")
    # Deliveries of an event agree but for recorded_at: what the join repeats falls together here.
    in_turn = salted_join(once, of_event, ["event_id"], busy).drop("event_id").distinct()
    in_turn = written(in_turn.groupBy("payload_id", "role", "blank").agg(F.min(F.struct("turn_id", "occurred_at", "segment_sequence")).alias("p")).select("payload_id", "role", "blank", "p.*"))
    starts = rows.groupBy("turn_id", "session_key").agg(F.min("occurred_at").alias("start"))
    turns = starts.groupBy("turn_id").agg(F.min("session_key").alias("session_key"), F.min("start").alias("turn_start")).filter("session_key is not null")
    long = hot_keys(in_turn.groupBy("turn_id").agg(F.count("*").alias("n")), ["turn_id"], "n")
    return salted_join(in_turn, turns, ["turn_id"], long).select(*ORDER, "role", "blank")


def link(placed: DataFrame) -> DataFrame:
    """Adds ``parent`` (the message before it in its session, or null), ``same_turn`` (it is in the same turn),
    ``turn_leaf`` and ``session_leaf`` (no later message of the turn or session)."""
    near = with_neighbours(placed, ORDER[:1], ORDER[1:], ["turn_id", "payload_id"])
    return near.select(
        *placed.columns,
        F.col("prev_payload_id").alias("parent"),
        (F.col("has_prev") & F.col("prev_turn_id").eqNullSafe(F.col("turn_id"))).alias("same_turn"),
        (~(F.col("has_next") & F.col("next_turn_id").eqNullSafe(F.col("turn_id")))).alias("turn_leaf"),
        (~F.col("has_next")).alias("session_leaf"),
    )


#: What a message knows of the stretch of its path from itself back to, but without, the message it points at.
_STRETCH = ["depth", "any_user", "any_unknown", "open", "opens", "has_user", "answered", "replied"]


def _lengthen(near: str, far: str) -> list[Column]:
    """The stretch of a message lengthened by that of the message it points at (``far``), which lies before it."""
    c = lambda side, name: F.col(f"{side}.{name}")
    within = c(near, "open")  # the far stretch begins in the same turn
    return [
        (c(near, "depth") + c(far, "depth")).alias("depth"),
        (c(near, "any_user") | c(far, "any_user")).alias("any_user"),
        (c(near, "any_unknown") | c(far, "any_unknown")).alias("any_unknown"),
        (within & c(far, "open")).alias("open"),
        F.when(within, F.coalesce(c(far, "opens"), c(near, "opens"))).otherwise(c(near, "opens")).alias("opens"),
        (c(near, "has_user") | (within & c(far, "has_user"))).alias("has_user"),
        F.when(c(near, "has_user"), c(near, "answered")).otherwise(within & c(far, "has_user") & (c(far, "answered") | c(near, "replied"))).alias("answered"),
        (c(near, "replied") | (within & c(far, "replied"))).alias("replied"),
    ]


def resolve(linked: DataFrame) -> DataFrame:
    """Follows ``parent`` to the root: adds the columns of a stretch, ``depth`` (0 at the root) and ``broken_pointer``.

    A parent that is no message (an orphan) or a cycle of parents marks its messages as broken; the pointers that
    :func:`link` makes have neither.
    """
    role = F.col("role")
    state = linked.select(
        *[c for c in linked.columns if c not in ("parent", "same_turn")],
        F.col("parent").alias("ptr"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        (role == "user").alias("any_user"),
        (role == "unknown").alias("any_unknown"),
        F.col("same_turn").alias("open"),
        F.when(role != "system", role).alias("opens"),
        (role == "user").alias("has_user"),
        F.lit(False).alias("answered"),
        (role == "assistant").alias("replied"),
        F.lit(False).alias("broken_pointer"),
    )
    table = written(state)
    done, active, last = [table.filter("ptr is null")], table.filter("ptr is not null"), -1
    kept = [c for c in state.columns if c not in ("ptr", "broken_pointer", *_STRETCH)]
    n = active.count()
    while n not in (0, last):
        far = table.select(F.col("payload_id").alias("ptr"), F.col("ptr").alias("beyond"), *_STRETCH, F.lit(True).alias("exists"))
        hop = active.alias("a").join(far.alias("b"), F.col("a.ptr") == F.col("b.ptr"), "left")
        orphan = F.col("b.exists").isNull()
        hop = hop.select(
            *[f"a.{c}" for c in kept],
            F.col("b.beyond").alias("ptr"),
            *[F.when(orphan, F.col(f"a.{name}")).otherwise(new).alias(name) for name, new in zip(_STRETCH, _lengthen("a", "b"))],
            orphan.alias("broken_pointer"),
        )
        hop = written(hop)
        done.append(hop.filter("ptr is null"))
        active, last = hop.filter("ptr is not null"), n
        n = active.count()
        if n not in (0, last):
            # Only sessions that are still open are looked up again.
            live = active.select("session_key").distinct()
            rooted = table.filter("ptr is null").unionByName(hop.filter("ptr is null")).join(live, "session_key", "left_semi")
            table = written(rooted.unionByName(active))
            active = table.filter("ptr is not null")
    if n:  # only cycles never reach a root
        done.append(active.withColumn("broken_pointer", F.lit(True)))
    return reduce(lambda a, b: a.unionByName(b), done)


def conversations(messages: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(paths, dropped)`` of all placed messages.

    paths: one row per remaining message with ``session_key, depth, turn_id, payload_id, role``; depth orders a conversation from
    its root. dropped: ``session_key`` of every conversation in which no user message remains, a remaining role is unknown, the
    first remaining message of a turn other than system is not the user's, or the last user message of a turn has no
    assistant message after it. Blank messages count as absent. Ties in time are ordered by segment_sequence, then payload_id.
    """
    spark = messages.sparkSession
    placed = settled(spark, lambda: place(messages, events))
    paths = settled(spark, lambda: resolve(link(placed.filter("not blank").drop("blank"))))
    turn_bad = F.col("turn_leaf") & ((F.col("opens") != "user") | (F.col("has_user") & ~F.col("answered")))
    session_bad = F.col("session_leaf") & (~F.col("any_user") | F.col("any_unknown"))
    bad = paths.filter(turn_bad | session_bad | F.col("broken_pointer")).select("session_key").distinct()
    remaining = paths.select("session_key").distinct()
    empty = placed.select("session_key").distinct().join(remaining, "session_key", "left_anti")
    return paths, bad.unionByName(empty)


def kept_messages(messages: DataFrame, events: DataFrame) -> DataFrame:
    """The conversations that are not dropped: ``session_key, position, turn_id, payload_id, role, content``.

    One row per message, ordered by position from 0, so that a conversation of any length is no single row.
    """
    paths, dropped = conversations(messages, events)
    kept = paths.join(dropped, "session_key", "left_anti").select("session_key", F.col("depth").alias("position"), "turn_id", "payload_id", "role")
    texts = messages.filter("payload_id is not null").groupBy("payload_id").agg(F.min("content").alias("content"))
    return kept.join(texts, "payload_id").select("session_key", "position", "turn_id", "payload_id", "role", "content")
