"""Parent-child links of unknown depth as full hierarchies: path, depth, root, descendants; cycles told apart.

Method: every node whose hash is 0 modulo ``SPACING`` is a splitter, as are hubs with very many children. Each node walks
to its next splitter (pointer doubling over short stretches), the graph of splitters alone is solved the same way, and the
exact path of a node is its own stretch followed by its splitter's path. A walk that meets no splitter and no root leads
into a splitterless cycle; these are few and are solved apart by doubling until the image of the jump stops shrinking.

Scale: rounds grow with the logarithm of the longest stretch, not with the depth; finished nodes leave the loop; the join
back to the splitters is salted, since one splitter or hub may stand above a third of all nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.ids import canonical, reference
from loomtrace.operators.skew import hot_keys, salted_join
from loomtrace.session import settled, written

#: One node in so many is a splitter.
SPACING = 8
#: A node with so many children is a splitter too (the HOT largest of them).
HUB_CHILDREN = 20_000


def _by_hash(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SPACING)) == 0


def double_pointers(state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Follow ``id -> cur`` by doubling until ``done``; returns finished rows and those that never finish (or None).

    state: ``id, cur, done`` and, if the ways are wanted, ``seg`` (array of ids from id to before cur). A row that isn't done
    must point at an existing id.
    In every round an unfinished row jumps over the stretch of the row it points at. Walks are closed under suffixes, so a
    round in which the number of unfinished rows stays the same leaves only walks without an end.
    """
    state = written(state)
    finished, active = [state.filter("done")], state.filter("not done")
    last, n = -1, active.count()
    ways = "seg" in state.columns
    more, joined = ([F.col("seg").alias("more")], [F.concat("seg", "more").alias("seg")]) if ways else ([], [])
    while n not in (0, last):
        table = reduce(DataFrame.unionByName, finished, active).select(F.col("id").alias("cur"), F.col("cur").alias("next"), *more, F.col("done").alias("ended"))
        hop = active.drop("done").join(table, "cur").select("id", F.col("next").alias("cur"), *joined, F.col("ended").alias("done"))
        hop = written(hop)
        finished.append(hop.filter("done"))
        active, last = hop.filter("not done"), n
        n = active.count()
    return reduce(DataFrame.unionByName, finished), active if n else None


def endless(active: DataFrame) -> DataFrame:
    """Of rows ``id, cur`` that form a total function on their ids: the ids on cycles (``id``).

    The image of the jump shrinks until it holds exactly the nodes on cycles; the jump doubles every round.
    """
    jump, last = written(active.select("id", "cur")), -1
    while True:
        image = written(jump.select("cur").distinct())
        n = image.count()
        if n == last:
            return image.select(F.col("cur").alias("id"))
        last = n
        jump = written(jump.join(jump.select(F.col("id").alias("cur"), F.col("cur").alias("next")), "cur").select("id", F.col("next").alias("cur")))


def _walks(links: DataFrame) -> tuple[DataFrame, DataFrame | None, Column]:
    """Every node's way ``id, cur, seg, done`` to its next splitter or root, the ways without an end, and what a splitter ``id`` is."""
    nodes = links.filter("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    nodes = written(nodes)
    kids = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    kids = written(kids.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi"))
    crowded = hot_keys(kids, ["parent"], "n_children")
    hubs = [r.parent for r in hot_keys(kids, ["parent"], "n_children", HUB_CHILDREN).collect()]  # at most HOT
    valid = salted_join(nodes, kids.select("parent", F.lit(True).alias("exists")), ["parent"], crowded, "left")
    cur = F.when(F.col("exists"), F.col("parent"))
    splits = lambda c: _by_hash(c) | c.isin(hubs) if hubs else _by_hash(c)
    state = valid.select("id", cur.alias("cur"), F.array("id").alias("seg"), (cur.isNull() | splits(cur)).alias("done"))
    return *double_pointers(state), splits(F.col("id"))


def cycle_nodes(links: DataFrame) -> DataFrame:
    """The ``id`` of every node on a cycle, as :func:`solve_hierarchy` tells them, from pointers alone: no path is built.

    Only the stretches between splitters, of a few ids each, are kept; the graph of splitters is solved without them.
    """
    return settled(links.sparkSession, lambda: _cycle_nodes(links))


def _cycle_nodes(links: DataFrame) -> DataFrame:
    walked, lost, is_splitter = _walks(links)
    reduced = walked.filter(is_splitter).select("id", "cur", F.col("cur").isNull().alias("done"))
    if lost is not None:  # these end in a splitterless cycle
        reduced = reduced.unionByName(lost.filter(is_splitter).select("id", F.lit(None).cast("string").alias("cur"), F.lit(True).alias("done")))
    circling = double_pointers(reduced)[1]
    parts = []
    if circling is not None:
        parts.append(walked.join(endless(circling), "id", "left_semi").select(F.explode("seg").alias("id")))
    if lost is not None:
        parts.append(endless(lost))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else walked.select("id").limit(0)


def solve_hierarchy(links: DataFrame) -> DataFrame:
    """``id, root, depth, path, status`` of every node of ``links`` (``id`` string, ``parent`` string or null).

    status is ``tree``, ``cycle`` (the node lies on one, a node that is its own parent included) or ``below_cycle``. For the
    latter two root, depth and path are null. path runs from the root to the node; a root has depth 0. A parent that is no
    id ends the path. Rows with a null id are left out; an id in several rows takes its smallest parent. No rows: no rows.
    """
    return settled(links.sparkSession, lambda: _solve(links))


def _solve(links: DataFrame) -> DataFrame:
    walked, lost, is_splitter = _walks(links)
    # The reduced graph: splitters only, each pointing at the next one.
    reduced = walked.filter(is_splitter).withColumn("done", F.col("cur").isNull())
    doomed = None
    if lost is not None:  # splitters whose walk ends in a splitterless cycle
        doomed = lost.filter(is_splitter).select("id")
        sinks = doomed.select("id", F.lit(None).cast("string").alias("cur"), F.array(F.lit(None).cast("string")).alias("seg"), F.lit(True).alias("done"))
        reduced = reduced.unionByName(sinks)
    solved, circling = double_pointers(reduced)
    solved = solved.select("id", F.col("seg").alias("up"), F.when(F.element_at("seg", -1).isNull(), "below_cycle").otherwise("tree").alias("status"))
    on_cycle = None
    if circling is not None:
        rings = endless(circling)
        # The stretch of a splitter on a cycle lies on the cycle as a whole.
        on_cycle = walked.join(rings, "id", "left_semi").select(F.explode("seg").alias("id"))
        solved = solved.unionByName(circling.select("id", F.lit(None).cast("array<string>").alias("up"), F.lit("below_cycle").alias("status")))

    at_root = walked.filter("cur is null").select("id", F.col("seg").alias("up"), F.lit("tree").alias("status"))
    to_split = walked.filter("cur is not null").select("id", "cur", "seg")
    crowd = hot_keys(to_split.groupBy("cur").agg(F.count("*").alias("n")), ["cur"], "n")
    below = salted_join(to_split, solved.withColumnRenamed("id", "cur"), ["cur"], crowd)
    every = at_root.unionByName(below.select("id", F.concat("seg", "up").alias("up"), "status"))
    if lost is not None:
        every = every.unionByName(lost.select("id", F.lit(None).cast("array<string>").alias("up"), F.lit("below_cycle").alias("status")))
        apart = endless(lost)
        on_cycle = apart if on_cycle is None else on_cycle.unionByName(apart)
    if on_cycle is not None:
        ring = on_cycle.distinct().withColumn("ring", F.lit(True))
        every = every.join(ring, "id", "left").withColumn("status", F.when(F.col("ring"), "cycle").otherwise(F.col("status"))).drop("ring")
    tree = F.col("status") == "tree"
    return every.select(
        "id",
        F.when(tree, F.element_at("up", -1)).alias("root"),
        F.when(tree, F.size("up") - 1).alias("depth"),
        F.when(tree, F.reverse("up")).alias("path"),
        "status",
    )


def descendants(solved: DataFrame) -> DataFrame:
    """Every pair ``ancestor, id, distance`` of the trees (distance 1 or more), one row each: no list grows with a hub."""
    above = F.posexplode(F.slice("path", 1, F.col("depth"))).alias("pos", "ancestor")
    return solved.filter("status = 'tree' and depth > 0").select("id", "depth", above).select("ancestor", "id", (F.col("depth") - F.col("pos")).alias("distance"))


def with_descendant_counts(solved: DataFrame) -> DataFrame:
    """``solved`` with ``n_descendants`` (0 for leaves, null off the trees); counted with a map-side combine."""
    counts = descendants(solved).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_descendants"))
    return solved.join(counts, "id", "left").withColumn("n_descendants", F.when(F.col("status") == "tree", F.coalesce("n_descendants", F.lit(0))))


def run_links(audit_events: DataFrame) -> DataFrame:
    """``id, parent`` of every started run: parent_run_id if it is a reference, else resumed_from_run_id if it is one, else
    the run of the event that caused_by_event_id names. Of several ``run_started`` rows of a run the earliest counts."""
    first = F.min(F.struct("recorded_at", "event_id", reference(F.col("parent_run_id")).alias("p"), reference(F.col("resumed_from_run_id")).alias("r"), reference(F.col("caused_by_event_id")).alias("c"))).alias("s")
    started = audit_events.filter(F.col("event_type") == "run_started").groupBy(canonical(F.col("run_id")).alias("id")).agg(first)
    started = written(started.filter("id is not null").select("id", F.coalesce("s.p", "s.r").alias("parent"), F.when(F.coalesce("s.p", "s.r").isNull(), F.col("s.c")).alias("cause")))
    events = audit_events.filter("run_id is not null and event_id is not null").select(canonical(F.col("event_id")).alias("cause"), canonical(F.col("run_id")).alias("parent"))
    caused = started.filter("cause is not null").select("id", "cause")
    crowd = hot_keys(caused.groupBy("cause").agg(F.count("*").alias("n")), ["cause"], "n")
    through = salted_join(caused, events, ["cause"], crowd).select("id", "parent")
    return started.select("id", "parent").unionByName(through)


def run_hierarchy(audit_events: DataFrame) -> DataFrame:
    """:func:`solve_hierarchy` over the runs of the event log."""
    return solve_hierarchy(run_links(audit_events))
