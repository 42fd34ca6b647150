"""Process trees: parent edges, subtrees, ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.operators.segments import first_rows, scan_last
from vestige.session import settle

CLONE_WINDOW_NS = 200_000_000
FOREST_WINDOW_NS = 100_000_000
# Keys with more rows than this are joined apart from the rest.
HOT_ROWS = 2_000_000


def _is_clone():
    return F.col("event").isin("clone", "clone3")


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", hot_rows: int = HOT_ROWS, *, rows: int | None = None) -> DataFrame:
    """Join to a side that is unique on ``on`` although some left keys are very frequent.

    Keys above ``hot_rows`` number at most rows/hot_rows, so their right rows are few and
    are sent to every task; all other keys go through the ordinary shuffle.  No key of a table
    of at most ``hot_rows`` rows is above them; ``rows`` is the size of ``left`` where it is known.
    """
    if (left.count() if rows is None else rows) <= hot_rows:
        return left.join(right, on, how)
    hot = left.groupBy(*on).count().filter(F.col("count") > hot_rows).select(*on, F.lit(True).alias("__hot"))
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = settle(hot)
    marked = left.join(F.broadcast(hot), on, "left")
    hot_right = right.join(F.broadcast(hot.drop("__hot")), on, "left_semi")
    hot_part = marked.filter("__hot").drop("__hot").join(F.broadcast(hot_right), on, how)
    cold_part = marked.filter("__hot IS NULL").drop("__hot").join(right, on, how)
    return hot_part.unionByName(cold_part)


# ---- parent edges ----------------------------------------------------------


def fork_edges(events: DataFrame) -> DataFrame:
    """Edges the kernel reported; self-loops and zero pids are noise."""
    return events.filter(
        "event = 'sched_fork' AND parent_pid <> 0 AND child_pid <> 0 AND parent_pid <> child_pid"
    ).select("trace_id", "ts_ns", "seq", F.col("parent_pid").alias("parent"), F.col("child_pid").alias("child"))


def returned_children(calls: DataFrame, by: list[str], name: str = "event") -> DataFrame:
    """Exact edges of the in-container trace: a clone returns the child's pid."""
    child = F.col("ret").try_cast("bigint")
    return calls.filter(F.col(name).isin("clone", "clone3") & (child > 0)).select(
        *by, "ts_ns", "seq", F.col("pid").alias("parent"), child.alias("child")
    )


def with_last_clone(events: DataFrame, **kw) -> DataFrame:
    """Each event with the latest clone before it in its trace, as ``clone``."""
    clone = F.when(_is_clone(), F.struct("pid", "ts_ns", "cgroup_id", "seq"))
    return scan_last(events, ["trace_id"], ["ts_ns", "seq"], clone, "clone", **kw)


def clone_candidates(events: DataFrame, window_ns: int | None = CLONE_WINDOW_NS, *, same_cgroup: bool = True) -> DataFrame:
    """Events whose pid may be the child of the latest clone's caller."""
    slim = events.select("trace_id", "ts_ns", "seq", "pid", "event", "cgroup_id")
    near = with_last_clone(slim).filter("clone IS NOT NULL")
    if window_ns is not None:
        gap = F.col("ts_ns") - F.col("clone.ts_ns")
        near = near.filter((gap >= 0) & (gap < window_ns))
    if same_cgroup:
        caller, own = F.col("clone.cgroup_id"), F.col("cgroup_id")
        near = near.filter(caller.isNull() | own.isNull() | (caller == own))
    return near.select(
        "trace_id", "ts_ns", "seq",
        F.col("clone.pid").alias("parent"), F.col("pid").alias("child"), F.col("clone.ts_ns").alias("clone_ts"),
    )


def label_parents(events: DataFrame) -> DataFrame:
    """One parent per pid for truth labels: the last reported fork, else the first clone
    candidate.  A pid that is its own first candidate keeps no parent."""
    forks = fork_edges(events.filter("event = 'sched_fork'"))
    last_fork = forks.groupBy("trace_id", "child").agg(
        F.max_by("parent", F.struct("ts_ns", "seq")).alias("parent")
    )
    # Fork records carry the parent's pid and are not sightings of a pid.
    seen = clone_candidates(events.filter("event <> 'sched_fork'"))
    guess = seen.groupBy("trace_id", "child").agg(F.min_by("parent", F.struct("ts_ns", "seq")).alias("parent"))
    rest = guess.join(last_fork, ["trace_id", "child"], "left_anti")
    return last_fork.unionByName(rest).filter("parent <> child")


def first_sightings(events: DataFrame) -> DataFrame:
    """First row per (trace, pid): the process vertex."""
    slim = events.select("trace_id", "pid", "ts_ns", "seq", "comm", "event", "argv")
    return first_rows(slim, ["trace_id", "pid"], [F.col("ts_ns"), F.col("seq")])


def inferred_forest(events: DataFrame, window_ns: int = FOREST_WINDOW_NS) -> DataFrame:
    """pid, parent of the host forest: the clone caller seen at most ``window_ns`` before
    the pid's first event.  Before its first event a pid cannot have cloned, so the latest
    earlier clone is always another process."""
    first = events.groupBy("pid", "trace_id").agg(F.min(F.struct("ts_ns", "seq")).alias("at"))
    return forest_of(first, events, window_ns)


def forest_of(first: DataFrame, calls: DataFrame, window_ns: int = FOREST_WINDOW_NS) -> DataFrame:
    """The host forest from each pid's first moment (trace_id, pid, at) and the clones among ``calls``.

    Only these rows are put in order; of one moment, first sightings come before clones.
    """
    seen = first.select("trace_id", "at.ts_ns", "at.seq", "pid", F.lit(False).alias("__clones"))
    clones = calls.filter(_is_clone()).select("trace_id", "ts_ns", "seq", "pid", F.lit(True).alias("__clones"))
    caller = F.when(F.col("__clones"), F.struct("pid", "ts_ns"))
    near = scan_last(settle(seen.unionByName(clones)), ["trace_id"], ["ts_ns", "seq", "__clones"], caller, "clone").filter("NOT __clones")
    fits = (F.col("ts_ns") - F.col("clone.ts_ns")) <= window_ns
    return near.select("trace_id", "pid", F.when(fits, F.col("clone.pid")).alias("parent"))


def keep_first_edge(edges: DataFrame) -> DataFrame:
    return first_rows(edges, ["trace_id", "child", "parent"], [F.col("ts_ns"), F.col("seq")])


# ---- closures --------------------------------------------------------------


def nearest_marked(parents: DataFrame, marked: DataFrame, *, proper: bool = False, by: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """For every node of a forest, its nearest marked ancestor and the distance.

    ``parents`` has (by.., child, parent) with one parent per child, ``marked`` has
    (by.., node).  Pointers are doubled each round, so the number of rounds is the
    logarithm of the depth and a cycle cannot hold the loop up.  A marked node answers
    itself with distance 0; with ``proper`` it looks at its ancestors instead.
    """
    by = list(by)
    nodes = (
        parents.select(*by, F.col("child").alias("node"))
        .unionByName(parents.select(*by, F.col("parent").alias("node")))
        .unionByName(marked.select(*by, "node"))
        .distinct()
    )
    is_marked = marked.select(*by, "node", F.lit(True).alias("m")).dropDuplicates([*by, "node"])
    state = (
        nodes.join(parents.select(*by, F.col("child").alias("node"), F.col("parent").alias("ptr")), [*by, "node"], "left")
        .join(is_marked, [*by, "node"], "left")
        .select(
            *by, "node",
            F.when(F.col("m"), F.col("node")).alias("found"),
            F.when(F.col("m").isNull(), F.col("ptr")).alias("ptr"),
            F.when(F.col("m"), 0).otherwise(1).cast("bigint").alias("hops"),
            F.col("ptr").alias("up"),
        )
    )
    state = settle(state)
    limit = max(2, state.count().bit_length() + 1)
    for _ in range(limit):
        todo = state.filter("found IS NULL AND ptr IS NOT NULL")
        rows = todo.count()
        if not rows:
            break
        done = state.filter("found IS NOT NULL OR ptr IS NULL")
        ahead = state.select(
            *by, F.col("node").alias("ptr"), F.col("found").alias("__found"),
            F.col("ptr").alias("__ptr"), F.col("hops").alias("__hops"),
        )
        moved = lookup(todo, ahead, [*by, "ptr"], rows=rows).select(
            *by, "node",
            F.col("__found").alias("found"),
            F.when(F.col("__found").isNull(), F.col("__ptr")).alias("ptr"),
            (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"),
            "up",
        )
        state = settle(done.unionByName(moved))
    answer = state.select(*by, "node", "found", F.when(F.col("found").isNotNull(), F.col("hops")).alias("hops"), "up")
    if not proper:
        return answer.drop("up")
    above = answer.select(*by, F.col("node").alias("up"), F.col("found").alias("__f"), F.col("hops").alias("__h"))
    return lookup(answer.drop("found", "hops"), above, [*by, "up"]).select(
        *by, "node", F.col("__f").alias("found"), (F.col("__h") + 1).alias("hops")
    )


def descendants(parents: DataFrame, roots: DataFrame, by: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Roots and everything below them: (by.., node, root, depth), nearest root first."""
    found = nearest_marked(parents, roots, by=by)
    return found.filter("found IS NOT NULL").select(
        *by, "node", F.col("found").alias("root"), F.col("hops").alias("depth")
    )


def reachable(edges: DataFrame, roots: DataFrame, by: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Nodes reachable over edges that may give a node several parents: (by.., node, depth), the fewest steps.

    A node with one parent can be reached through that parent only, so chains and trees of such
    nodes are condensed by pointer doubling to the nearest root or node of several parents above
    them.  Shortest paths are then relaxed among those few, from the nodes that came nearer in
    the last round only.
    """
    by = list(by)
    e = settle(edges.filter("parent <> child").select(*by, "parent", "child").distinct())
    start = settle(roots.select(*by, "node").distinct())
    met = e.groupBy(*by, F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("__n"))
    marked = settle(start.unionByName(met.filter("__n > 1").select(*by, "node")).distinct())
    only = e.join(marked.withColumnRenamed("node", "child"), [*by, "child"], "left_anti")
    above = settle(nearest_marked(only, marked, by=tuple(by)).filter("found IS NOT NULL"))
    # From what a chain hangs on to the nodes of several parents that its members lead to.
    into = lookup(e.join(marked.withColumnRenamed("node", "child"), [*by, "child"], "left_semi").withColumnRenamed("parent", "node"), above, [*by, "node"], "inner")
    links = settle(into.groupBy(*by, F.col("found").alias("node"), "child").agg((F.min("hops") + 1).alias("step")))
    nearest = settle(start.withColumn("depth", F.lit(0).cast("bigint")))
    frontier = nearest
    while True:
        step = lookup(links, frontier, [*by, "node"], "inner").groupBy(*by, F.col("child").alias("node")).agg(F.min(F.col("depth") + F.col("step")).alias("depth"))
        known = nearest.withColumnRenamed("depth", "__had")
        frontier = settle(step.join(known, [*by, "node"], "left").filter("__had IS NULL OR depth < __had").drop("__had"))
        if frontier.isEmpty():
            break
        nearest = settle(nearest.join(frontier.select(*by, "node"), [*by, "node"], "left_anti").unionByName(frontier))
    told = lookup(above, nearest.withColumnRenamed("node", "found"), [*by, "found"], "inner")
    return told.select(*by, "node", (F.col("depth") + F.col("hops")).alias("depth"))


def adopted(forks: DataFrame, roots: DataFrame, by: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Time-forward subtree: a fork adopts its child only if the parent is already in.

    Returns (by.., node, at_ns, at_seq): the adoption moment (roots: before everything).
    Every round takes the earliest valid fork per child given the previous round; a
    member's moment only moves earlier, so equality of two rounds is the fixpoint.
    """
    by = list(by)
    start = roots.select(
        *by, "node", F.lit(-(1 << 62)).cast("bigint").alias("at_ns"), F.lit(-1).cast("bigint").alias("at_seq")
    ).dropDuplicates([*by, "node"])
    members = settle(start)
    mark = None
    while True:
        inside = members.select(*by, F.col("node").alias("parent"), "at_ns", "at_seq")
        step = (
            lookup(forks.select(*by, "parent", "child", "ts_ns", "seq"), inside, [*by, "parent"], "inner")
            .filter("(ts_ns > at_ns) OR (ts_ns = at_ns AND seq > at_seq)")
            .select(*by, F.col("child").alias("node"), F.struct("ts_ns", "seq").alias("at"))
        )
        merged = (
            start.select(*by, "node", F.struct(F.col("at_ns").alias("ts_ns"), F.col("at_seq").alias("seq")).alias("at"))
            .unionByName(step)
            .groupBy(*by, "node")
            .agg(F.min("at").alias("at"))
            .select(*by, "node", F.col("at.ts_ns").alias("at_ns"), F.col("at.seq").alias("at_seq"))
        )
        members = settle(merged)
        now = digest(members)
        if now == mark:
            return members
        mark = now


def digest(df: DataFrame) -> tuple:
    """Row count and an order-free checksum, to see whether a table changed."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return tuple(row)
