"""Which session and tool server each process belongs to, over time.

Every state change of a pid comes from one of four operations: a session root, a server
start, a reported fork, or an event shortly after a clone.  An operation's outcome depends on
its pid's state and its parent's state just before it.

A pid that is in a session stays in one, so whether a parent was in a session at some moment follows
from its first moment in one.  These first moments are found in rounds over one row per pid,
which follow the depth of the process tree.  They settle which operations set a session and from
which earlier operation each took it; the labels then come along these links by pointer
doubling.  Servers are found in the same way, over the stretches between a pid's roots.  Clone
candidates, the many, take part only in the rounds.
"""

from __future__ import annotations

import itertools
import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.functions import rpc
from vestige.operators import detect
from vestige.operators.graph import CLONE_WINDOW_NS, clone_candidates, fork_edges, nearest_marked, with_last_clone
from vestige.operators.segments import first_rows, has_large, ordinal, scan_last, scan_next, scan_sums
from vestige.operators.timejoin import asof, in_window
from vestige.session import settle

log = logging.getLogger(__name__)

#: Rounds of binding before chains are walked in time order, and edges of a stretch that is walked.
PLAIN_ROUNDS = 8
SLAB_ROWS = 200_000
#: Edges are walked before that as soon as no more stretches than these are left of them, and no more
#: edges for each operation that heard something: a walk reads all of them, a round only what was heard.
FEW_SLABS, LEFT_PER_HEARD = 64, 16

STEP = {"clone": 0, "root": 1, "server": 2, "fork": 3}


def operations(
    events: DataFrame,
    *,
    detector: str = "layered",
    registry: bool = True,
    window_ns: int | None = CLONE_WINDOW_NS,
    roots_before: DataFrame | None = None,
) -> DataFrame:
    """All operations that may change a pid's state, in trace order (ts_ns, seq, step).

    ``roots_before`` (trace_id, n_roots) continues the session numbering of earlier events.
    """
    forks = fork_edges(events)
    reported = forks.groupBy("trace_id", "child").agg(F.min(F.struct("ts_ns", "seq")).alias("__first"))
    clones = (
        clone_candidates(events, window_ns)
        .filter("parent <> child")
        .join(reported, ["trace_id", "child"], "left")
        .filter(F.col("__first").isNull() | (F.struct("ts_ns", "seq") < F.col("__first")))
        .select("trace_id", "ts_ns", "seq", F.lit("clone").alias("kind"), F.col("child").alias("pid"), "parent", "clone_ts")
    )
    # Landed: the roots, the registrations and every lookup of a server read them again.
    execs = settle(events.filter("event = 'execve'").select("trace_id", "ts_ns", "seq", "pid", "event", "path", "argv"))
    is_root = detect.session_root(F.col("event"), F.col("path"), F.col("argv"))
    roots = settle(execs.filter(is_root).select("trace_id", "ts_ns", "seq", "pid"))
    roots = ordinal(roots, ["trace_id"], ["ts_ns", "seq"], "n")
    if roots_before is not None:
        roots = roots.join(roots_before, "trace_id", "left").withColumn("n", F.col("n") + F.coalesce("n_roots", F.lit(0)))
    roots = roots.select(
        "trace_id", "ts_ns", "seq", F.lit("root").alias("kind"), "pid",
        F.concat(F.lit("sess_"), F.col("n") - 1).alias("label"),
    )
    if detector == "strict":
        named = execs.withColumn(
            "server_label", detect.strict_server(F.col("event"), F.col("path"), F.col("argv"))
        ).withColumn("server_layer", F.lit("strict"))
    else:
        named = detect.layered_servers(execs, registry=registry)
    servers = named.filter("server_label IS NOT NULL").select(
        "trace_id", "ts_ns", "seq", F.lit("server").alias("kind"), "pid",
        F.col("server_label").alias("label"), F.col("server_layer").alias("layer"),
    )
    forks = forks.select(
        "trace_id", "ts_ns", "seq", F.lit("fork").alias("kind"), F.col("child").alias("pid"), "parent"
    )
    table = F.create_map(*[F.lit(x) for kv in STEP.items() for x in kv])
    return (
        clones.unionByName(roots, allowMissingColumns=True)
        .unionByName(servers, allowMissingColumns=True)
        .unionByName(forks, allowMissingColumns=True)
        .withColumn("step", F.element_at(table, F.col("kind")))
    )


def _earliest(starts: DataFrame, edges: DataFrame, node: list[str], source: list[str], message: str) -> DataFrame:
    """The first moment ``at`` of every node (columns ``node``) that ``edges`` lead to from ``starts``, in time order.

    An edge of moment ``at`` passes on what its ``source`` has had since before ``at``.  Only nodes
    that came earlier in the last round are told on, and of the edges only those that can still
    make their node earlier are kept; these are cut down after rounds 1, 2, 4, 8, ...  Once few
    are left, and after PLAIN_ROUNDS, when they are long chains, the edges, in time order, are
    cut into stretches of SLAB_ROWS; a round walks every stretch where something is new, so that
    only steps from one stretch to the next take rounds.  One stretch is done in one round.
    """
    came = lambda known, key, name: known.select(*[F.col(n).alias(k) for n, k in zip(node, key, strict=True)], F.col("at").alias(name))
    useful = F.col("__had").isNull() | (F.col("at") < F.col("__had"))
    known = frontier = settle(starts)
    slabs = 0
    for turn in itertools.count():
        told = edges.join(came(known if slabs else frontier, source, "__from"), source, "left" if slabs else "inner")
        told = told.join(came(known, node, "__had"), node, "left").filter(useful)
        heard = F.coalesce(F.col("__from") < F.col("at"), F.lit(False))
        if slabs == 1:
            frontier = _walked(told.withColumn("__heard", heard), node, source)
            log.info(message, turn, frontier.count())
            return settle(known.unionByName(frontier).groupBy(*node).agg(F.min("at").alias("at")))
        if slabs:
            told = settle(told.withColumn("__heard", heard))
            fresh = told.filter("__heard")
            again = fresh.count()
            frontier = _walked(told.join(fresh.select("__slab").distinct(), "__slab", "left_semi"), node, source) if again else None
        else:
            frontier = settle(told.filter(heard).groupBy(*node).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("__n")))
            again = frontier.agg(F.sum("__n")).first()[0] or 0
            frontier = frontier.drop("__n")
        log.info(message, turn, again)
        if not again:
            return known
        known = settle(known.unionByName(frontier).groupBy(*node).agg(F.min("at").alias("at")))
        if slabs and turn <= PLAIN_ROUNDS:
            continue
        if not turn & (turn + 1) or turn == PLAIN_ROUNDS:
            edges = settle(edges.join(came(known, node, "__had"), node, "left").filter(useful).drop("__had"))
            left = edges.count()
            cut = slabs or -(-left // SLAB_ROWS) or 1
            if not slabs and ((cut <= FEW_SLABS and left <= LEFT_PER_HEARD * again) or turn == PLAIN_ROUNDS):
                slabs = cut
                edges = settle(edges.repartitionByRange(slabs, node[0], "at").withColumn("__slab", F.spark_partition_id()))


def _walked(told: DataFrame, node: list[str], source: list[str]) -> DataFrame:
    """(node.., at): what the edges of each stretch, walked in time order, lead to inside it."""
    name = lambda key: F.concat_ws("|", *reversed(key))
    low = F.lit(-(1 << 63)).cast("bigint")
    fields = {f.name: f.dataType.simpleString() for f in told.schema.fields}
    clock = ["ts_ns", "seq", "step"]

    def walk(rows):
        rows = rows.sort_values(clock)
        first, keep = {}, []
        moments = zip(rows["ts_ns"], rows["seq"], rows["step"], strict=True)
        for at, heard, before, to in zip(moments, rows["heard"], rows["before"], rows["to"], strict=True):
            took = to not in first and (heard or (before in first and first[before] < at))
            if took:
                first[to] = at
            keep.append(took)
        return rows[keep][[*node, *clock]]

    rows = told.select("__slab", *node, *[F.coalesce(F.col(f"at.{c}").cast("bigint"), low).alias(c) for c in clock], F.col("__heard").alias("heard"), name(source).alias("before"), name(node).alias("to"))
    out = ", ".join([*[f"{n} {fields[n]}" for n in node], *[f"{c} bigint" for c in clock]])
    got = rows.groupBy("__slab").applyInPandas(walk, out).withColumns({c: F.nullif(c, low) for c in clock})
    return settle(got.select(*node, F.struct(*clock).cast(fields["at"]).alias("at")).groupBy(*node).agg(F.min("at").alias("at")))


def _resolved(links: DataFrame, given: DataFrame) -> DataFrame:
    """(op, value): what each operation took over, through ``links`` (trace_id, op, link), from the ``given`` ones (trace_id, op, value).

    Both are read several times, and come landed.
    """
    chains = nearest_marked(
        links.select("trace_id", F.col("op").alias("child"), F.col("link").alias("parent")),
        given.select("trace_id", F.col("op").alias("node")),
    )
    return chains.filter("found IS NOT NULL").join(given.select(F.col("op").alias("found"), "value"), "found").select(F.col("node").alias("op"), "value")


def bind(events: DataFrame, **options) -> DataFrame:
    """State changes (trace_id, pid, ts_ns, seq, step, kind, session, server, ...)."""
    return fixpoint(operations(events, **options))


def fixpoint(ops: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """State changes caused by ``ops`` (read once), given the states that held ``before`` them.

    Sessions: a root or a fork of a bound parent sets one at any time, a clone only where none is
    set, so that only a pid's first moment in a session can be a clone's.  Servers, since the latest
    root (an era): a fork of a served parent sets one at any time; a server start in a session, or
    the clone that set the session, only where none is set.
    """
    who, order = ["trace_id", "pid"], ["ts_ns", "seq", "step"]
    ops = ops.withColumn("given_server", F.lit(None).cast("string"))
    if before is not None:
        ops = ops.unionByName(before.select(
            *who, *order, F.lit("given").alias("kind"), F.col("session").alias("label"), F.col("server").alias("given_server"),
        ), allowMissingColumns=True)
    ops = settle(ops.dropna(subset=who).withColumn("op", F.monotonically_increasing_id()).withColumn("at", F.struct(*order)))
    kind = F.col("kind")
    reset, follows = kind.isin("root", "given"), kind.isin("fork", "clone")
    passed = settle(ops.filter(follows & F.col("parent").isNotNull()).select(*who, "parent", "at"))
    bound = _earliest(
        ops.filter(reset & F.col("label").isNotNull()).groupBy(*who).agg(F.min("at").alias("at")),
        passed, who, ["trace_id", "parent"], "binding round %d: %d operations hear something new",
    )
    # From here on only operations that may set something: all others saw an unbound parent or came too late.
    own = bound.withColumnRenamed("at", "__own")
    parent = bound.select("trace_id", F.col("pid").alias("parent"), F.col("at").alias("__parent"))
    heard = F.coalesce(F.col("__parent") < F.col("at"), F.lit(False))
    bindable = ops.join(own, who)
    forks = bindable.filter("kind = 'fork'").join(parent, ["trace_id", "parent"]).filter(heard)
    clones = bindable.filter("kind = 'clone' AND at = __own").join(parent, ["trace_id", "parent"]).filter(heard)
    clones = first_rows(clones, who, [F.col("op")])
    others = bindable.filter(reset | ((kind == "server") & (F.col("__own") < F.col("at"))))
    acts = settle(others.unionByName(forks.drop("__parent")).unionByName(clones.drop("__parent")).drop("__own"))
    large = has_large(acts, who)
    by_time = [*order, "op"]
    acts = settle(scan_sums(acts, who, by_time, {"era": F.when(reset, 1).otherwise(0)}, large=large))
    # What a fork or clone looks at: its parent's latest change of session before it, and the era of that.
    seen = acts.filter("kind <> 'server'").select(
        "trace_id", F.col("pid").alias("parent"), *order, F.col("op").alias("link"), F.col("era").alias("parent_era"))
    linked = settle(asof(
        acts.filter(follows).select(*who, *order, "op", "at", "kind", "era", "parent"), seen, ["trace_id", "parent"], "ts_ns", "ts_ns",
        ["link", "parent_era"], ties=["seq", "step"], right_ties=["seq", "step"], same_instant=False,
    ))
    # The labels come along their links while the servers are found: neither needs the other.
    side = ThreadPoolExecutor(1)
    resolve = inheritable_thread_target(ops.sparkSession)(_resolved)
    sessions = side.submit(resolve, linked, acts.filter(reset).select("trace_id", "op", F.col("label").alias("value")))
    side.shutdown(wait=False)
    # Servers: the same over eras, which a root ends.
    name = F.concat_ws("|", F.col("pid").cast("string"), F.col("seq").cast("string"), F.col("label"))
    opened = acts.filter("kind = 'server' OR given_server IS NOT NULL").withColumn("value", F.when(kind == "server", name).otherwise(F.col("given_server")))
    opened = settle(opened.select(*who, *order, "era", "op", "at", "kind", "value"))
    era, parent_era = [*who, "era"], ["trace_id", "parent", "parent_era"]
    served = _earliest(
        opened.groupBy(*era).agg(F.min("at").alias("at")), settle(linked.select(*era, "parent", "parent_era", "at")), era, parent_era,
        "binding of servers, round %d: %d operations hear something new",
    )
    parent = served.select("trace_id", F.col("pid").alias("parent"), F.col("era").alias("parent_era"), F.col("at").alias("__parent"))
    told = settle(linked.join(parent, parent_era).filter(heard).drop("__parent"))
    # A start or a clone counts only as the first of its era; forks and given states always do.
    may = opened.filter("kind = 'server'").select(*era, "op", "at").unionByName(told.filter("kind = 'clone'").select(*era, "op", "at"))
    may = settle(first_rows(may.join(served.withColumnRenamed("at", "__first"), era).filter("at = __first"), era, [F.col("op")]).select("op"))
    serves = lambda df: df.filter("kind IN ('fork', 'given')").unionByName(df.filter("kind NOT IN ('fork', 'given')").join(may, "op", "left_semi").select(*df.columns))
    told, opened = settle(serves(told)), settle(serves(opened))
    columns = [*era, *order, "op"]
    setters = told.select(*columns).unionByName(opened.select(*columns))
    looked = settle(asof(
        told, setters.select("trace_id", F.col("pid").alias("parent"), F.col("era").alias("parent_era"), *order, F.col("op").alias("by")), parent_era, "ts_ns", "ts_ns",
        ["by"], ties=["seq", "step"], right_ties=["seq", "step"], same_instant=False,
    ).select("trace_id", "op", "by"))
    names = _resolved(looked.select("trace_id", "op", F.col("by").alias("link")), opened.select("trace_id", "op", "value"))
    rows = acts.join(sessions.result().withColumnRenamed("value", "__session"), "op", "left").join(names.withColumnRenamed("value", "__server"), "op", "left")
    rows = scan_last(settle(rows) if large else rows, who, by_time, F.col("__session"), "session", inclusive=True, large=large)
    rows = scan_last(rows, era, by_time, F.col("__server"), "server", inclusive=True, large=large)
    rows = scan_last(rows, who, by_time, F.struct("session", "server"), "was", large=large)
    moved = ~F.col("session").eqNullSafe(F.col("was.session")) | ~F.col("server").eqNullSafe(F.col("was.server"))
    return settle(rows.filter((kind == "root") | ((kind != "given") & moved)).select(
        *who, *order, "kind", "session", "server", "parent", "clone_ts", "label", "layer"
    ))


def servers(states: DataFrame, events: DataFrame | None = None, sent: DataFrame | None = None) -> DataFrame:
    """One row per server: ids in opening order, and how the server was confirmed.

    ``sent`` are the events' ``sends``, where they were made already.
    """
    opened = states.filter("kind = 'server'").select(
        "trace_id", "ts_ns", "seq", "pid", "session", F.col("server").alias("server_key"), "label", "layer"
    )
    numbered = ordinal(opened, ["trace_id"], ["ts_ns", "seq"], "n")
    rows = numbered.select(
        "trace_id",
        F.concat(F.lit("mcp_"), F.col("n") - 1, F.lit("_"), F.col("label")).alias("mcp_id"),
        "server_key",
        F.col("session").alias("session_id"),
        F.col("pid").alias("anchor_pid"),
        F.col("label").alias("name"),
        F.col("ts_ns").alias("t_start_ns"),
        "seq",
        "layer",
    )
    if sent is None:
        if events is None:
            return rows
        sent = sends(events, states)
    frames = sent.filter(rpc.is_request(F.col("text")))
    last = frames.groupBy("trace_id", F.col("session").alias("session_id")).agg(F.max("ts_ns").alias("__frame"))
    by_frame = F.col("__frame") >= F.col("t_start_ns")
    return rows.join(last, ["trace_id", "session_id"], "left").withColumn(
        "promoted_by",
        F.when(F.col("layer") == "registered", "registered").when(by_frame, "structural").otherwise("name"),
    ).drop("__frame")


def attribute(events: DataFrame, states: DataFrame) -> DataFrame:
    """Each event with the session and server of its pid at that moment (as-of join)."""
    now = states.select("trace_id", "pid", "ts_ns", "seq", "step", "session", "server")
    now = first_rows(
        now, ["trace_id", "pid", "ts_ns", "seq"], [F.col("step").desc()]
    ).select("trace_id", "pid", F.col("ts_ns").alias("at"), F.col("seq").alias("at_seq"), "session", "server")
    return asof(
        events, now, ["trace_id", "pid"], "ts_ns", "at", ["session", "server"], ties=["seq"], right_ties=["at_seq"]
    )


def memberships(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First moment of every (pid, session) and every (pid, server)."""
    of_session = states.filter("session IS NOT NULL").groupBy("trace_id", "pid", F.col("session").alias("session_id")).agg(
        F.min("ts_ns").alias("bound_at_ts_ns")
    )
    of_server = states.filter("server IS NOT NULL").groupBy("trace_id", "pid", F.col("server").alias("server_key")).agg(
        F.min("ts_ns").alias("bound_at_ts_ns")
    )
    return of_session, of_server


def sends(events: DataFrame, states: DataFrame) -> DataFrame:
    """The frames sent, as ``text``, with the session and server of their sender."""
    sent = events.filter("event = 'sendto' AND buf IS NOT NULL").select("trace_id", "ts_ns", "seq", "pid", "buf")
    sent = settle(sent.withColumn("text", rpc.frame(F.col("buf"))).drop("buf"))
    return settle(attribute(sent, states))


def tool_calls(events: DataFrame, states: DataFrame, server_rows: DataFrame, *, loose_reply: bool = False, sent: DataFrame | None = None) -> DataFrame:
    """Calls opened by tools/call frames and closed by the server's next reply.

    The receiving server is the one opened last in the sender's session.  A call whose
    server receives the next request before replying is never closed (t_close_ns -1).
    ``sent`` are the events' ``sends``, where they were made already.
    """
    sent = sends(events, states) if sent is None else sent
    requests = sent.withColumn("name", rpc.call_name(F.col("text"))).filter("session IS NOT NULL AND name IS NOT NULL")
    opened = server_rows.select(
        "trace_id", F.col("session_id").alias("session"), "t_start_ns", F.col("seq").alias("open_seq"),
        "mcp_id", "server_key", "anchor_pid",
    )
    requests = asof(
        requests, opened, ["trace_id", "session"], "ts_ns", "t_start_ns", ["mcp_id", "server_key", "anchor_pid"],
        ties=["seq"], right_ties=["open_seq"],
    ).filter("mcp_id IS NOT NULL")
    requests = settle(requests.withColumn("use_id", rpc.call_use_id(F.col("text"))).drop("text"))
    calls = settle(ordinal(requests, ["trace_id"], ["ts_ns", "seq"], "n"))
    plain = F.when(F.length("use_id") > 0, F.col("use_id")).otherwise(F.concat(F.lit("tc_"), F.col("n") - 1))
    calls = ordinal(calls.withColumn("plain", plain), ["trace_id", "plain"], ["ts_ns", "seq"], "again")
    calls = settle(calls.withColumn(
        "tool_call_id",
        F.when(F.col("again") > 1, F.concat("plain", F.lit("__"), "n")).otherwise(F.col("plain")),
    ))
    replies = sent.filter(rpc.is_reply(F.col("text"), loose=loose_reply) & F.col("server").isNotNull())
    marks = calls.select(
        "trace_id", F.col("anchor_pid").alias("pid"), "ts_ns", "seq", F.lit(False).alias("reply"), "tool_call_id"
    ).unionByName(
        replies.select("trace_id", "pid", "ts_ns", "seq", F.lit(True).alias("reply")), allowMissingColumns=True
    )
    # A loose reply may be the request itself, which then closes its own call.
    nxt = scan_next(marks, ["trace_id", "pid"], ["ts_ns", "seq", "reply"], F.struct("reply", "ts_ns"), "after")
    closes = nxt.filter("NOT reply").select(
        "trace_id", "tool_call_id",
        F.when(F.col("after.reply"), F.col("after.ts_ns")).otherwise(-1).alias("t_close_ns"),
    )
    return calls.join(closes, ["trace_id", "tool_call_id"]).select(
        "trace_id", "tool_call_id", F.lit("").alias("iteration_id"), "mcp_id", "server_key",
        F.col("session").alias("session_id"), "name", F.lit(False).alias("is_builtin"),
        F.lit("precise").alias("kernel_timing"), F.col("ts_ns").alias("t_open_ns"), "t_close_ns",
        F.lit(False).alias("is_error"),
    )


def attribute_calls(attributed: DataFrame, calls: DataFrame) -> DataFrame:
    """Add ``tool_call``: an open call of the event's server, else a built-in call of its
    session.  Inside a tier the earliest-opened call wins."""
    by_server = calls.filter("NOT is_builtin AND server_key IS NOT NULL").select(
        "trace_id", F.col("server_key").alias("server"), "t_open_ns", "t_close_ns", F.col("tool_call_id").alias("c1")
    )
    by_session = calls.filter("is_builtin").select(
        "trace_id", F.col("session_id").alias("session"), "t_open_ns", "t_close_ns", F.col("tool_call_id").alias("c2")
    )
    served = attributed.filter("server IS NOT NULL")
    rest = attributed.filter("server IS NULL")
    rows = in_window(served, by_server, ["trace_id", "server"], "ts_ns", "t_open_ns", "t_close_ns", "c1").unionByName(
        rest, allowMissingColumns=True
    )
    rows = settle(rows)
    inside, outside = rows.filter("session IS NOT NULL"), rows.filter("session IS NULL")
    rows = in_window(inside, by_session, ["trace_id", "session"], "ts_ns", "t_open_ns", "t_close_ns", "c2").unionByName(
        outside, allowMissingColumns=True
    )
    return rows.withColumn("tool_call", F.coalesce("c1", "c2")).drop("c1", "c2")


def predictions(events: DataFrame, *, detector: str = "strict", loose_reply: bool = True, **options) -> DataFrame:
    """(trace_id, seq, session, mcp, tool_call) per event; '' where unattributed."""
    states = bind(events, detector=detector, **options)
    server_rows = settle(servers(states))
    calls = settle(tool_calls(events, states, server_rows, loose_reply=loose_reply))
    slim = events.select("trace_id", "seq", "ts_ns", "pid")
    rows = attribute_calls(settle(attribute(slim, states)), calls)
    rows = rows.join(server_rows.select("trace_id", F.col("server_key").alias("server"), "mcp_id"), ["trace_id", "server"], "left")
    return rows.select(
        "trace_id", "seq", "ts_ns", "pid",
        F.coalesce("session", F.lit("")).alias("session"),
        F.coalesce("mcp_id", F.lit("")).alias("mcp"),
        F.coalesce("tool_call", F.lit("")).alias("tool_call"),
    )


def partition_by_agent(events: DataFrame) -> DataFrame:
    """Session per event by the agent-root rule: a pid's first label sticks.

    Without a time limit, an unlabelled pid takes the label of the latest clone's caller
    (including its own clone) at its first event, or 'preroot'; a later root execve of
    the pid opens a new session.
    """
    e = events.select("trace_id", "ts_ns", "seq", "pid", "event", "path", "argv", "cgroup_id")
    root = detect.session_root(F.col("event"), F.col("path"), F.col("argv"), switches=("-p",))
    roots = ordinal(e.filter(root), ["trace_id"], ["ts_ns", "seq"], "n").select(
        "trace_id", "pid", "ts_ns", "seq", F.concat(F.lit("session_"), F.col("n") - 1).alias("label")
    )
    first = first_rows(with_last_clone(e), ["trace_id", "pid"], [F.col("ts_ns"), F.col("seq")])
    first = settle(first.withColumn("is_root", root).select(
        "trace_id", "pid", "ts_ns", "seq", "is_root",
        F.when(F.col("event").isin("clone", "clone3"), F.col("pid")).otherwise(F.col("clone.pid")).alias("caller"),
    ))
    roots = settle(roots)
    # A pid's label history is its first sighting (inherited) and its own roots.  A sighting points
    # at its caller's latest point before it, and takes the label of the root that its chain ends in.
    inherited = first.filter("NOT is_root")
    points = inherited.select("trace_id", "pid", "ts_ns", "seq").unionByName(roots.select("trace_id", "pid", "ts_ns", "seq"))
    known = points.select("trace_id", F.col("pid").alias("caller"), F.col("ts_ns").alias("at"), F.col("seq").alias("up"))
    asked = asof(
        inherited.filter("caller IS NOT NULL AND caller <> pid"), known, ["trace_id", "caller"], "ts_ns", "at",
        ["up"], ties=["seq"], right_ties=["up"], same_instant=False,
    )
    edges = settle(asked.filter("up IS NOT NULL").select("trace_id", F.col("seq").alias("child"), F.col("up").alias("parent")))
    chains = nearest_marked(edges, roots.select("trace_id", F.col("seq").alias("node")))
    by_root = roots.select("trace_id", F.col("seq").alias("found"), "label")
    took = chains.join(by_root, ["trace_id", "found"]).select("trace_id", F.col("node").alias("seq"), "label")
    labels = settle(roots.unionByName(
        inherited.select("trace_id", "pid", "ts_ns", "seq").join(took, ["trace_id", "seq"], "left")
        .select("trace_id", "pid", "ts_ns", "seq", F.coalesce("label", F.lit("preroot")).alias("label"))
    ))
    at = labels.select("trace_id", "pid", F.col("ts_ns").alias("at"), F.col("seq").alias("at_seq"), F.col("label").alias("session"))
    return asof(
        events.select("trace_id", "seq", "ts_ns", "pid"), at, ["trace_id", "pid"], "ts_ns", "at", ["session"],
        ties=["seq"], right_ties=["at_seq"],
    )


def partition_by_cgroup(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "session", F.concat(F.lit("cgroup_"), F.coalesce(F.col("cgroup_id").cast("string"), F.lit("none")))
    )
