"""Labelled merges of several captures into one stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.operators import detect
from vestige.operators.graph import descendants, label_parents
from vestige.operators.subtree import noise_pids
from vestige.operators.timejoin import in_window
from vestige.session import settle

# Fixed value: the control group all merged events share.
SHARED_CGROUP = 999_999


def source_members(events: DataFrame, *, registry: bool = True) -> tuple[DataFrame, DataFrame]:
    """(trace_id, pid) of the agent subtree and of the server subtrees of each capture."""
    parents = settle(label_parents(events))
    ex = events.filter("event = 'execve'").select("trace_id", "ts_ns", "seq", "pid", "event", "path", "argv")
    argv = F.col("argv")
    marked = F.arrays_overlap(argv, F.array(*[F.lit(s) for s in detect.SESSION_SWITCHES]))
    agent = F.substring_index(detect.arg(argv, 0), "/", -1) == detect.AGENT
    roots = ex.filter((F.size(argv) > 0) & agent & marked).select("trace_id", F.col("pid").alias("node"))
    servers = detect.layered_servers(ex, registry=registry).filter("server_label IS NOT NULL").select("trace_id", F.col("pid").alias("node"))
    of = lambda r: descendants(parents, r).select("trace_id", F.col("node").alias("pid"))
    return of(roots), of(servers)


def label(events: DataFrame, meta: DataFrame, windows: DataFrame, *, registry: bool = True, scope: str = "server") -> DataFrame:
    """Events with truth columns src_session, src_mcp, src_tool_call ('' = none).

    ``meta`` (trace_id, session_id, mcp); ``windows`` (trace_id, use_id, lo, hi[, mcp_id]).
    ``server``: any window labels server pids.  ``hooks``: a server window labels server
    pids, a built-in window labels every pid of the session.
    """
    in_session, in_server = source_members(events, registry=registry)
    on = ["trace_id", "pid"]
    e = (
        events.join(in_session.withColumn("__s", F.lit(True)), on, "left")
        .join(in_server.withColumn("__m", F.lit(True)), on, "left")
        .join(meta.select("trace_id", F.col("session_id").alias("__sid"), F.col("mcp").alias("__mcp")), "trace_id", "left")
    )
    e = settle(e)
    s, m = F.coalesce("__s", F.lit(False)), F.coalesce("__m", F.lit(False))
    if scope == "server":
        hit, rest = e.filter(m), e.filter(~m)
        hit = in_window(hit, windows.select("trace_id", "use_id", "lo", "hi"), ["trace_id"], "ts_ns", "lo", "hi", "use_id")
        e = hit.unionByName(rest, allowMissingColumns=True)
    else:
        # Server pids may be labelled by every window, other session pids by built-ins only.
        w = windows.select("trace_id", "use_id", "lo", "hi", F.coalesce("mcp_id", F.lit("")).alias("mcp_id"))
        cols = ("trace_id", "use_id", "lo", "hi")
        a = in_window(e.filter(s & m), w.select(*cols), ["trace_id"], "ts_ns", "lo", "hi", "use_id")
        b = in_window(e.filter(s & ~m), w.filter("mcp_id = ''").select(*cols), ["trace_id"], "ts_ns", "lo", "hi", "use_id")
        e = a.unionByName(b).unionByName(e.filter(~s), allowMissingColumns=True)
    none = F.lit("")
    return e.select(
        *events.columns,
        F.when(s, F.col("__sid")).otherwise(none).alias("src_session"),
        F.when(m, F.coalesce("__mcp", none)).otherwise(none).alias("src_mcp"),
        F.coalesce("use_id", none).alias("src_tool_call"),
    )


def merge(labelled: DataFrame, trial: DataFrame) -> DataFrame:
    """The labelled events of each trial's captures as one trace with one control group.

    ``trial`` (trial, trace_id).  The order inside a merged trace is (ts_ns, capture, seq).
    """
    rows = labelled.join(trial, "trace_id")
    return rows.withColumn("src_trace", F.col("trace_id")).withColumn(
        "trace_id", F.concat(F.lit("trial_"), F.col("trial"))
    ).withColumn("cgroup_id", F.lit(SHARED_CGROUP).cast("bigint"))


def rebase(events: DataFrame, windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Shift every capture (and its windows) so that its first positive time is 0;
    captures without one are left out."""
    start = events.filter("ts_ns > 0").groupBy("trace_id").agg(F.min("ts_ns").alias("__t0"))
    moved = events.join(start, "trace_id").withColumn("ts_ns", F.col("ts_ns") - F.col("__t0")).drop("__t0")
    if windows is None:
        return moved, None
    w = windows.join(start, "trace_id")
    return moved, w.withColumn("lo", F.col("lo") - F.col("__t0")).withColumn("hi", F.col("hi") - F.col("__t0")).drop("__t0")


def without_noise(labelled: DataFrame) -> DataFrame:
    return labelled.join(noise_pids(labelled, ["trace_id"]), ["trace_id", "pid"], "left_anti")


def stress_concat(events: DataFrame, name: str = "stress") -> DataFrame:
    """Several captures as one trace in one control group, labelled by capture."""
    return events.withColumn("src_session", F.col("trace_id")).withColumn("trace_id", F.lit(name)).withColumn(
        "cgroup_id", F.lit(SHARED_CGROUP).cast("bigint")
    )
