"""Node and edge tables of the provenance graph, one projection per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.functions import naming, paths
from vestige.operators import binding
from vestige.operators.detect import session_root
from vestige.operators.graph import first_sightings, fork_edges, keep_first_edge
from vestige.operators.segments import first_rows, ordinal
from vestige.session import settle

NODES = ("Session", "Iteration", "Prompt", "Response", "Tool", "MCP", "ToolCall", "Process", "File", "Socket")
FILE_EDGES = ("read", "write", "unlink")
SOCKET_EDGES = ("connect", "bind", "send", "recv")
# Event name of each socket edge.
_SOCKET_EVENT = {"connect": "connect", "bind": "bind", "send": "sendto", "recv": "recvfrom"}


def joined(argv):
    return F.array_join(F.coalesce(argv, F.array().cast("array<string>")), " ")


def file_edges(events: DataFrame) -> DataFrame:
    """op read / write / unlink, process to path."""
    opened = F.col("event").isin("openat", "open")
    unlinked = F.col("event").isin("unlinkat", "unlink")
    rows = events.filter((opened | unlinked) & (F.length("path") > 0))
    return rows.select(
        "trace_id", "pid", "path", "ts_ns", "seq",
        F.when(unlinked, "unlink").otherwise(paths.edge_by_accmode(F.col("flags"))).alias("op"),
        F.lit(-1).alias("fd"),
        F.coalesce("flags", F.lit(0)).alias("flags"),
    )


def socket_edges(events: DataFrame, *, fd_zero_is_missing: bool = False) -> DataFrame:
    """op connect / bind / send / recv over internet sockets with an address."""
    names = F.create_map(*[F.lit(x) for op, ev in _SOCKET_EVENT.items() for x in (ev, op)])
    rows = events.filter(
        F.col("event").isin(*_SOCKET_EVENT.values()) & F.col("family").isin(2, 10) & (F.length("daddr") > 0)
    )
    return rows.select(
        "trace_id", "pid", "ts_ns", "seq",
        naming.socket_key(F.col("family"), F.col("daddr"), F.col("dport")).alias("sock_key"),
        F.element_at(names, F.col("event")).alias("op"),
        naming.fd_or_missing(F.col("fd"), zero_is_missing=fd_zero_is_missing).alias("fd"),
        F.coalesce("len", F.lit(0).cast("bigint")).alias("len"),
        F.col("family").cast("tinyint").alias("family"), "daddr", F.coalesce("dport", F.lit(0)).alias("dport"),
    )


def session_rows(events: DataFrame) -> DataFrame:
    execs = events.filter(session_root(F.col("event"), F.col("path"), F.col("argv")))
    n = ordinal(execs.select("trace_id", "ts_ns", "seq", "pid", "argv"), ["trace_id"], ["ts_ns", "seq"], "n")
    return n.select(
        "trace_id", F.concat(F.lit("sess_"), F.col("n") - 1).alias("session_id"),
        F.col("pid").alias("anchor_pid"), F.col("ts_ns").alias("t_start_ns"), joined(F.col("argv")).alias("argv"),
        F.lit("").alias("terminator_status"), F.lit("").alias("terminator_reason"),
    )


def process_rows(events: DataFrame) -> DataFrame:
    """First sighting per pid; a child is first seen at its fork; roots show their own argv."""
    forks = events.filter("event = 'sched_fork' AND parent_pid <> 0 AND child_pid <> 0 AND parent_pid <> child_pid")
    none = F.lit(None).cast("array<string>")
    # Within one event its own pid is seen before the fork's two ends.
    seen = events.filter("event <> 'sched_fork' OR pid IS NOT NULL").select(
        "trace_id", "pid", "ts_ns", "seq", F.lit(0).alias("part"), "comm",
        F.when(F.col("event") == "execve", F.col("argv")).alias("argv"),
    )
    ends = forks.select(
        "trace_id", F.explode(F.array("parent_pid", "child_pid")).alias("pid"), "ts_ns", "seq",
        F.lit(1).alias("part"), F.col("parent_comm").alias("comm"), none.alias("argv"),
    )
    first = first_rows(seen.unionByName(ends), ["trace_id", "pid"], [F.col("ts_ns"), F.col("seq"), F.col("part")])
    roots = events.filter(session_root(F.col("event"), F.col("path"), F.col("argv"))).groupBy("trace_id", "pid").agg(
        F.max_by("argv", F.struct("ts_ns", "seq")).alias("root_argv")
    )
    return first.join(roots, ["trace_id", "pid"], "left").select(
        "trace_id", "pid", F.coalesce("comm", F.lit("")).alias("first_comm"),
        joined(F.coalesce("root_argv", "argv")).alias("first_argv"), F.col("ts_ns").alias("t_first_seen_ns"),
    )


def build(events: DataFrame, *, detector: str = "layered", registry: bool = True) -> dict[str, DataFrame]:
    """All kernel-side tables of a canonical event table."""
    states = binding.bind(events, detector=detector, registry=registry)
    sent = binding.sends(events, states)
    server_rows = settle(binding.servers(states, sent=sent))
    calls = settle(binding.tool_calls(events, states, server_rows, sent=sent))
    of_session, of_server = binding.memberships(states)
    files, sockets = file_edges(events), socket_edges(events)
    inherited = states.filter("kind = 'clone'").select(
        "trace_id", F.col("pid").alias("child"), "parent", F.col("clone_ts").alias("ts_ns"), "seq", F.lit("clone_window").alias("via")
    )
    child_of = keep_first_edge(fork_edges(events).withColumn("via", F.lit("sched_fork")).unionByName(inherited))
    names = server_rows.select("trace_id", "server_key", "mcp_id")
    opened_argv = events.filter("event = 'execve'").select("trace_id", "seq", joined(F.col("argv")).alias("argv"))
    tables = {
        "Session": session_rows(events),
        "MCP": server_rows.join(opened_argv, ["trace_id", "seq"], "left").select(
            "trace_id", "mcp_id", "session_id", "anchor_pid", "name", "argv", "t_start_ns", "layer", "promoted_by"
        ),
        "ToolCall": calls.drop("server_key", "session_id"),
        "Process": process_rows(events),
        "File": files.select("trace_id", "path").distinct(),
        "Socket": sockets.select("trace_id", "sock_key", "family", "daddr", "dport").distinct(),
        "child_of": child_of.select("trace_id", F.col("child").alias("child_pid"), F.col("parent").alias("parent_pid"), "ts_ns", "via"),
        "member_of_session": of_session,
        "member_of_mcp": of_server.join(names, ["trace_id", "server_key"]).drop("server_key"),
        "has_mcp": server_rows.select("trace_id", "session_id", "mcp_id"),
        "has_tool_call": calls.select("trace_id", "mcp_id", "tool_call_id"),
    }
    for op in FILE_EDGES:
        cols = ["trace_id", "pid", "path", "ts_ns"] + ([] if op == "unlink" else ["fd", "flags"])
        tables[op] = files.filter(F.col("op") == op).select(*cols)
    for op in SOCKET_EDGES:
        cols = ["trace_id", "pid", "sock_key", "ts_ns", "fd"] + (["len"] if op in ("send", "recv") else [])
        tables[op] = sockets.filter(F.col("op") == op).select(*cols)
    return tables


def all_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """trace_id, pid, kind, op, target, ts_ns over all file and socket edges."""
    out = None
    for op in (*FILE_EDGES, *SOCKET_EDGES):
        kind, key = ("file", "path") if op in FILE_EDGES else ("socket", "sock_key")
        part = tables[op].select("trace_id", "pid", F.lit(kind).alias("kind"), F.lit(op).alias("op"), F.col(key).alias("target"), "ts_ns")
        out = part if out is None else out.unionByName(part)
    return out
