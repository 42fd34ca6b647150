"""The named questions over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.operators.segments import scan_sums
from vestige.operators.timejoin import in_window
from vestige.plans.graph_tables import all_edges
from vestige.session import settle

Tables = dict[str, DataFrame]


def session_overview(t: Tables) -> DataFrame:
    """Servers and member processes per session."""
    n_mcps = t["has_mcp"].groupBy("trace_id", "session_id").agg(F.count(F.lit(1)).alias("n_mcps"))
    n_desc = t["member_of_session"].groupBy("trace_id", "session_id").agg(F.count(F.lit(1)).alias("n_descendants"))
    zero = F.lit(0).cast("bigint")
    on = ["trace_id", "session_id"]
    return t["Session"].join(n_mcps, on, "left").join(n_desc, on, "left").select(
        "trace_id", F.col("session_id").alias("session"), "anchor_pid", "t_start_ns",
        F.coalesce("n_mcps", zero).alias("n_mcps"), F.coalesce("n_descendants", zero).alias("n_descendants"),
    )


def session_subgraph(t: Tables, trace_id: str, session: str, limit: int | None = None) -> DataFrame:
    """Tidy edge list around one session: (relation, source, target); the first ``limit`` rows on request."""
    here = (F.col("trace_id") == trace_id) & (F.col("session_id") == session)
    servers = t["has_mcp"].filter(here)
    members = t["member_of_session"].filter(here)
    calls = t["has_tool_call"].filter(F.col("trace_id") == trace_id).join(servers.select("mcp_id"), "mcp_id", "left_semi")
    pids = members.select("pid").distinct()
    parts = [
        servers.select(F.lit("has_mcp").alias("relation"), F.col("session_id").alias("source"), F.col("mcp_id").alias("target")),
        calls.select(F.lit("has_tool_call").alias("relation"), F.col("mcp_id").alias("source"), F.col("tool_call_id").alias("target")),
        members.select(F.lit("member_of_session").alias("relation"), F.col("pid").cast("string").alias("source"), F.col("session_id").alias("target")),
    ]
    for op in ("read", "write"):
        touched = t[op].filter(F.col("trace_id") == trace_id).join(pids, "pid", "left_semi")
        parts.append(touched.select(F.lit(op).alias("relation"), F.col("pid").cast("string").alias("source"), F.col("path").alias("target")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if limit is None else out.orderBy("relation", "source", "target").limit(limit)


def touch_set(t: Tables) -> DataFrame:
    """What each server's processes touched: mcp, kind, target, n_ops.

    Edges are counted per (pid, target) before they meet the membership rows.
    """
    edges = all_edges(t).groupBy("trace_id", "pid", "kind", "target").agg(F.count(F.lit(1)).alias("n"))
    member = t["member_of_mcp"].select("trace_id", "pid", "mcp_id").distinct()
    name = t["MCP"].select("trace_id", "mcp_id", F.col("name").alias("mcp"))
    return (
        edges.join(member, ["trace_id", "pid"])
        .join(name, ["trace_id", "mcp_id"])
        .groupBy("mcp", "kind", "target")
        .agg(F.sum("n").alias("n_ops"))
    )


def credential_trace(reads: DataFrame, later: DataFrame, pattern: str, by: tuple[str, ...] = ("trace_id", "pid")) -> DataFrame:
    """Writes and connects of a process after its first read of a credential path.

    ``later`` has (by.., ts_ns, op, target).  Only the first matching read per process
    matters for 'later than a credential read', so no read is paired with every write.
    """
    by = list(by)
    first = reads.filter(F.col("path").rlike(pattern)).groupBy(*by).agg(
        F.min(F.struct("ts_ns", "path")).alias("r")
    ).select(*by, F.col("r.ts_ns").alias("read_ns"), F.col("r.path").alias("credential"))
    return later.join(first, by).filter("ts_ns > read_ns")


def credential_forward(t: Tables, pattern: str = r"credentials|id_rsa|\.aws|\.ssh|\.netrc") -> DataFrame:
    later = all_edges(t).filter(F.col("op").isin("write", "connect"))
    out = credential_trace(t["read"], later, pattern)
    member = t["member_of_mcp"].select("trace_id", "pid", "mcp_id").distinct()
    return out.join(member, ["trace_id", "pid"], "left")


def call_activity(t: Tables) -> DataFrame:
    """Per call: duration, file and socket operations of its server's processes inside
    its window.  File and socket counts are separate totals of one scan."""
    from vestige.operators.callwindows import window_activity

    member = t["member_of_mcp"].select("trace_id", "pid", "mcp_id").distinct()
    # Landed: the running totals count their groups before they read them.
    edges = settle(all_edges(t).filter("op <> 'unlink' AND op <> 'bind'").join(member, ["trace_id", "pid"]).select("trace_id", "mcp_id", "kind", "ts_ns"))
    calls = t["ToolCall"].withColumn("hi", F.when(F.col("t_close_ns") < 0, F.lit(1 << 62)).otherwise(F.col("t_close_ns")))
    shown = calls.withColumn("shut", F.col("t_close_ns")).withColumn("t_close_ns", F.col("hi"))
    out = window_activity(
        edges, shown, ["trace_id", "mcp_id"],
        {"n_file_ops": F.col("kind") == "file", "n_socket_ops": F.col("kind") == "socket"},
    )
    return out.select(
        "trace_id", F.col("tool_call_id").alias("tool_call"), F.col("name").alias("tool_name"), "mcp_id",
        F.floor((F.col("shut") - F.col("t_open_ns")) / 1_000_000).alias("dur_ms"),
        F.coalesce("n_file_ops", F.lit(0)).alias("n_file_ops"), F.coalesce("n_socket_ops", F.lit(0)).alias("n_socket_ops"),
    )


def orphan_processes(t: Tables) -> DataFrame:
    return t["Process"].join(t["member_of_session"], ["trace_id", "pid"], "left_anti").select(
        "trace_id", "pid", F.col("first_comm").alias("comm"), F.col("first_argv").alias("argv"), "t_first_seen_ns"
    )


def bindings(t: Tables) -> DataFrame:
    s = t["member_of_session"].select("trace_id", "pid", F.lit("session").alias("level"), F.col("session_id").alias("id"), "bound_at_ts_ns")
    m = t["member_of_mcp"].select("trace_id", "pid", F.lit("mcp").alias("level"), F.col("mcp_id").alias("id"), "bound_at_ts_ns")
    return s.unionByName(m)


def call_list(t: Tables) -> DataFrame:
    """All calls with their server and session where known (kernel calls included)."""
    calls = t["ToolCall"].select("trace_id", "tool_call_id", "is_builtin", "t_open_ns", "t_close_ns", "iteration_id")
    via_mcp = t["has_tool_call"].join(t["has_mcp"], ["trace_id", "mcp_id"]).select(
        "trace_id", "tool_call_id", "mcp_id", F.col("session_id").alias("s1")
    )
    out = calls.join(via_mcp, ["trace_id", "tool_call_id"], "left")
    if "has_iteration" in t:
        it = t["has_iteration"].select("trace_id", "iteration_id", F.col("session_id").alias("s2"))
        out = out.join(it, ["trace_id", "iteration_id"], "left")
        return out.withColumn("session_id", F.coalesce("s1", "s2")).drop("s1", "s2")
    return out.withColumnRenamed("s1", "session_id")


def iteration_transcript(iterations: DataFrame, prompts: DataFrame, responses: DataFrame, calls: DataFrame, by: list[str]) -> DataFrame:
    key = [*by, "iteration_id"]
    n = calls.groupBy(*key).agg(F.count_distinct("tool_call_id").alias("n_calls"))
    return (
        iterations.join(prompts.select(*key, F.col("text").alias("prompt")), key, "left")
        .join(responses.select(*key, F.col("text").alias("response")), key, "left")
        .join(n, key, "left")
        .select(*key, "ordinal", "prompt", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "response", "outcome")
    )


def intent_and_read(t: Tables, prompt_pattern: str, path_pattern: str) -> DataFrame:
    """Sessions whose prompt fits one pattern and whose server read a path of another."""
    asked = t["Prompt"].filter(F.col("text").rlike(prompt_pattern)).join(t["has_iteration"], ["trace_id", "iteration_id"]).select("trace_id", "session_id").distinct()
    server_pids = t["member_of_mcp"].join(t["has_mcp"], ["trace_id", "mcp_id"]).join(asked, ["trace_id", "session_id"])
    reads = t["read"].filter(F.col("path").rlike(path_pattern)).groupBy("trace_id", "pid", "path").agg(F.count(F.lit(1)).alias("n"))
    return server_pids.join(reads, ["trace_id", "pid"]).select("trace_id", "session_id", "mcp_id", "pid", "path", "n").distinct()


def precise_calls(t: Tables) -> DataFrame:
    return t["ToolCall"].filter("kernel_timing = 'precise'")


def network_calls(t: Tables) -> DataFrame:
    """Calls during which one of the server's processes used a socket."""
    return call_activity(t).filter("n_socket_ops > 0").select("trace_id", "tool_call", "tool_name", "mcp_id")


def occupancy(server_events: DataFrame, windows: DataFrame, by: list[str], ident: str) -> DataFrame:
    """Share of a server's events that fall inside any of its windows."""
    hit = in_window(server_events, windows, by, "ts_ns", "lo", "hi", ident)
    n, inside = F.count(F.lit(1)), F.count_if(F.col(ident).isNotNull())
    return hit.groupBy(*by).agg(n.alias("n"), inside.alias("inside"), F.try_divide(inside.cast("double"), n).alias("share"))


def running_activity(edges: DataFrame, by: list[str], measures) -> DataFrame:
    return scan_sums(edges, by, ["ts_ns", "seq"], measures)
