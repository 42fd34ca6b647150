"""Prompts, responses, tools and tool calls from transcripts or hooks, and their merge
with the kernel-side calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.functions import naming
from vestige.operators import callwindows
from vestige.operators.segments import first_rows, scan_last
from vestige.session import settle



def _iter_id(prefix: str):
    return F.concat(F.lit(f"{prefix}/"), F.col("session_id"), F.lit("/0"))


def _outcome(sessions: DataFrame, transcript: DataFrame, hooks: DataFrame | None) -> DataFrame:
    """Terminator and outcome per session from the first result record (or a Stop hook)."""
    result = transcript.filter("type = 'result'").groupBy("session_id").agg(
        F.min_by(F.struct("terminal_reason", "stop_reason", "is_error", "result"), "seq").alias("r")
    )
    s = sessions.join(result, "session_id", "left")
    missing = F.col("r").isNull()
    if hooks is None:
        stopped, crash = F.lit(False), "no result record"
    else:
        stops = hooks.filter("hook = 'Stop'").select("session_id", F.lit(True).alias("__stop")).distinct()
        s = s.join(stops, "session_id", "left")
        stopped, crash = F.coalesce("__stop", F.lit(False)), "no result record / no Stop hook"
    terminal, stop = F.nullif(F.col("r.terminal_reason"), F.lit("")), F.nullif(F.col("r.stop_reason"), F.lit(""))
    said = F.length(F.coalesce("r.result", F.lit(""))) > 0
    return s.select(
        "session_id", "prompt", "t_start_ns", "t_end_ns",
        F.when(missing & stopped, "clean").when(missing, "crash")
        .when(F.coalesce("r.is_error", F.lit(False)), "error")
        .when(terminal == "completed", "clean")
        .otherwise(F.coalesce(terminal, F.lit("unknown"))).alias("terminator_status"),
        F.when(missing & stopped, "").when(missing, crash).otherwise(F.coalesce(stop, terminal, F.lit(""))).alias("terminator_reason"),
        F.when(missing & stopped, "silent").when(missing, "terminated").when(said, "responded").otherwise("silent").alias("outcome"),
        F.when(~missing & said, F.col("r.result")).alias("response_text"),
    )


def _conversation(frame: DataFrame) -> dict[str, DataFrame]:
    it, pr, rs = _iter_id("iter"), _iter_id("prompt"), _iter_id("resp")
    return {
        "Session": frame.select("session_id", "terminator_status", "terminator_reason"),
        "Iteration": frame.select(
            it.alias("iteration_id"), "session_id", F.lit(0).alias("ordinal"), "t_start_ns", "t_end_ns", "outcome"
        ),
        "Prompt": frame.select(
            pr.alias("prompt_id"), it.alias("iteration_id"), "session_id",
            F.coalesce("prompt", F.lit("")).alias("text"), F.col("t_start_ns").alias("ts_ns"),
        ),
        "Response": frame.filter("response_text IS NOT NULL").select(
            rs.alias("response_id"), it.alias("iteration_id"), "session_id",
            F.col("response_text").alias("text"), F.col("t_end_ns").alias("ts_ns"),
        ),
    }


def advertised_tools(transcript: DataFrame, *, server_only: bool = False) -> DataFrame:
    """Tool names of each session's first init record."""
    init = transcript.filter("type = 'system' AND subtype = 'init'").groupBy("session_id").agg(F.min_by("tools", "seq").alias("tools"))
    names = init.select("session_id", F.explode("tools").alias("name")).distinct()
    return names.filter(~naming.builtin_tool(F.col("name"))) if server_only else names


def _tool_rows(names: DataFrame) -> DataFrame:
    n = F.col("name")
    return names.select(
        "session_id", F.concat_ws("/", "session_id", n).alias("tool_key"), n.alias("name"),
        naming.builtin_tool(n).alias("is_builtin"), naming.server_id(F.col("session_id"), n).alias("mcp_id"),
        F.lit("").alias("description"),
    )


def _finish(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Calls without an end close with the session and count as errors."""
    c = calls.join(sessions.select("session_id", "t_start_ns", "t_end_ns"), "session_id")
    open_ = F.col("close_ns").isNull()
    n = F.col("name")
    return c.select(
        "session_id", F.col("use_id").alias("tool_call_id"), _iter_id("iter").alias("iteration_id"),
        naming.server_id(F.col("session_id"), n).alias("mcp_id"), n.alias("name"), naming.builtin_tool(n).alias("is_builtin"),
        "kernel_timing", F.coalesce("open_ns", "t_start_ns").alias("t_open_ns"),
        F.when(open_, F.col("t_end_ns")).otherwise(F.col("close_ns")).alias("t_close_ns"),
        (open_ | F.coalesce("is_error", F.lit(False))).alias("is_error"),
        F.coalesce("parent_tool_use_id", F.lit("")).alias("parent_tool_use_id"),
    )


def from_transcript(sessions: DataFrame, transcript: DataFrame) -> dict[str, DataFrame]:
    """Agent tables of sessions (session_id, prompt, t_start_ns, t_end_ns) from their
    transcript records (session_id, seq, ...)."""
    content = settle(callwindows.content_rows(transcript, ["session_id"]))
    # Every record with content and a time moves the clock for itself and what follows.
    clocked = scan_last(
        content, ["session_id"], ["rec", "pos"], F.col("rec_ns"), "now_ns", inclusive=True
    )
    clocked = settle(clocked)
    uses = clocked.filter("kind = 'tool_use' AND rec_type = 'assistant'")
    # A repeated use id restarts the call.
    uses = first_rows(uses, ["session_id", "use_id"], [F.col("rec").desc(), F.col("pos").desc()])
    ends = clocked.filter("kind = 'tool_result' AND rec_type = 'user'").select(
        "session_id", F.col("result_of").alias("use_id"), F.col("rec").alias("end_rec"), F.col("pos").alias("end_pos"),
        F.col("now_ns").alias("close_ns"), F.col("is_error").alias("end_error"),
    )
    after = F.struct("end_rec", "end_pos") > F.struct("rec", "pos")
    closed = uses.join(ends, ["session_id", "use_id"]).filter(after)
    closed = first_rows(closed, ["session_id", "use_id"], [F.col("end_rec").desc(), F.col("end_pos").desc()]).select(
        "session_id", "use_id", "close_ns", "end_error", F.lit(True).alias("closed")
    )
    starts = sessions.select("session_id", "t_start_ns")
    calls = uses.join(closed, ["session_id", "use_id"], "left").join(starts, "session_id").select(
        "session_id", "use_id", "name", F.coalesce("now_ns", "t_start_ns").alias("open_ns"),
        F.when(F.col("closed"), F.coalesce("close_ns", "t_start_ns")).alias("close_ns"),
        F.col("end_error").alias("is_error"), "parent_tool_use_id",
        F.when(naming.builtin_tool(F.col("name")), "approximate").otherwise("precise").alias("kernel_timing"),
    )
    out = _conversation(_outcome(sessions, transcript, None))
    out["Tool"] = _tool_rows(advertised_tools(transcript))
    out["ToolCall"] = _finish(calls, sessions)
    return out


def from_hooks(sessions: DataFrame, transcript: DataFrame, hooks: DataFrame) -> dict[str, DataFrame]:
    """The same tables with calls, times and prompt taken from hook events."""
    ids = hooks.filter(F.length("tool_use_id") > 0)
    pre = first_rows(
        ids.filter("hook = 'PreToolUse'"), ["session_id", "tool_use_id"], [F.col("ts_ns").desc()]
    ).select("session_id", F.col("tool_use_id").alias("use_id"), F.col("tool_name").alias("name"), F.col("ts_ns").alias("open_ns"), "parent_tool_use_id")
    post = ids.filter("hook = 'PostToolUse'").select(
        "session_id", F.col("tool_use_id").alias("use_id"), F.col("ts_ns").alias("close_ns"), "is_error"
    )
    closed = first_rows(
        pre.select("session_id", "use_id", "open_ns").join(post, ["session_id", "use_id"]).filter("close_ns >= open_ns"),
        ["session_id", "use_id"], [F.col("close_ns").desc()],
    ).drop("open_ns")
    calls = pre.join(closed, ["session_id", "use_id"], "left").withColumn("kernel_timing", F.lit("precise"))
    asked = hooks.filter("hook = 'UserPromptSubmit'").groupBy("session_id").agg(F.min_by("prompt", "ts_ns").alias("__said"))
    spoken = F.when(F.length("__said") > 0, F.col("__said"))
    s = sessions.join(asked, "session_id", "left").withColumn("prompt", F.coalesce(spoken, "prompt")).drop("__said")
    out = _conversation(_outcome(s, transcript, hooks))
    used = ids.filter("hook = 'PreToolUse'").select("session_id", F.col("tool_name").alias("name"))
    out["Tool"] = _tool_rows(used.unionByName(advertised_tools(transcript)).distinct())
    out["ToolCall"] = _finish(calls, sessions)
    return out


def extract(sessions: DataFrame, transcript: DataFrame, hooks: DataFrame | None = None, mode: str = "stream") -> dict[str, DataFrame]:
    """``stream``, ``hooks``, or ``auto``: hooks for every session that has hook events."""
    if mode == "stream" or hooks is None:
        return from_transcript(sessions, transcript)
    if mode == "hooks":
        return from_hooks(sessions, transcript, hooks)
    has = hooks.select("session_id").distinct()
    on = ["session_id"]
    a = from_hooks(sessions.join(has, on, "left_semi"), transcript.join(has, on, "left_semi"), hooks)
    b = from_transcript(sessions.join(has, on, "left_anti"), transcript.join(has, on, "left_anti"))
    return {name: a[name].unionByName(b[name]) for name in a}


def reconcile_names(agent_servers: DataFrame, kernel_servers: DataFrame, by: list[str]) -> DataFrame:
    """agent id -> kernel id where one name contains the other; earliest kernel server wins.

    Names repeat across sessions, so the text test runs on distinct name pairs per key.
    """
    a = agent_servers.select(*by, F.col("mcp_id").alias("agent_id"), F.lower(F.substring_index("mcp_id", "/", -1)).alias("an"))
    k = kernel_servers.select(*by, F.col("mcp_id").alias("kernel_id"), F.lower("name").alias("kn"), "t_start_ns")
    first = k.groupBy(*by, "kn").agg(F.min(F.struct("t_start_ns", "kernel_id")).alias("k"))
    hit = a.distinct().join(first, by).filter(F.col("kn").contains(F.col("an")) | F.col("an").contains(F.col("kn")))
    return hit.groupBy(*by, "agent_id").agg(F.min("k").alias("k")).select(*by, "agent_id", F.col("k.kernel_id").alias("kernel_id"))


def ingest(kernel: dict[str, DataFrame], agent: dict[str, DataFrame], trace_of: DataFrame) -> dict[str, DataFrame]:
    """Graph tables with the agent layer merged in.

    ``trace_of`` (session_id, trace_id, graph_session) says which session vertex of which
    trace a captured session is.  Kernel times stay unless they are missing.
    """
    def placed(df):
        return df.join(trace_of, "session_id")

    tools, calls = placed(agent["Tool"]), placed(agent["ToolCall"])
    links = reconcile_names(
        tools.filter("NOT is_builtin").select("trace_id", "mcp_id"), kernel["MCP"], ["trace_id"]
    ).withColumnRenamed("agent_id", "mcp_id")
    on = ["trace_id", "mcp_id"]
    tools = tools.join(links, on, "left").withColumn("mcp_id", F.coalesce("kernel_id", "mcp_id"))
    calls = calls.join(links, on, "left").withColumn("mcp_id", F.coalesce("kernel_id", "mcp_id")).drop("kernel_id")
    k = kernel["ToolCall"]
    a = calls.select(
        "trace_id", "tool_call_id", *[F.col(c).alias(f"a_{c}") for c in
        ("iteration_id", "mcp_id", "name", "is_builtin", "kernel_timing", "t_open_ns", "t_close_ns", "is_error")],
    )
    j = k.join(a, ["trace_id", "tool_call_id"], "full_outer")
    real = lambda c: F.when(F.col(c) > 0, F.col(c))
    merged = j.select(
        "trace_id", "tool_call_id",
        F.coalesce("a_iteration_id", "iteration_id").alias("iteration_id"),
        F.coalesce("mcp_id", "a_mcp_id").alias("mcp_id"), F.coalesce("name", "a_name").alias("name"),
        *[F.coalesce(f"a_{c}", c).alias(c) for c in ("is_builtin", "kernel_timing")],
        F.coalesce(real("t_open_ns"), real("a_t_open_ns"), "t_open_ns", "a_t_open_ns").alias("t_open_ns"),
        F.coalesce(real("t_close_ns"), real("a_t_close_ns"), "t_close_ns", "a_t_close_ns").alias("t_close_ns"),
        F.coalesce("a_is_error", "is_error").alias("is_error"),
    )
    its = placed(agent["Iteration"]).select("trace_id", "iteration_id", F.col("graph_session").alias("session_id"), "ordinal", "t_start_ns", "t_end_ns", "outcome")
    first, nxt = callwindows.call_chains(calls, ["trace_id", "iteration_id"], ["t_open_ns", "tool_call_id"], "tool_call_id")
    _, follows = callwindows.call_chains(
        its.withColumn("ord_", F.col("ordinal").cast("bigint")), ["trace_id", "session_id"], ["ord_", "iteration_id"], "iteration_id"
    )
    ends = placed(agent["Session"]).select(
        "trace_id", F.col("graph_session").alias("session_id"),
        F.col("terminator_status").alias("__st"), F.col("terminator_reason").alias("__re"),
    )
    sessions = kernel["Session"].join(ends, ["trace_id", "session_id"], "left").withColumn(
        "terminator_status", F.coalesce("__st", "terminator_status")
    ).withColumn("terminator_reason", F.coalesce("__re", "terminator_reason")).drop("__st", "__re")
    known = tools.select("trace_id", "tool_key").distinct()
    key = F.concat_ws("/", "session_id", "name")
    out = dict(kernel)
    out.update(
        Session=sessions,
        Iteration=its,
        Prompt=placed(agent["Prompt"]).drop("session_id", "graph_session"),
        Response=placed(agent["Response"]).drop("session_id", "graph_session"),
        Tool=tools.select("trace_id", "tool_key", "name", "is_builtin", "mcp_id", "description"),
        ToolCall=merged,
        has_iteration=its.select("trace_id", "session_id", "iteration_id"),
        follows=follows.drop("session_id"),
        has_prompt=placed(agent["Prompt"]).select("trace_id", "iteration_id", "prompt_id"),
        has_response=placed(agent["Response"]).select("trace_id", "iteration_id", "response_id"),
        issued=calls.select("trace_id", "iteration_id", "tool_call_id"),
        exposes=tools.filter("kernel_id IS NOT NULL").select("trace_id", F.col("kernel_id").alias("mcp_id"), "tool_key"),
        invokes=calls.select("trace_id", "tool_call_id", key.alias("tool_key")).join(known, ["trace_id", "tool_key"], "left_semi"),
        handled_by=calls.filter("NOT is_builtin AND mcp_id <> ''").select("trace_id", "tool_call_id", "mcp_id"),
        first_call=first,
        next_call=nxt.drop("iteration_id"),
        parent_call=calls.filter("parent_tool_use_id <> ''").select("trace_id", F.col("parent_tool_use_id").alias("parent_id"), "tool_call_id"),
    )
    return out
