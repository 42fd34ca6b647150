"""The driver tables seen as traces, transcripts, hooks, windows, trees and policies.

Each view is a projection of whole tables, so a query's work grows with them.  The SQL
twins of these views are in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.operators.segments import scan_next
from vestige.schema import canonical
from vestige.session import settle, tune
from vestige.sources.sessions import compile_envelopes

EPOCH_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, seq, ts_ns (microseconds read as nanoseconds), event_type, k, trace_id."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("trace_id"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("ts_ns"),
        F.col("user_id").alias("pid"),
        "event_type",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
        "value",
    )


def _words(*parts):
    return F.array(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


# What each row of the event table stands for in a host trace.
HOST_COLUMNS = """
CASE event_type
  WHEN 'signup' THEN CASE WHEN k < 70 THEN 'execve' ELSE 'sched_fork' END
  WHEN 'error' THEN CASE WHEN k < 40 THEN 'clone' WHEN k < 60 THEN 'execve' ELSE 'unlinkat' END
  WHEN 'purchase' THEN CASE WHEN k < 40 THEN 'connect' WHEN k < 70 THEN 'sendto' ELSE 'recvfrom' END
  ELSE 'openat' END AS event;
pid * 10 + k % 3 AS tid;
element_at(array('node', 'MainThread', 'claude', 'sh', 'libuv-worker'), CAST(pid % 5 + 1 AS INT)) AS comm;
CASE WHEN k % 10 <> 0 THEN 100 + pid % 2 END AS cgroup_id;
CASE event_type
  WHEN 'signup' THEN CASE WHEN k < 20 THEN '/usr/bin/claude' WHEN k < 40 THEN concat('/usr/local/bin/mcp-server-', k % 5)
    WHEN k < 50 THEN '/usr/bin/node' WHEN k < 60 THEN '/usr/bin/claude' WHEN k < 70 THEN '/opt/fs-tool' END
  WHEN 'error' THEN CASE WHEN k < 40 THEN NULL WHEN k < 60 THEN '/bin/ls' ELSE concat('/data/p', k % 10, '/x') END
  WHEN 'view' THEN CASE WHEN k < 20 THEN concat('/etc/p', k) ELSE concat('/data/p', k % 10, '/f', k) END
  WHEN 'click' THEN CASE WHEN k < 10 THEN concat('/tmp/.h', k) ELSE concat('/tmp/mcp-', k % 5, '/f', k) END END AS path;
CASE WHEN event_type = 'signup' AND k < 20 THEN array('/usr/bin/claude', '-p', concat('prompt ', k))
  WHEN event_type = 'signup' AND k < 40 THEN array(concat('/usr/local/bin/mcp-server-', k % 5), '--stdio')
  WHEN event_type = 'signup' AND k < 50 THEN array('node', '/srv/chroma-mcp-server.js')
  WHEN event_type = 'signup' AND k < 60 THEN array('claude', 'mcp', 'add', concat('fs', k % 5), '--scope', 'local', '--', 'env', 'K=V', 'fs-tool', '--root')
  WHEN event_type = 'signup' AND k < 70 THEN array('/opt/fs-tool', '--root')
  WHEN event_type = 'error' AND k BETWEEN 40 AND 59 THEN array('ls', '-la', concat('/data/p', k % 10), 'api.example.com') END AS argv;
CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN element_at(array(1, 2, 66, 3), k % 4 + 1) END AS flags;
event_type = 'click' AND k % 4 <> 3 AS write_intent;
CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 9 THEN 1 WHEN k % 2 = 0 THEN 2 ELSE 10 END END AS family;
CASE WHEN event_type = 'purchase' THEN concat('10.0.0.', k % 8) END AS daddr;
CASE WHEN event_type = 'purchase' THEN 443 + k % 3 END AS dport;
CASE WHEN event_type = 'purchase' THEN k % 4 END AS fd;
CASE WHEN event_type = 'purchase' THEN CAST(k * 10 AS BIGINT) END AS len;
CASE WHEN event_type = 'purchase' AND k BETWEEN 40 AND 69 THEN base64(encode(CASE WHEN k % 2 = 0
  THEN concat('{"jsonrpc":"2.0","id":', k, ',"method":"tools/call","params":{"name":"t', k % 5, '"}}')
  ELSE concat('{"jsonrpc":"2.0","id":', k, ',"result":{}}') END, 'UTF-8')) END AS buf;
CASE WHEN event_type = 'signup' AND k >= 70 THEN pid END AS parent_pid;
CASE WHEN event_type = 'signup' AND k >= 70 THEN pid + 4 * (k % 7) END AS child_pid;
CASE WHEN event_type = 'signup' AND k >= 70 THEN element_at(array('node', 'MainThread', 'claude', 'sh', 'libuv-worker'), CAST(pid % 5 + 1 AS INT)) END AS parent_comm
"""


def host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical host events: agent and server starts, forks, clones, files, sockets."""
    # A generator of one row: a plain projection would run the pattern for k again in every branch below.
    e = ev(spark, sf_dir).withColumnRenamed("k", "k_").select("*", F.explode(F.array("k_")).alias("k"))
    return canonical(e.selectExpr("trace_id", "seq", "ts_ns", "pid", *HOST_COLUMNS.split(";")))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, from each purchase to the next one (the last stays open: hi = -1)."""
    buys = ev(spark, sf_dir).filter("event_type = 'purchase'")
    nxt = scan_next(buys, ["trace_id", "pid"], ["ts_ns", "seq"], F.col("ts_ns"), "next")
    return nxt.select(
        "trace_id", "pid", F.col("seq").alias("use_id"), F.col("ts_ns").alias("lo"), F.coalesce("next", F.lit(-1)).alias("hi"), "k"
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping closed windows: every purchase lasts k seconds of the trace's clock."""
    return ev(spark, sf_dir).filter("event_type = 'purchase'").select(
        "trace_id", "pid", F.col("seq").alias("use_id"), F.col("ts_ns").alias("lo"),
        (F.col("ts_ns") + F.col("k") * F.lit(1_000_000_000).cast("bigint")).alias("hi"), "k",
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child = event id, parent = event id div 3, one tree per trace t."""
    return table(spark, sf_dir, "events").filter("event_id > 0").select(
        F.lit("t").alias("trace_id"), F.col("event_id").alias("child"), F.floor(F.col("event_id") / 3).cast("bigint").alias("parent"),
        F.col("event_type"),
    )


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host events as JSON text lines, plus metadata and broken lines."""
    h = host(spark, sf_dir)
    args = F.struct(
        "path", "argv", "flags", "fd", "family", "daddr", "dport", "len", F.col("buf").alias("buf_b64"),
        "parent_pid", "child_pid", "parent_comm",
    )
    text = F.to_json(F.struct("event", "pid", "tid", "ts_ns", "comm", "cgroup_id", args.alias("args")))
    good = h.select("trace_id", "seq", text.alias("value"))
    meta = h.filter("seq % 7 = 0").select("trace_id", "seq", F.lit('{"event":"_calibration","pid":1}').alias("value"))
    bad = h.filter("seq % 11 = 0").select("trace_id", "seq", F.concat(F.lit('{"event":"openat",'), F.col("seq")).alias("value"))
    return good.unionByName(meta).unionByName(bad)


def strace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle text per user: whole calls, split calls, signals.  seq is the line order."""
    e = ev(spark, sf_dir).withColumn("line", F.col("ts_ns") * 1_000_000 + F.col("seq") % 1_000_000)
    sec = F.floor(F.col("ts_ns") / 1_000_000).cast("bigint")
    head = F.concat(F.col("pid"), F.lit(" "), sec, F.lit("."), F.lpad((F.col("ts_ns") % 1_000_000).cast("string"), 6, "0"), F.lit(" "))
    k = F.col("k")
    body = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('openat(AT_FDCWD, "/data/f'), k, F.lit('", O_RDONLY|O_CLOEXEC) = '), k))
        .when((F.col("event_type") == "click") & (k % 2 == 0), F.concat(F.lit('openat(AT_FDCWD, "/tmp/w'), k, F.lit('", O_WRONLY|O_CREAT <unfinished ...>')))
        .when(F.col("event_type") == "click", F.concat(F.lit("<... openat resumed>) = "), k))
        .when((F.col("event_type") == "error") & (k < 50), F.lit("--- SIGCHLD {si_signo=SIGCHLD} ---"))
        .when(F.col("event_type") == "error", F.concat(F.lit("clone(child_stack=NULL, flags=CLONE_VM) = "), F.col("pid") + 4 * (k % 7)))
        .when(F.col("event_type") == "signup", F.concat(F.lit('execve("/usr/bin/prog'), k % 5, F.lit('", ["prog'), k % 5, F.lit('", "-x", "'), k, F.lit('"], 0x7f /* 3 vars */) = 0')))
        .otherwise(F.concat(F.lit("connect("), k % 9, F.lit(", {sa_family=AF_INET"), F.when(k % 2 == 0, "6").otherwise(""), F.lit(", sin_port=htons(443)}, 16) = -1 EINPROGRESS (busy)")))
    )
    # Landed as text first, as a trace file would be.
    return settle(e.select("trace_id", F.col("line").cast("bigint").alias("seq"), F.concat(head, body).alias("value")))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per conversation: first user text is the prompt."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"), F.max("turn").alias("last")
    ).select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), F.coalesce("prompt", F.lit("")).alias("prompt"),
        (F.col("conv_id") * F.lit(10_000_000_000_000)).alias("t_start_ns"),
        (F.col("conv_id") * F.lit(10_000_000_000_000) + (F.col("last") + 1) * F.lit(7_000_000_000)).alias("t_end_ns"), "conv_id",
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript JSON lines.

    Turn t happens at conv*10000 + 7*(t+1) s.  Assistant turns use a tool, the next user
    turn carries its result, and an assistant's final turn also yields a result record.
    """
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = c.join(last, "conv_id")
    sid = F.concat(F.lit("s"), "conv_id")
    at = F.date_format(F.timestamp_seconds(F.col("conv_id") * 10_000 + 7 * (F.col("turn") + 1)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tool = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("mcp__srv"), F.col("conv_id") % 5, F.lit("__run"))).otherwise("Bash")
    use = F.struct(F.lit("tool_use").alias("type"), F.concat_ws("_", F.lit("u"), "conv_id", "turn").alias("id"), tool.alias("name"))
    res = F.struct(F.lit("tool_result").alias("type"), F.concat_ws("_", F.lit("u"), "conv_id", F.col("turn") - 1).alias("tool_use_id"),
                   (F.length("text") % 5 == 0).alias("is_error"))
    ask = F.to_json(F.struct(F.lit("assistant").alias("type"), sid.alias("session_id"), at.alias("timestamp"),
                             F.struct(F.array(use).alias("content")).alias("message")))
    answer = F.to_json(F.struct(F.lit("user").alias("type"), sid.alias("session_id"), at.alias("timestamp"),
                                F.struct(F.array(res).alias("content")).alias("message")))
    init = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("init").alias("subtype"), sid.alias("session_id"),
                              F.array(F.lit("Bash"), F.concat(F.lit("mcp__srv"), F.col("conv_id") % 5, F.lit("__run"))).alias("tools")))
    end = F.to_json(F.struct(F.lit("result").alias("type"), sid.alias("session_id"), F.col("text").alias("result"),
                             (F.length("text") % 7 == 0).alias("is_error"), F.lit("end_turn").alias("stop_reason"),
                             F.when(F.length("text") % 3 == 0, "max_turns").otherwise("completed").alias("terminal_reason")))
    rows = F.array(
        F.struct(F.lit(0).alias("o"), F.when(F.col("turn") == 0, init).alias("v")),
        F.struct(F.lit(1).alias("o"), F.when(F.col("role") == "assistant", ask).otherwise(answer).alias("v")),
        F.struct(F.lit(2).alias("o"), F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), end).alias("v")),
    )
    return c.select(sid.alias("session_dir"), "turn", F.explode(rows).alias("x")).filter("x.v IS NOT NULL").select(
        "session_dir", (F.col("turn") * 3 + F.col("x.o")).alias("seq"), F.col("x.v").alias("value")
    )


def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hook events per user: purchases start a tool, views end it, errors stop."""
    e = ev(spark, sf_dir).filter("event_type IN ('purchase', 'view', 'error', 'signup')")
    name = F.when(F.col("k") % 2 == 0, "Bash").otherwise(F.concat(F.lit("mcp__srv"), F.col("k") % 3, F.lit("__run")))
    hook = F.create_map(*[F.lit(x) for x in ("purchase", "PreToolUse", "view", "postToolUse", "error", "Stop", "signup", "UserPromptSubmit")])
    is_tool = F.col("event_type").isin("purchase", "view")
    return e.select(
        (F.col("ts_ns") / 1_000_000).alias("ts"), F.element_at(hook, F.col("event_type")).alias("hook"),
        F.concat(F.lit("a"), "pid").alias("session_id"),
        F.when(is_tool, F.concat(F.lit("h"), "k")).otherwise("").alias("tool_use_id"), F.lit("").alias("parent_tool_use_id"),
        F.when(F.col("event_type") == "purchase", name).alias("tool_name"), (F.col("k") % 9 == 0).alias("is_error"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("ask "), "k")).alias("prompt"), F.lit(None).cast("string").alias("_corrupt_record"),
    )


def policy_rows(spark: SparkSession, sf_dir: str, dialect: str = "shell") -> DataFrame:
    """One policy per nation key."""
    n = F.col("n_nationkey")
    return compile_envelopes(
        table(spark, sf_dir, "nation").select(
            n.cast("bigint").alias("policy"), F.col("n_regionkey").alias("region"),
            _words(F.concat(F.lit("/data/p"), n % 10, F.lit("/*")), F.concat(F.lit("/etc/p"), n % 10, F.lit("?"))).alias("read_paths"),
            _words(F.concat(F.lit("/tmp/mcp-"), n % 5, F.lit("/**")), F.concat(F.lit("/tmp/.h"), n % 10)).alias("write_paths"),
            F.when(n % 2 == 0, _words("/data/**")).alias("delete_paths"),
            _words(F.concat(F.lit("10.0.0."), n % 8), "*.example.com").alias("allow_hosts"),
            _words("ls", "node", "/usr/bin/claude").alias("allow_binaries"),
            (n % 4 != 0).alias("allow_egress"), (n % 3 != 0).alias("allow_spawn"),
        ),
        dialect,
    )


def policed(spark: SparkSession, sf_dir: str, dialect: str = "shell") -> DataFrame:
    """Host events with the policy of their user (user modulo 25)."""
    h = host(spark, sf_dir).withColumn("policy", F.col("pid") % 25)
    return h.join(policy_rows(spark, sf_dir, dialect), "policy")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions, suppliers as processes, parts as targets."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_linenumber")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract(u, r"^[a-z]+://([^/:?#]+)", 1).alias("host"),
        F.regexp_extract(u, r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"),
    )
