"""Which pids of a capture belong to the tool server, and which are container noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.functions.paths import basename
from vestige.operators import detect
from vestige.operators.graph import reachable
from vestige.operators.segments import first_rows

# Programs above the tool server.
ANCESTOR_BINARIES = (
    "/usr/local/bin/claude", "/usr/local/sbin/claude",
    "/usr/local/lib/node_modules/@anthropic-ai/claude-code/bin/claude.exe",
    "/bin/sh", "/usr/bin/sh", "/usr/local/bin/sh", "/usr/local/sbin/sh", "/usr/sbin/sh", "/bin/dash",
    "/usr/bin/grep",
)
# Thread names of tool servers, and names of the processes above them.
COMM_DISTINCTIVE = (
    "libuv-worker", "HTTP Client", "V8Worker", "Bun Pool 0", "Bun Pool 1", "Bun Pool 2",
    "Bun Pool 3", "Bun Pool 4", "MainThread",
)
COMM_ANCESTOR = (
    "claude", "claude.exe", "strace", "sh", "runc:[0:PARENT]", "runc:[1:CHILD]", "runc:[2:INIT]",
    "docker-entrypoi", "grep", "6",
)
# Container and tracer programs.
NOISE_BINARY = r"^(?:runc(?::|$)|containerd|docker-entrypoint|docker-init|strace$|/?bin/sh$)"
# Comms of commands run into the container from outside.
EXEC_COMMS = ("runc:[2:INIT]", "touch")


def root_by_first_exec(calls: DataFrame, by: list[str]) -> DataFrame:
    """Smallest pid whose first execve lies in /usr/local/(s)bin and is no ancestor."""
    execs = calls.filter("event = 'execve' AND length(path) > 0").select(*by, "pid", "seq", "path")
    first = first_rows(execs, [*by, "pid"], [F.col("seq")])
    p = F.col("path")
    ok = p.rlike("^/usr/local/s?bin/") & ~p.isin(*ANCESTOR_BINARIES) & ~p.contains("claude-code")
    return first.filter(ok).groupBy(*by).agg(F.min("pid").alias("node"))


def fork_subtree(calls: DataFrame, by: list[str]) -> DataFrame:
    """The server root and everything it forked."""
    ret = F.col("ret").try_cast("bigint")
    edges = calls.filter(F.col("event").isin("clone", "clone3") & (ret > 0)).select(
        *by, F.col("pid").alias("parent"), ret.alias("child")
    ).distinct()
    return reachable(edges, root_by_first_exec(calls, by), by=tuple(by)).select(*by, F.col("node").alias("pid"))


def builtin_subtree(calls: DataFrame, by: list[str]) -> DataFrame:
    """Built-in-tool captures: every pid that never was start-up or tracer."""
    path, a0 = F.coalesce("path", F.lit("")), F.coalesce(detect.arg(F.col("argv"), 0), F.lit(""))
    boot = (F.col("event") == "execve") & (
        path.contains("docker-entrypoint") | a0.endswith("/strace") | (a0 == "strace")
    )
    return calls.groupBy(*by, "pid").agg(F.bool_or(boot).alias("boot")).filter("NOT boot").drop("boot")


def root_by_comm(events: DataFrame, by: list[str]) -> DataFrame:
    """First non-agent program under /usr/local/bin that a process named like the agent runs."""
    p = F.col("path")
    hit = (F.col("event") == "execve") & (F.col("comm") == detect.AGENT) & p.startswith("/usr/local/bin/") & ~p.startswith("/usr/local/bin/claude")
    return events.filter(hit).groupBy(*by).agg(F.min_by("pid", F.struct("ts_ns", "seq")).alias("pid"))


def comm_history(events: DataFrame, by: list[str]) -> DataFrame:
    """Per pid: event count and which kinds of names it ever carried."""
    c = F.col("comm")
    named = F.length(F.coalesce(c, F.lit(""))) > 0
    distinctive, ancestor = c.isin(*COMM_DISTINCTIVE), c.isin(*COMM_ANCESTOR)
    own = named & ~ancestor & ~distinctive
    return events.groupBy(*by, "pid").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(named & distinctive), F.lit(False)).alias("has_distinctive"),
        F.coalesce(F.bool_or(named & ancestor), F.lit(False)).alias("has_ancestor"),
        F.coalesce(F.bool_or(own), F.lit(False)).alias("has_own_name"),
    )


def busiest_own_name(history: DataFrame, by: list[str]) -> DataFrame:
    """Busiest pid with a name that is neither an ancestor's nor a mere worker's."""
    return history.filter("has_own_name").groupBy(*by).agg(F.max_by("pid", F.struct("n", -F.col("pid"))).alias("pid"))


def comm_subtree(events: DataFrame, by: list[str]) -> DataFrame:
    history = comm_history(events, by)
    root = root_by_comm(events, by)
    backup = busiest_own_name(history, by).join(root, by, "left_anti")
    workers = history.filter("has_distinctive AND NOT has_ancestor").select(*by, "pid")
    return root.unionByName(backup).unionByName(workers).distinct()


def noise_pids(events: DataFrame, by: list[str]) -> DataFrame:
    """Pids that ran container or tracer programs, or registered a server, and never were
    a session or server root."""
    argv = F.col("argv")
    ex = events.filter((F.col("event") == "execve") & (F.size("argv") > 0))
    base = basename(detect.arg(argv, 0))
    registers = (base == detect.AGENT) & F.array_contains(argv, "mcp") & F.array_contains(argv, "add")
    root = F.lower(base).eqNullSafe(F.lit(detect.AGENT)) & F.arrays_overlap(argv, F.array(*[F.lit(s) for s in detect.SESSION_SWITCHES]))
    server = detect.strict_server(F.lit("execve"), F.col("path"), argv).isNotNull()
    return (
        ex.groupBy(*by, "pid")
        .agg(F.bool_or(base.rlike(NOISE_BINARY) | registers).alias("noise"), F.bool_or(root | server).alias("keep"))
        .filter("noise AND NOT keep")
        .select(*by, "pid")
    )


def strip_noise(events: DataFrame, by: list[str]) -> DataFrame:
    return events.join(noise_pids(events, by), [*by, "pid"], "left_anti")


def strip_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Events kept and dropped by the noise rule, from per-pid counts."""
    per_pid = events.groupBy(*by, "pid").agg(F.count(F.lit(1)).alias("n"))
    bad = noise_pids(events, by).withColumn("bad", F.lit(True))
    j = per_pid.join(bad, [*by, "pid"], "left")
    zero = F.lit(0).cast("bigint")
    return j.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), zero).alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("bad").isNull(), F.col("n"))), zero).alias("kept"),
    )


def drop_tracer(calls: DataFrame, by: list[str], *, first_only: bool = True) -> DataFrame:
    """Without the tracer's own thread groups (only the first one when ``first_only``) and
    without commands run in from outside."""
    tracer = calls.filter("comm = 'strace'")
    if first_only:
        groups = tracer.groupBy(*by).agg(F.min_by("tgid", F.struct("ts_ns", "tgid")).alias("tgid"))
    else:
        groups = tracer.select(*by, "tgid").distinct()
    return calls.join(groups, [*by, "tgid"], "left_anti").filter(~F.col("comm").isin(*EXEC_COMMS))
