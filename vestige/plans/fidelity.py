"""Host trace against the in-container oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.functions.paths import basename
from vestige.operators import graph, matching, metrics
from vestige.operators.detect import AGENT, arg
from vestige.operators.segments import first_rows
from vestige.operators.subtree import drop_tracer
from vestige.operators.timejoin import distinct_inside

BY_TIME_NS = 50_000_000
BY_NAME_NS = 100_000_000
JITTER_NS = 20_000_000

# Calls the host sensor can see.
HOST_OBSERVABLE = (
    "openat", "open", "connect", "sendto", "recvfrom", "execve", "clone", "clone3", "unlinkat",
    "unlink", "exit_group", "bind", "ptrace",
)


def host_execs(events: DataFrame) -> DataFrame:
    """First execve per host pid."""
    ex = events.filter("event = 'execve'").select("trace_id", "pid", "ts_ns", "seq", F.col("path").alias("image"), "argv")
    return first_rows(ex, ["pid", "trace_id"], [F.col("ts_ns"), F.col("seq")])


def _names(image, argv):
    """Basenames a program goes by: of its image and of its argv[0]."""
    return F.array(basename(image), basename(F.coalesce(arg(argv, 0), F.lit(""))))


def bridge_by_name(oracle_execs: DataFrame, host: DataFrame, tol_ns: int = BY_NAME_NS) -> DataFrame:
    """host pid <-> container pid by execve time and program name (trace_id, pid, tid).

    A host without argv goes by its image only; an oracle row without argv by '' too.
    """
    image = F.col("image")
    h_names = F.when(F.size("argv") > 0, _names(image, F.col("argv"))).otherwise(F.array(basename(image)))
    h = host.withColumn("names", h_names)
    o = oracle_execs.withColumn("names", _names(image, F.col("argv"))).withColumnRenamed("pid", "tid")
    return matching.nearest_one_to_one(
        h, o, ["trace_id"], "pid", "tid", tol_ns, host_keys="names", mark_keys="names"
    ).select("trace_id", "pid", "tid", "gap")


def bridge_by_time(oracle_calls: DataFrame, events: DataFrame, tol_ns: int = BY_TIME_NS) -> DataFrame:
    """host pid -> container pid by execve time alone; a re-exec's latest match counts."""
    h = events.filter("event = 'execve'").select("trace_id", "pid", "ts_ns", "seq", F.struct("pid", "seq").alias("host"))
    o = oracle_calls.filter("syscall = 'execve'").select("trace_id", "ts_ns", "seq", F.struct("pid", "seq").alias("mark"))
    m = matching.nearest_one_to_one(h, o, ["trace_id"], "host", "mark", tol_ns)
    rows = m.select("trace_id", F.col("host.pid").alias("pid"), F.col("mark.pid").alias("tid"), "ts_ns", F.col("host.seq").alias("seq"))
    return rows.groupBy("trace_id", "pid").agg(F.max_by("tid", F.struct("ts_ns", "seq")).alias("tid"))


def projected_edges(parents: DataFrame, subset: DataFrame) -> DataFrame:
    """Edges of the tree restricted to ``subset`` (trace_id, node): nearest proper ancestor
    inside the subset."""
    up = graph.nearest_marked(parents, subset, proper=True).filter("found IS NOT NULL")
    return up.join(subset.select("trace_id", "node").distinct(), ["trace_id", "node"], "left_semi").select(
        "trace_id", F.col("found").alias("parent"), F.col("node").alias("child")
    )


def process_fidelity(oracle: DataFrame, oracle_execs: DataFrame, events: DataFrame) -> DataFrame:
    """Per session: subprocess recall, count ratio, edge recall, root sightings, totals."""
    from vestige.session import settle

    n = F.count(F.lit(1))
    # One row per thread, for all counts and first sightings; by pid first, as traces are few and slow to sort by.
    threads = settle(events.groupBy("pid", "tid", "trace_id").agg(n.alias("n"), F.min(F.struct("ts_ns", "seq")).alias("at")))
    oracle_execs = settle(oracle_execs.select("trace_id", "pid", "ts_ns", "seq", "image", "argv"))
    host = settle(host_execs(events))
    bridge = settle(bridge_by_name(oracle_execs, host))
    o_par = graph.returned_children(oracle, ["trace_id"], "syscall")
    o_par = settle(o_par.groupBy("trace_id", "child").agg(F.max_by("parent", F.struct("ts_ns", "seq")).alias("parent")))
    forest = settle(graph.forest_of(threads.groupBy("pid", "trace_id").agg(F.min("at").alias("at")), events))
    h_par = forest.filter("parent IS NOT NULL").select("trace_id", F.col("pid").alias("child"), "parent")
    o_edges = projected_edges(o_par, oracle_execs.select("trace_id", F.col("pid").alias("node")))
    h_edges = projected_edges(h_par, host.select("trace_id", F.col("pid").alias("node")))
    to = lambda a, b: bridge.select("trace_id", F.col("pid").alias(a), F.col("tid").alias(b))
    seen = h_edges.join(to("parent", "p"), ["trace_id", "parent"]).join(to("child", "c"), ["trace_id", "child"]).select("trace_id", "p", "c").distinct()
    known = bridge.select("trace_id", "tid").distinct()
    kept = o_edges.join(known.withColumnRenamed("tid", "parent"), ["trace_id", "parent"], "left_semi").join(
        known.withColumnRenamed("tid", "child"), ["trace_id", "child"], "left_semi"
    ).select("trace_id", F.col("parent").alias("p"), F.col("child").alias("c")).distinct()
    hit = kept.join(seen.withColumn("hit", F.lit(1)), ["trace_id", "p", "c"], "left")
    edges = hit.groupBy("trace_id").agg(n.alias("edges_in_l1_subgraph"), F.try_divide(F.count("hit").cast("double"), n).alias("edge_recall"))
    count = lambda df, name: df.groupBy("trace_id").agg(n.alias(name))
    totals = threads.groupBy("trace_id").agg(
        F.count_distinct("pid").alias("host_pids_total"), F.count_distinct("tid").alias("host_tids_total"), F.sum("n").alias("host_events")
    )
    agent = F.coalesce(arg(F.col("argv"), 0), F.lit("")).contains(AGENT)
    last_exec = events.filter("event = 'execve'").groupBy("pid", "trace_id").agg(F.max_by(agent, F.struct("ts_ns", "seq")).alias("agent"))
    roots = last_exec.join(forest, ["trace_id", "pid"]).groupBy("trace_id").agg(
        F.bool_or(F.col("agent") & F.col("parent").isNull()).alias("host_saw_claude_root"), F.bool_or("agent").alias("host_saw_claude_anywhere")
    )
    out = count(oracle_execs, "l1_subprocesses")
    for part in (count(host, "host_subprocesses"), count(bridge, "bridged"), edges, totals, roots):
        out = out.join(part, "trace_id", "left")
    zero = F.lit(0)
    return out.withColumn(
        "subprocess_recall", F.coalesce("bridged", zero).cast("double") / F.col("l1_subprocesses")
    ).withColumn("subprocess_count_ratio", F.coalesce("host_subprocesses", zero).cast("double") / F.col("l1_subprocesses"))


def call_cells(oracle: DataFrame, events: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per bridged process and call name: oracle count, host count, delta."""
    l1 = metrics.histogram(oracle.filter(F.col("syscall").isin(*HOST_OBSERVABLE)), ["trace_id", "pid"], "syscall").withColumnRenamed("pid", "tid")
    host = metrics.histogram(events, ["trace_id", "pid"])
    left = l1.join(bridge.select("trace_id", "pid", "tid"), ["trace_id", "tid"]).select("trace_id", "pid", "tid", F.col("syscall").alias("event"), "n")
    right = host.join(bridge.select("trace_id", "pid", "tid"), ["trace_id", "pid"]).select("trace_id", "pid", "tid", "event", "n")
    return metrics.compare_counts(left, right, ["trace_id", "pid", "tid", "event"], names=("l1", "host"))


def corpus_ratios(cells: DataFrame) -> DataFrame:
    return cells.groupBy("event").agg(F.sum("l1").alias("l1"), F.sum("host").alias("host")).withColumn(
        "ratio", F.try_divide(F.col("host").cast("double"), F.col("l1"))
    )


def clock_offset(oracle_calls: DataFrame, host_calls: DataFrame, mark: DataFrame, by: list[str], program: str = "python3", exec_nr: int = 59) -> DataFrame:
    """Wall minus monotonic time: the first oracle execve of ``program`` after the mark
    against the first host execve of that comm.  ``mark`` (by.., mark_ns)."""
    image = F.regexp_extract("args_raw", r'^"([^"]*)"', 1)
    o = oracle_calls.filter(F.col("syscall") == "execve").filter(image.endswith(program)).join(mark, by).filter(
        "ts_ns > mark_ns").groupBy(*by).agg(F.min_by("ts_ns", "seq").alias("wall"))
    h = host_calls.filter((F.col("nr") == exec_nr) & (F.col("comm") == program)).groupBy(*by).agg(F.min_by("ts_ns", "seq").alias("mono"))
    return o.join(h, by).select(*by, (F.col("wall") - F.col("mono")).alias("offset_ns"))


def workload_counts(oracle_calls: DataFrame, host_calls: DataFrame, marks: DataFrame, offsets: DataFrame, by: list[str], jitter_ns: int = JITTER_NS) -> DataFrame:
    """Call counts of both traces inside the marked window (by.., syscall, strace, host).

    ``marks`` (by.., start_ns, end_ns); half-open window widened by the jitter.
    """
    inside = (F.col("wall") >= F.col("start_ns") - jitter_ns) & (F.col("wall") < F.col("end_ns") + jitter_ns)
    host = drop_tracer(host_calls, by).join(offsets, by).join(marks, by).withColumn("wall", F.col("ts_ns") + F.col("offset_ns")).filter(inside)
    orc = oracle_calls.join(marks, by).withColumn("wall", F.col("ts_ns")).filter(inside)
    return metrics.compare_counts(
        metrics.histogram(orc, by, "syscall"), metrics.histogram(host, by, "syscall"), [*by, "syscall"], names=("strace", "host")
    )


def sensor_ratio(counts: DataFrame, by: list[str]) -> DataFrame:
    """Totals, their ratio, and how many call names only one side saw."""
    return counts.groupBy(*by).agg(
        F.sum("strace").alias("strace_total"), F.sum("host").alias("host_total"),
        F.try_divide(F.sum("host").cast("double"), F.sum("strace")).alias("ratio"),
        F.count_if(F.col("host") == 0).alias("only_strace"), F.count_if(F.col("strace") == 0).alias("only_host"),
    )


def one_sided_names(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.filter("host = 0 OR strace = 0").select(
        *by, "syscall", F.when(F.col("host") == 0, "strace").otherwise("host").alias("only_in"), (F.col("strace") + F.col("host")).alias("n")
    )


def call_ambiguity(events: DataFrame, windows: DataFrame, server_pids: DataFrame, by: list[str]) -> DataFrame:
    """Per tool call: distinct pids, threads, server-subtree pids active in its window."""
    count = lambda col, name, df=events: distinct_inside(df, windows, by, "ts_ns", "lo", "hi", "use_id", col, name)
    served = events.join(server_pids, [*by, "pid"], "left_semi")
    out = windows.select(*by, "use_id")
    for part in (count("pid", "n_host_pids"), count("tid", "n_host_tids"), count("pid", "n_server_pids", served)):
        out = out.join(part, [*by, "use_id"], "left")
    out = out.fillna(0, ["n_host_pids", "n_host_tids", "n_server_pids"])
    return out.withColumn("ambiguous", F.col("n_server_pids") > 1)


def ambiguity_rates(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return calls.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_calls"), share(F.col("ambiguous")).alias("ambiguous_share"),
        share(F.col("n_server_pids") == 0).alias("no_server_share"),
    )
