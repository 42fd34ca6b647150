"""Log formats parsed from text built out of the driver tables, and field functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.functions import naming, rpc, strace as st, tokens
from vestige.operators import detect, metrics, selection, subtree
from vestige.operators.segments import MINUTE_NS
from vestige.plans import fidelity
from vestige.session import settle
from vestige.sources import hostlog, sessions, strace
from vestige.workload import oracle as o
from vestige.workload import views as v
from vestige.workload.registry import query


@query(
    "host_json_lines",
    o.with_views(o.HOST, """SELECT trace_id, event, count(*) AS n, count(path) AS n_path, sum(len(argv)) AS n_words, sum(flags) AS flags, sum(dport) AS ports,
    count(CASE WHEN write_intent THEN 1 END) AS writes FROM host GROUP BY 1, 2"""),
)
def host_json_lines(spark, sf):
    """JSON text to canonical rows: metadata and broken lines vanish, fields survive."""
    e = hostlog.parse_host_lines(v.host_lines(spark, sf))
    return e.groupBy("trace_id", "event").agg(
        F.count(F.lit(1)).alias("n"), F.count("path").alias("n_path"), F.sum(F.when(F.col("argv").isNotNull(), F.size("argv"))).alias("n_words"),
        F.sum("flags").alias("flags"), F.sum("dport").alias("ports"), F.count_if("write_intent").alias("writes"),
    )


@query(
    "policy_event_projection",
    o.with_views(o.HOST, """SELECT event, count(*) AS n, count(CASE WHEN event IN ('openat', 'unlinkat', 'execve') THEN path END) AS n_path,
    count(CASE WHEN event = 'openat' AND write_intent THEN 1 END) AS n_write, count(CASE WHEN event IN ('connect', 'sendto') THEN family END) AS n_family FROM host GROUP BY 1"""),
)
def policy_event_projection(spark, sf):
    e = hostlog.policy_events(v.host(spark, sf))
    return e.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.count("path").alias("n_path"), F.count_if("write_intent").alias("n_write"), F.count("family").alias("n_family")
    )


_STRACE = o.EV + """, st AS (
  SELECT trace_id, pid, ts_ns * 1000 AS ts_ns, ts_ns * 1000000 + seq % 1000000 AS line, k, event_type,
    CASE WHEN event_type = 'view' THEN 'whole' WHEN event_type = 'click' AND k % 2 = 0 THEN 'start' WHEN event_type = 'click' THEN 'end'
         WHEN event_type = 'error' AND k < 50 THEN 'signal' ELSE 'whole' END AS kind,
    CASE WHEN event_type IN ('view', 'click') THEN 'openat' WHEN event_type = 'error' THEN 'clone' WHEN event_type = 'signup' THEN 'execve' ELSE 'connect' END AS call,
    CASE event_type WHEN 'view' THEN k WHEN 'error' THEN pid + 4 * (k % 7) WHEN 'signup' THEN 0 ELSE NULL END AS ret
  FROM ev)"""


@query(
    "strace_oracle_lines",
    o.with_views(_STRACE, """SELECT trace_id, call AS syscall, CASE WHEN kind = 'start' THEN 'cut' ELSE 'closed' END AS form, count(*) AS n, sum(pid) AS pids, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns
    FROM st WHERE kind IN ('whole', 'start') GROUP BY 1, 2, 3"""),
)
def strace_oracle_lines(spark, sf):
    """Closed and cut-off calls of strace text."""
    c = strace.parse_oracle(v.strace_lines(spark, sf))
    form = F.when(F.col("ret") == "?", "cut").otherwise("closed").alias("form")
    return c.groupBy("trace_id", "syscall", form).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )


@query(
    "strace_paired_calls",
    o.with_views(_STRACE + ", ", """p AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN {'l': line, 't': ts_ns, 'k': k} END IGNORE NULLS)
      OVER (PARTITION BY trace_id, pid ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op FROM st WHERE kind IN ('start', 'end')),
  e AS (SELECT *, row_number() OVER (PARTITION BY trace_id, pid, op.l ORDER BY line) AS rn FROM p WHERE kind = 'end' AND op IS NOT NULL)
  SELECT trace_id, line AS seq, pid, ts_ns, call AS event, CASE call WHEN 'openat' THEN '/data/f' || k WHEN 'execve' THEN '/usr/bin/prog' || (k % 5) END AS path,
     CASE WHEN call = 'openat' THEN 0 END AS write_intent, CASE WHEN call = 'connect' THEN CASE WHEN k % 2 = 0 THEN 10 ELSE 2 END END AS family, ret,
     CASE WHEN call = 'execve' THEN 'prog' || (k % 5) || ' -x ' || k END AS argv FROM st WHERE kind = 'whole'
  UNION ALL SELECT trace_id, line, pid, op.t, 'openat', '/tmp/w' || op.k, 1, NULL, k, NULL FROM e WHERE rn = 1"""),
)
def strace_paired_calls(spark, sf):
    """Split calls joined with their starts, and all typed fields."""
    c = strace.parse_paired(v.strace_lines(spark, sf), ["trace_id"])
    return c.select(
        "trace_id", "seq", "pid", "ts_ns", "event", "path", F.col("write_intent").cast("int").alias("write_intent"), "family", "ret",
        F.array_join("argv", " ").alias("argv"),
    )


def _wildcard_lines(spark, sf):
    """T|, F| and BOOT| lines of users' events; errors below k = 10 carry the tracer's name."""
    return v.ev(spark, sf).selectExpr(
        "trace_id", "seq",
        """CASE WHEN event_type = 'signup' AND k >= 90 THEN concat('BOOT|nsecs=', k)
           WHEN event_type = 'signup' THEN concat('F|', ts_ns, '|', pid, '|', pid + 4 * (k % 7), '|ch|ild')
           ELSE concat('T|', ts_ns, '|', CASE event_type WHEN 'view' THEN 257 WHEN 'click' THEN 1 WHEN 'purchase' THEN 900 + k % 3 ELSE 59 END,
                '|', pid, '|', pid * 10, '|', CASE WHEN event_type = 'error' AND k < 10 THEN 'strace' WHEN event_type = 'error' THEN 'python3' ELSE 'no|de' END) END AS value""",
    )


@query(
    "wildcard_trace_counts",
    o.with_views(o.EV + ", ", """t AS (SELECT trace_id, ts_ns, pid AS tgid, CASE event_type WHEN 'view' THEN 'openat' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'sc_' || (900 + k % 3) ELSE 'sc_59' END AS syscall,
     CASE WHEN event_type = 'error' AND k < 10 THEN 'strace' WHEN event_type = 'error' THEN 'python3' ELSE 'no|de' END AS comm FROM ev WHERE event_type <> 'signup'),
  s AS (SELECT trace_id, arg_min(tgid, (ts_ns, tgid)) AS tgid FROM t WHERE comm = 'strace' GROUP BY 1)
  SELECT trace_id, syscall, comm, count(*) AS n FROM t ANTI JOIN s USING (trace_id, tgid) GROUP BY 1, 2, 3"""),
)
def wildcard_trace_counts(spark, sf):
    """Named calls of the wildcard trace without the tracer's first thread group."""
    w = hostlog.parse_wildcard(_wildcard_lines(spark, sf)).filter("kind = 'syscall'")
    named = hostlog.name_calls(subtree.drop_tracer(w, ["trace_id"]))
    return named.groupBy("trace_id", "syscall", "comm").agg(F.count(F.lit(1)).alias("n"))


@query(
    "wildcard_forks_and_boot",
    o.with_views(o.EV, """SELECT trace_id, count(CASE WHEN k < 90 THEN 1 END) AS n_forks, sum(CASE WHEN k < 90 THEN pid + 4 * (k % 7) END) AS children, min(CASE WHEN k >= 90 THEN k END) AS boot_ns
    FROM ev WHERE event_type = 'signup' GROUP BY 1"""),
)
def wildcard_forks_and_boot(spark, sf):
    lines = _wildcard_lines(spark, sf)
    f = hostlog.parse_wildcard(lines).filter("kind = 'fork' AND comm = 'ch|ild'").groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_forks"), F.sum("child").alias("children")
    )
    return f.join(hostlog.boot_offset(lines, ["trace_id"]), "trace_id", "left")


@query(
    "clock_offset_and_marks",
    o.with_views(o.EV + ", ", """m AS (SELECT trace_id, 'm' || (k % 3) AS mark, arg_min(ts_ns, seq) AS mark_ns FROM ev WHERE event_type = 'view' GROUP BY 1, 2),
  w AS (SELECT e.trace_id, arg_min(ts_ns, seq) AS wall FROM ev e JOIN m ON m.trace_id = e.trace_id AND mark = 'm0' WHERE event_type = 'error' AND k % 2 = 0 AND ts_ns > mark_ns GROUP BY 1),
  h AS (SELECT trace_id, arg_min(ts_ns, seq) AS mono FROM ev WHERE event_type = 'error' AND k >= 10 GROUP BY 1)
  SELECT w.trace_id, wall - mono AS offset_ns FROM w JOIN h USING (trace_id)"""),
)
def clock_offset_and_marks(spark, sf):
    """Wall minus monotonic clock from marks and the first matching execs."""
    e = v.ev(spark, sf)
    text = e.filter("event_type = 'view'").selectExpr("trace_id", "seq", "concat('MARK ', ts_ns, ' m', k % 3) AS value")
    mark = hostlog.marks(text, ["trace_id"]).filter("mark = 'm0'")
    orc = e.filter("event_type = 'error' AND k % 2 = 0").selectExpr("trace_id", "seq", "ts_ns", "'execve' AS syscall", "'\"/usr/bin/python3\", [\"python3\"]' AS args_raw")
    host = e.filter("event_type = 'error' AND k >= 10").selectExpr("trace_id", "seq", "ts_ns", "59 AS nr", "'python3' AS comm")
    return fidelity.clock_offset(orc, host, mark, ["trace_id"])


@query(
    "workload_window_counts",
    o.with_views(o.EV + ", ", """b AS (SELECT trace_id, min(ts_ns) + 100000000 AS s, max(ts_ns) - 100000000 AS e FROM ev GROUP BY 1),
  x AS (SELECT ev.trace_id, event_type AS syscall, count(CASE WHEN k % 2 = 0 THEN 1 END) AS strace, count(CASE WHEN k % 3 = 0 THEN 1 END) AS host FROM ev JOIN b USING (trace_id)
     WHERE ts_ns >= s - 20000000 AND ts_ns < e + 20000000 GROUP BY 1, 2)
  SELECT *, host - strace AS delta, CASE WHEN strace > 0 THEN round(host * 1.0 / strace, 6) END AS ratio FROM x WHERE strace + host > 0"""),
)
def workload_window_counts(spark, sf):
    """Calls of two sensors inside the marked window, widened by 20 ms."""
    e = v.ev(spark, sf).withColumnRenamed("event_type", "syscall")
    marks = e.groupBy("trace_id").agg((F.min("ts_ns") + 100_000_000).alias("start_ns"), (F.max("ts_ns") - 100_000_000).alias("end_ns"))
    offsets = marks.select("trace_id", F.lit(0).alias("offset_ns"))
    host = e.filter("k % 3 = 0").selectExpr("trace_id", "ts_ns", "syscall", "pid AS tgid", "'node' AS comm")
    c = fidelity.workload_counts(e.filter("k % 2 = 0").select("trace_id", "ts_ns", "syscall"), host, marks, offsets, ["trace_id"])
    return c.withColumn("ratio", F.round("ratio", 6))


@query(
    "sensor_ratio",
    o.with_views(o.EV + ", ", """x AS (SELECT pid, k, count(CASE WHEN event_type IN ('view', 'click') THEN 1 END) AS a, count(CASE WHEN event_type IN ('click', 'error') THEN 1 END) AS b FROM ev GROUP BY 1, 2)
  SELECT pid, sum(a) AS strace_total, sum(b) AS host_total, CASE WHEN sum(a) > 0 THEN round(sum(b) * 1.0 / sum(a), 6) END AS ratio, count(CASE WHEN b = 0 THEN 1 END) AS only_strace, count(CASE WHEN a = 0 THEN 1 END) AS only_host
  FROM x WHERE a + b > 0 GROUP BY 1"""),
)
def sensor_ratio(spark, sf):
    e = v.ev(spark, sf)
    a = metrics.histogram(e.filter("event_type IN ('view', 'click')"), ["pid"], "k")
    b = metrics.histogram(e.filter("event_type IN ('click', 'error')"), ["pid"], "k")
    c = metrics.compare_counts(a, b, ["pid", "k"], names=("strace", "host"))
    return fidelity.sensor_ratio(c, ["pid"]).withColumn("ratio", F.round("ratio", 6))


@query(
    "one_sided_names",
    o.with_views(o.EV + ", ", """x AS (SELECT pid, 'n' || k AS syscall, count(CASE WHEN event_type = 'view' THEN 1 END) AS a, count(CASE WHEN event_type = 'click' THEN 1 END) AS b FROM ev GROUP BY 1, 2)
  SELECT pid, syscall, CASE WHEN b = 0 THEN 'strace' ELSE 'host' END AS only_in, a + b AS n FROM x WHERE a + b > 0 AND (a = 0 OR b = 0)"""),
)
def one_sided_names(spark, sf):
    e = v.ev(spark, sf).withColumn("syscall", F.concat(F.lit("n"), "k"))
    c = metrics.compare_counts(
        metrics.histogram(e.filter("event_type = 'view'"), ["pid"], "syscall"), metrics.histogram(e.filter("event_type = 'click'"), ["pid"], "syscall"),
        ["pid", "syscall"], names=("strace", "host"))
    return fidelity.one_sided_names(c, ["pid"])


@query(
    "call_cells",
    o.with_views(o.HOST + ", ", """x AS (SELECT trace_id, pid, event, count(*) AS host, count(CASE WHEN k % 3 <> 0 AND event IN ('openat', 'connect', 'sendto', 'recvfrom', 'execve', 'clone', 'unlinkat') THEN 1 END) AS l1 FROM host GROUP BY 1, 2, 3),
  c AS (SELECT event, sum(l1) AS l1, sum(host) AS host FROM x GROUP BY 1) SELECT event, l1, host, CASE WHEN l1 > 0 THEN round(host * 1.0 / l1, 6) END AS ratio FROM c"""),
)
def call_cells(spark, sf):
    """Per-process host and oracle counts, and the corpus ratio per call."""
    h = v.host(spark, sf)
    k = v.ev(spark, sf).select("trace_id", "seq", "k")
    orc = h.join(k, ["trace_id", "seq"]).filter("k % 3 <> 0").select("trace_id", F.col("pid").alias("pid"), F.col("event").alias("syscall"))
    bridge = h.select("trace_id", "pid").distinct().withColumn("tid", F.col("pid"))
    r = fidelity.corpus_ratios(fidelity.call_cells(orc, h, bridge))
    return r.withColumn("ratio", F.round("ratio", 6))


def _bridge_sql(tol_ns: int) -> str:
    """Hosts in order choose the nearest free mark: h (trace_id, id, ts_ns, seq, names), m alike; gives bridge (trace_id, id, mark, gap, ts_ns, seq)."""
    return f"""hn AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, seq) AS n FROM h),
  near AS (SELECT h.trace_id, h.n, list({{'gap': abs(m.ts_ns - h.ts_ns), 'mark': m.id}} ORDER BY abs(m.ts_ns - h.ts_ns), m.ts_ns, m.seq) AS cands
    FROM hn h JOIN m ON m.trace_id = h.trace_id AND abs(m.ts_ns - h.ts_ns) <= {tol_ns} AND list_has_any(m.names, h.names) GROUP BY 1, 2),
  todo AS MATERIALIZED (SELECT hn.*, coalesce(cands, []) AS cands FROM hn LEFT JOIN near USING (trace_id, n)),
  choose AS (SELECT trace_id, 0::BIGINT AS n, []::VARCHAR[] AS used, NULL::VARCHAR AS mark, NULL::BIGINT AS gap FROM (SELECT DISTINCT trace_id FROM h)
    UNION ALL SELECT trace_id, n, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.mark) END, best.mark, best.gap FROM
      (SELECT t.trace_id, t.n, c.used, list_filter(t.cands, lambda x: NOT list_contains(c.used, x.mark))[1] AS best FROM choose c JOIN todo t ON t.trace_id = c.trace_id AND t.n = c.n + 1)),
  bridge AS MATERIALIZED (SELECT hn.trace_id, hn.id, c.mark, c.gap, hn.ts_ns, hn.seq FROM choose c JOIN hn USING (trace_id, n) WHERE c.mark IS NOT NULL)"""


_FIRST_EXECS = """first_execs AS (SELECT trace_id, pid, ts_ns, seq, [split_part(path, '/', -1), split_part(argv[1], '/', -1)] AS names FROM host WHERE event = 'execve'
   QUALIFY row_number() OVER (PARTITION BY trace_id, pid ORDER BY ts_ns, seq) = 1)"""


@query(
    "bridge_by_program",
    o.with_views(o.HOST + ", " + _FIRST_EXECS + """, h AS (SELECT trace_id, CAST(pid AS VARCHAR) AS id, ts_ns, seq, names FROM first_execs),
  m AS (SELECT trace_id, CAST(pid + 1000000 AS VARCHAR) AS id, ts_ns + (pid % 120) * 1000000 AS ts_ns, seq, names FROM first_execs), """ + _bridge_sql(100_000_000),
                 "SELECT trace_id, CAST(id AS BIGINT) AS pid, CAST(mark AS BIGINT) AS tid, gap FROM bridge", recursive=True),
)
def bridge_by_program(spark, sf):
    """Host execs matched to shifted oracle execs (greedy 1:1)."""
    execs = v.host(spark, sf).filter("event = 'execve'").select("trace_id", "pid", "ts_ns", "seq", "path", "argv", "event")
    host = fidelity.host_execs(execs)
    orc = host.select("trace_id", (F.col("pid") + 1_000_000).alias("pid"), (F.col("ts_ns") + (F.col("pid") % 120) * 1_000_000).alias("ts_ns"), "seq", "image", "argv")
    return fidelity.bridge_by_name(orc, host)


@query(
    "bridge_by_time",
    o.with_views(o.HOST + """, h AS (SELECT trace_id, pid || ':' || seq AS id, ts_ns, seq, ['x'] AS names FROM host WHERE event = 'execve'),
  m AS (SELECT trace_id, (pid + 1000000) || ':' || seq AS id, ts_ns + (pid % 60) * 1000000 AS ts_ns, seq, ['x'] AS names FROM host WHERE event = 'execve'), """ + _bridge_sql(50_000_000),
                 "SELECT trace_id, CAST(split_part(id, ':', 1) AS BIGINT) AS pid, CAST(split_part(arg_max(mark, (ts_ns, seq)), ':', 1) AS BIGINT) AS tid FROM bridge GROUP BY 1, 2", recursive=True),
)
def bridge_by_time(spark, sf):
    e = v.host(spark, sf)
    orc = e.filter("event = 'execve'").selectExpr("trace_id", "pid + 1000000 AS pid", "ts_ns + (pid % 60) * 1000000 AS ts_ns", "seq", "'execve' AS syscall")
    return fidelity.bridge_by_time(orc, e)


@query(
    "process_fidelity",
    o.with_views(o.HOST + ", " + _FIRST_EXECS + """, h AS (SELECT trace_id, CAST(pid AS VARCHAR) AS id, ts_ns, seq, names FROM first_execs),
  m AS (SELECT trace_id, CAST(pid + 1000000 AS VARCHAR) AS id, ts_ns + 1000000 AS ts_ns, seq, names FROM first_execs), """ + _bridge_sql(100_000_000) + """,
  pairs AS (SELECT trace_id, CAST(id AS BIGINT) AS pid, CAST(mark AS BIGINT) AS tid FROM bridge),
  o_par AS (SELECT trace_id, child_pid + 1000000 AS child, arg_max(parent_pid, (ts_ns, seq)) + 1000000 AS parent FROM host WHERE event = 'sched_fork' GROUP BY 1, 2),
  cl AS (SELECT *, last_value(CASE WHEN event = 'clone' THEN {'pid': pid, 'ts': ts_ns} END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl,
     row_number() OVER (PARTITION BY trace_id, pid ORDER BY ts_ns, seq) AS rn FROM host),
  forest AS MATERIALIZED (SELECT trace_id, pid, CASE WHEN ts_ns - cl.ts <= 100000000 THEN cl.pid END AS parent FROM cl WHERE rn = 1),
  o_up AS (SELECT e.trace_id, e.pid + 1000000 AS node, p.parent AS cur FROM first_execs e JOIN o_par p ON p.trace_id = e.trace_id AND p.child = e.pid + 1000000
    UNION SELECT u.trace_id, u.node, p.parent FROM o_up u JOIN o_par p ON p.trace_id = u.trace_id AND p.child = u.cur WHERE NOT EXISTS (SELECT 1 FROM first_execs e WHERE e.trace_id = u.trace_id AND e.pid + 1000000 = u.cur)),
  h_up AS (SELECT e.trace_id, e.pid AS node, f.parent AS cur FROM first_execs e JOIN forest f ON f.trace_id = e.trace_id AND f.pid = e.pid WHERE f.parent IS NOT NULL
    UNION SELECT u.trace_id, u.node, f.parent FROM h_up u JOIN forest f ON f.trace_id = u.trace_id AND f.pid = u.cur WHERE f.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM first_execs e WHERE e.trace_id = u.trace_id AND e.pid = u.cur)),
  o_edges AS (SELECT DISTINCT u.trace_id, u.cur AS p, u.node AS c FROM o_up u JOIN first_execs e ON e.trace_id = u.trace_id AND e.pid + 1000000 = u.cur),
  seen AS (SELECT DISTINCT u.trace_id, a.tid AS p, b.tid AS c FROM h_up u JOIN pairs a ON a.trace_id = u.trace_id AND a.pid = u.cur JOIN pairs b ON b.trace_id = u.trace_id AND b.pid = u.node),
  kept AS (SELECT o.* FROM o_edges o WHERE EXISTS (SELECT 1 FROM pairs x WHERE x.trace_id = o.trace_id AND x.tid = o.p) AND EXISTS (SELECT 1 FROM pairs x WHERE x.trace_id = o.trace_id AND x.tid = o.c)),
  edges AS (SELECT k.trace_id, count(*) AS edges_in_l1_subgraph, round(count(s.p) * 1.0 / count(*), 6) AS edge_recall FROM kept k LEFT JOIN seen s ON s.trace_id = k.trace_id AND s.p = k.p AND s.c = k.c GROUP BY 1),
  subs AS (SELECT trace_id, count(*) AS n FROM first_execs GROUP BY 1), met AS (SELECT trace_id, count(*) AS n FROM pairs GROUP BY 1),
  totals AS (SELECT trace_id, count(DISTINCT pid) AS host_pids_total, count(DISTINCT tid) AS host_tids_total, count(*) AS host_events FROM host GROUP BY 1),
  last_exec AS (SELECT trace_id, pid, arg_max(argv, (ts_ns, seq)) AS argv FROM host WHERE event = 'execve' GROUP BY 1, 2),
  roots AS (SELECT e.trace_id, bool_or(contains(argv[1], 'claude') AND f.parent IS NULL) AS host_saw_claude_root, bool_or(contains(argv[1], 'claude')) AS host_saw_claude_anywhere FROM last_exec e JOIN forest f USING (trace_id, pid) GROUP BY 1)""",
                 """SELECT s.trace_id, s.n AS l1_subprocesses, s.n AS host_subprocesses, m.n AS bridged, e.edges_in_l1_subgraph, e.edge_recall, t.host_pids_total, t.host_tids_total, t.host_events,
    r.host_saw_claude_root, r.host_saw_claude_anywhere, round(coalesce(m.n, 0) * 1.0 / s.n, 6) AS subprocess_recall, 1.0 AS subprocess_count_ratio
  FROM subs s LEFT JOIN met m USING (trace_id) LEFT JOIN edges e USING (trace_id) LEFT JOIN totals t USING (trace_id) LEFT JOIN roots r USING (trace_id)""", recursive=True),
)
def process_fidelity(spark, sf):
    """Subprocess and edge recall of a host trace against its shifted copy as oracle."""
    # Landed once: the host's events and both parts of the oracle are made of these rows.
    h = settle(v.host(spark, sf).select("trace_id", "ts_ns", "seq", "pid", "tid", "event", "path", "argv", "parent_pid", "child_pid"))
    ex = fidelity.host_execs(h)
    orc_ex = ex.select("trace_id", (F.col("pid") + 1_000_000).alias("pid"), (F.col("ts_ns") + 1_000_000).alias("ts_ns"), "seq", "image", "argv")
    orc = h.filter("event = 'sched_fork'").selectExpr(
        "trace_id", "ts_ns", "seq", "parent_pid + 1000000 AS pid", "'clone' AS syscall", "CAST(child_pid + 1000000 AS STRING) AS ret")
    f = fidelity.process_fidelity(orc, orc_ex, h)
    return f.withColumn("edge_recall", F.round("edge_recall", 6)).withColumn("subprocess_recall", F.round("subprocess_recall", 6))


# ---- names, frames, tokens -----------------------------------------------------------


@query(
    "server_detection",
    o.with_views(o.HOST + ", ", """reg AS (SELECT trace_id, ts_ns, seq, argv[4] AS name FROM host WHERE event = 'execve' AND argv[2] = 'mcp'),
  ex AS (SELECT h.trace_id, h.seq, argv, (SELECT arg_max(name, (r.ts_ns, r.seq)) FROM reg r WHERE r.trace_id = h.trace_id AND (r.ts_ns, r.seq) <= (h.ts_ns, h.seq)) AS known FROM host h WHERE event = 'execve')
  SELECT trace_id, CASE WHEN argv[1] = '/opt/fs-tool' AND known IS NOT NULL THEN known WHEN argv[1] LIKE '%/mcp-server-%' THEN split_part(argv[1], '/', -1) WHEN argv[1] = 'node' THEN 'chroma-mcp-server.js' ELSE '' END AS label,
    CASE WHEN argv[1] = '/opt/fs-tool' AND known IS NOT NULL THEN 'registered' WHEN argv[1] LIKE '%/mcp-server-%' OR argv[1] = 'node' THEN 'broadened' ELSE '' END AS layer, count(*) AS n FROM ex GROUP BY 1, 2, 3"""),
)
def server_detection(spark, sf):
    """Registered programs as of each exec, else the broadened names."""
    ex = v.host(spark, sf).filter("event = 'execve'").select("trace_id", "seq", "ts_ns", "path", "argv")
    d = detect.layered_servers(ex)
    return d.groupBy("trace_id", F.coalesce("server_label", F.lit("")).alias("label"), F.col("server_layer").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "root_detection_modes",
    o.with_views(o.HOST, """SELECT split_part(coalesce(argv[1], ''), '/', -1) AS program, count(*) AS n, count(CASE WHEN list_contains(argv, '-p') AND split_part(argv[1], '/', -1) = 'claude' THEN 1 END) AS session_root,
    count(CASE WHEN argv[1] LIKE '%mcp-server-%' OR argv[1] = 'node' THEN 1 END) AS strict, count(CASE WHEN argv[1] LIKE '%mcp-server%' THEN 1 END) AS contains_plain FROM host WHERE event = 'execve' GROUP BY 1"""),
)
def root_detection_modes(spark, sf):
    e, p, a = F.col("event"), F.col("path"), F.col("argv")
    x = v.host(spark, sf).filter("event = 'execve'")
    return x.groupBy(F.substring_index(F.coalesce(detect.arg(a, 0), F.lit("")), "/", -1).alias("program")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(detect.session_root(e, p, a)).alias("session_root"),
        F.count(detect.strict_server(e, p, a)).alias("strict"), F.count_if(detect.contains_server(p, a, wrappers=False)).alias("contains_plain"),
    )


@query(
    "rpc_frames",
    o.with_views(o.HOST, """SELECT CASE WHEN k % 2 = 0 THEN 't' || (k % 5) ELSE '' END AS name, CAST(k % 2 = 0 AS INT) AS request, CAST(k % 2 = 1 AS INT) AS reply, count(*) AS n
    FROM host WHERE event = 'sendto' GROUP BY 1, 2, 3"""),
)
def rpc_frames(spark, sf):
    """Requests, replies and tool names in send buffers."""
    s = v.host(spark, sf).filter("event = 'sendto'").withColumn("text", rpc.frame(F.col("buf")))
    t = F.col("text")
    return s.groupBy(
        F.coalesce(rpc.call_name(t), F.lit("")).alias("name"), rpc.is_request(t).cast("int").alias("request"), rpc.is_reply(t).cast("int").alias("reply")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_tokens",
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([A-Za-z0-9_.-]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
  SELECT page_id, host AS hosts, path AS paths FROM u""",
)
def url_tokens(spark, sf):
    """Hosts and paths named in a command line made of each page's URL."""
    u = v.urls(spark, sf).select("page_id", F.array(F.lit("curl"), F.col("url"), F.lit("-x"), F.col("path")).alias("argv"))
    leaf = tokens.leaves(F.col("argv"))
    return u.select("page_id", F.array_join(tokens.host_tokens(leaf), " ").alias("hosts"), F.array_join(tokens.path_tokens(leaf), " ").alias("paths"))


@query(
    "shell_command_tokens",
    """WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
  SELECT host, count(*) AS n, count(DISTINCT path) AS n_paths FROM u GROUP BY 1""",
)
def shell_command_tokens(spark, sf):
    """The same from a quoted shell command inside one argv element."""
    u = v.urls(spark, sf).select("page_id", F.array(F.lit("bash"), F.lit("-c"), F.concat(F.lit("cat '"), "path", F.lit("' && ping "), "host")).alias("argv"))
    leaf = tokens.leaves(F.col("argv"))
    t = u.select(tokens.host_tokens(leaf).alias("h"), tokens.path_tokens(leaf).alias("p"))
    return t.groupBy(F.get("h", F.lit(0)).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get("p", F.lit(0))).alias("n_paths"))


# What a word may hold besides letters: the engines' own word classes differ on accented letters.
_LETTER = r"\p{L}\p{M}\p{N}\p{Pc}"


@query(
    "document_host_tokens",
    rf"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[\x20\x09-\x0D"'']+')) AS w FROM documents),
  u AS (SELECT doc_id, split_part(unnest(regexp_extract_all(w, '(?i)(?:^|[^{_LETTER}])(?:https?|ftps?|wss?|sftp)://([{_LETTER}.\-:]+)', 1)), ':', 1) AS host FROM w WHERE contains(w, '://')),
  h AS (SELECT doc_id, regexp_replace(w, '[,;]+$', '') AS h FROM w WHERE contains(w, '.')),
  o AS (SELECT *, string_split(h, '.') AS p FROM h WHERE contains(h, '.') AND NOT contains(h, '/'))
  SELECT doc_id, host FROM u
  UNION SELECT doc_id, h FROM o WHERE (regexp_matches(h, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') AND len(list_filter(p, lambda x: try_cast(x AS INT) > 255)) = 0)
    OR (regexp_matches(h, '\p{{L}}') AND regexp_matches(h, '^[a-zA-Z0-9]([{_LETTER}.\-]{{0,251}}[{_LETTER}])?$'))""",
)
def document_host_tokens(spark, sf):
    """Addresses and host names, of URLs too, among all words of whole texts."""
    words = v.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"[\x20\x09-\x0D\"']+")).alias("word")).distinct()
    # No host without a dot or a scheme, so other words need no patterns.
    may = words.filter(F.col("word").contains(".") | F.col("word").contains("://"))
    return may.select("doc_id", F.explode(tokens.host_tokens(F.array("word"))).alias("host")).distinct()


@query(
    "sentinel_text_counts",
    """WITH s AS (SELECT source, unnest(['the', lang, 'http']) AS needle, unnest(['write_path', 'cred_path', 'token']) AS field FROM (SELECT source, min(lang) AS lang FROM documents GROUP BY 1))
  SELECT d.source, field, needle, CAST(sum((length(text) - length(replace(text, needle, ''))) // length(needle)) AS BIGINT) AS n FROM documents d JOIN s ON d.source = s.source WHERE field <> 'token' GROUP BY 1, 2, 3""",
)
def sentinel_text_counts(spark, sf):
    """Occurrences of each source's distinctive sentinels in its whole texts."""
    d = v.table(spark, sf, "documents").select("source", "text", "lang")
    s = d.groupBy("source").agg(F.min("lang").alias("lang")).select(
        "source", F.explode(F.array(
            F.struct(F.lit("write_path").alias("field"), F.lit("the").alias("needle")), F.struct(F.lit("cred_path").alias("field"), F.col("lang").alias("needle")),
            F.struct(F.lit("token").alias("field"), F.lit("http").alias("needle")))).alias("x")).select("source", "x.*")
    return selection.sentinel_counts(d, s, ["source"], "text")


@query(
    "raw_line_hits",
    o.with_views(_STRACE, """SELECT trace_id, count(*) AS n_hits FROM st WHERE (event_type = 'view' AND CAST(k AS VARCHAR) LIKE '7%') OR event_type = 'signup' GROUP BY 1"""),
)
def raw_line_hits(spark, sf):
    """Lines that mention a predicate's call name and path text."""
    p = v.ev(spark, sf).select("trace_id").distinct().selectExpr(
        "trace_id", "explode(array(struct('openat' AS syscall, '/data/f7' AS needle), struct('execve' AS syscall, '/usr/bin/prog' AS needle))) AS x"
    ).selectExpr("trace_id", "x.syscall", "x.needle AS path_contains", "CAST(NULL AS STRING) AS path_starts_with")
    return selection.raw_line_hits(v.strace_lines(spark, sf), p, ["trace_id"])


@query(
    "denial_log_summary",
    o.with_views(o.EV, """SELECT pid, max(CASE WHEN event_type = 'view' THEN k END) AS n_intercepted, max(CASE WHEN event_type = 'view' THEN k % 7 END) AS n_denied, count(CASE WHEN event_type IN ('click', 'error') THEN 1 END) AS n_denied_lines FROM ev GROUP BY 1"""),
)
def denial_log_summary(spark, sf):
    from vestige.operators.policy import denial_summary

    e = v.ev(spark, sf).selectExpr(
        "pid", """CASE event_type WHEN 'view' THEN concat('target exited (', k, ' intercepted, ', k % 7, ' denied)') WHEN 'click' THEN concat('openat: /f', k, ' [DENY]')
        WHEN 'error' THEN concat('connect host OUT: 10.0.0.', k) ELSE 'openat: /x [ALLOW]' END AS value""")
    return denial_summary(e, ["pid"])


@query(
    "names_and_keys",
    """SELECT page_id, 'srv' || (page_id % 5) AS server, 'mcp/p' || page_id || '/srv' || (page_id % 5) AS server_id, 'grp__m' || (page_id % 3) || '__s.json' AS file, 'slug:' || page_id AS slug,
   '2:10.0.0.' || (page_id % 9) || ':443' AS sock, 1704067200000000000 + page_id * 1000000000 AS ns, 1704067200123456000 AS hook_ns FROM pages""",
)
def names_and_keys(spark, sf):
    """Server ids, policy file names, attack slugs, socket keys and clocks of page ids."""
    p = v.table(spark, sf, "pages").select("page_id")
    i = F.col("page_id")
    tool = F.concat(F.lit("mcp__srv"), i % 5, F.lit("__do__it"))
    iso = F.date_format(F.timestamp_seconds(i + 1_704_067_200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return p.select(
        "page_id", naming.server_of_tool(tool).alias("server"), naming.server_id(F.concat(F.lit("p"), i), tool).alias("server_id"),
        naming.envelope_file(F.concat(F.lit("grp/m"), i % 3), F.lit("s")).alias("file"),
        naming.attack_slug(F.concat(F.lit("malicious:slug:"), i)).alias("slug"),
        naming.socket_key(F.lit(2), F.concat(F.lit("10.0.0."), i % 9), F.lit(443)).alias("sock"),
        naming.iso_to_ns(iso).alias("ns"), naming.seconds_to_ns(F.lit(1704067200.123456) + i * 0).alias("hook_ns"),
    )


@query(
    "model_answer_json",
    "SELECT page_id, CASE page_id % 4 WHEN 3 THEN '' ELSE '{\"a\": ' || page_id || '}' END AS body FROM pages",
)
def model_answer_json(spark, sf):
    """The JSON object inside differently wrapped model answers."""
    p = v.table(spark, sf, "pages").selectExpr("page_id", """concat('{"a": ', page_id, '}') AS j""")
    t = F.when(F.col("page_id") % 4 == 0, F.col("j")).when(
        F.col("page_id") % 4 == 1, F.concat(F.lit("<think>{x</think>\n```json\n"), "j", F.lit("\n```"))
    ).when(F.col("page_id") % 4 == 2, F.concat(F.lit("Here: "), "j", F.lit(" done"))).otherwise(F.lit("<think> {never closed"))
    return p.select("page_id", F.coalesce(naming.policy_json(t), F.lit("")).alias("body"))


@query(
    "strace_argument_fields",
    o.with_views(o.EV, """SELECT seq, '/d/"' || k AS path, 'a b' || k || ' c' AS argv, CASE WHEN k % 2 = 0 THEN 10 END AS family, CASE WHEN k % 3 = 0 THEN k END AS ret, CAST(k % 2 = 0 AS INT) AS writes FROM ev WHERE event_type = 'view'"""),
)
def strace_argument_fields(spark, sf):
    """Quoted paths with escapes, argv lists, families, return codes, flag words."""
    from vestige.functions.paths import write_by_words

    e = v.ev(spark, sf).filter("event_type = 'view'")
    k = F.col("k")
    a = F.concat(F.lit('"/d/\\"'), k, F.lit('", ["a b'), k, F.lit('", "c"], '), F.when(k % 2 == 0, "sa_family=AF_INET6 O_TRUNC").otherwise("sa_family=AF_VSOCK O_RDONLY"))
    x = e.select("seq", a.alias("a"), F.when(k % 3 == 0, k.cast("string")).otherwise("-1 EINVAL (bad)").alias("r"))
    return x.select(
        "seq", st.first_quoted(F.col("a")).alias("path"), F.array_join(st.argv_list(F.col("a")), " ").alias("argv"), st.family_number(F.col("a")).alias("family"),
        st.return_code(F.col("r")).alias("ret"), write_by_words(F.col("a")).cast("int").alias("writes"),
    )


@query(
    "events_per_minute",
    o.with_views(o.EV, "SELECT event_type, ts_ns // 60000000000 AS minute, count(*) AS n FROM ev GROUP BY 1, 2"),
)
def events_per_minute(spark, sf):
    e = v.ev(spark, sf)
    return e.groupBy("event_type", F.floor(F.col("ts_ns") / MINUTE_NS).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "transcript_ids",
    o.with_views(o.SESSIONS, "SELECT session_id AS session_dir, session_id AS agent_session_id FROM sess"),
)
def transcript_ids(spark, sf):
    """The agent's own session id per transcript."""
    return sessions.agent_session_ids(sessions.parse_transcript(v.transcript_lines(spark, sf)), ["session_dir"])


@query(
    "envelope_documents",
    """SELECT CAST(n_nationkey AS BIGINT) AS policy, CASE WHEN n_nationkey % 5 = 1 THEN 0 ELSE 2 END AS n_reads, CAST(n_nationkey % 2 = 0 AS INT) AS spawn, CAST(n_nationkey % 5 = 2 AS INT) AS matches
   FROM nation WHERE n_nationkey % 5 <> 4""",
)
def envelope_documents(spark, sf):
    """Bare, wrapped, partial and failed policy documents."""
    from vestige.functions import globs

    n = F.col("n_nationkey")
    full = F.concat(F.lit('{"file_ops":{"read_paths":["/n/'), n % 5, F.lit('/*","/m"]},"process":{"allow_spawn":'), (n % 2 == 0).cast("string"), F.lit("}}"))
    part = F.concat(F.lit('{"process":{"allow_spawn":'), (n % 2 == 0).cast("string"), F.lit("}}"))
    doc = F.when(n % 5 == 0, full).when(n % 5 == 1, part).when(n % 5 == 4, '{"_error":"x"}').otherwise(F.concat(F.lit('{"envelope":'), full, F.lit("}")))
    p = sessions.parse_envelopes(v.table(spark, sf, "nation").select(n.cast("bigint").alias("policy"), doc.alias("value")))
    return p.select("policy", F.size("read_paths").alias("n_reads"), F.col("allow_spawn").cast("int").alias("spawn"),
                    globs.matches(F.lit("/n/2/x"), F.col("read_paths_re")).cast("int").alias("matches"))
