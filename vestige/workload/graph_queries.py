"""Process trees, provenance tables and the analyst questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.operators import binding, cohesion, detect, graph, subtree
from vestige.plans import analyst, graph_tables, scoring
from vestige.session import settle
from vestige.workload import oracle as o
from vestige.workload import views as v
from vestige.workload.registry import query

# Fork edges closed over from the server starts (every listed fork, last one per child).
_SERVED = o.FORKS + """, last_fork AS (SELECT trace_id, child AS c, arg_max(parent, (ts_ns, seq)) AS p FROM forks GROUP BY 1, 2)
, starts AS (SELECT trace_id, pid, ts_ns, seq, lower(split_part(argv[1], '/', -1)) AS base, lower(split_part(argv[2], '/', -1)) AS script FROM host WHERE event = 'execve')
, named AS (SELECT *, CASE WHEN regexp_matches(base, '^mcp[-_]server[-_]') THEN base
   WHEN base IN ('node', 'python', 'python3', 'uv', 'uvx') AND contains(script, 'mcp') AND (contains(script, 'server') OR starts_with(script, 'mcp-')) THEN script END AS name FROM starts)
, roots AS (SELECT trace_id, pid, arg_min(name, (ts_ns, seq)) AS name FROM named WHERE name IS NOT NULL GROUP BY 1, 2)
, up AS (
  SELECT trace_id, pid AS node, pid AS cur, 0 AS d FROM host GROUP BY 1, 2
  UNION
  SELECT trace_id, c, c, 0 FROM last_fork
  UNION
  SELECT up.trace_id, up.node, f.p, d + 1 FROM up JOIN last_fork f ON f.trace_id = up.trace_id AND f.c = up.cur
    WHERE d < 200 AND NOT EXISTS (SELECT 1 FROM roots r WHERE r.trace_id = up.trace_id AND r.pid = up.cur))
, served AS (SELECT up.trace_id, up.node AS pid, r.name, d FROM up JOIN roots r ON r.trace_id = up.trace_id AND r.pid = up.cur)"""


def _served(h):
    """(trace_id, pid, mcp): the server subtrees over reported forks, nearest server first."""
    forks = graph.fork_edges(h).groupBy("trace_id", "child").agg(F.max_by("parent", F.struct("ts_ns", "seq")).alias("parent"))
    name = detect.strict_server(F.col("event"), F.col("path"), F.col("argv"))
    starts = h.withColumn("mcp", name).filter("mcp IS NOT NULL")
    roots = starts.groupBy("trace_id", F.col("pid").alias("node")).agg(F.min_by("mcp", F.struct("ts_ns", "seq")).alias("mcp"))
    roots = settle(roots)
    below = graph.descendants(settle(forks), roots.select("trace_id", "node"))
    return below.join(roots.withColumnRenamed("node", "root"), ["trace_id", "root"]).select("trace_id", F.col("node").alias("pid"), "mcp", "depth")


@query(
    "server_touch_set",
    o.with_views(_SERVED + ", " + o.FILES.split("FROM ev)", 1)[1].lstrip(", "), """SELECT name AS mcp, kind, target, count(*) AS n_ops FROM (
    SELECT trace_id, pid, 'file' AS kind, path AS target FROM files UNION ALL SELECT trace_id, pid, 'socket', sock_key FROM socks) e
    JOIN served USING (trace_id, pid) GROUP BY 1, 2, 3""", recursive=True),
)
def server_touch_set(spark, sf):
    """Files and sockets touched below each tool server: start, closure, edges, counts."""
    h = settle(v.host(spark, sf))
    files = graph_tables.file_edges(h).select("trace_id", "pid", F.lit("file").alias("kind"), F.col("path").alias("target"))
    socks = graph_tables.socket_edges(h).select("trace_id", "pid", F.lit("socket").alias("kind"), F.col("sock_key").alias("target"))
    edges = files.unionByName(socks).groupBy("trace_id", "pid", "kind", "target").agg(F.count(F.lit(1)).alias("n"))
    return edges.join(_served(h), ["trace_id", "pid"]).groupBy("mcp", "kind", "target").agg(F.sum("n").alias("n_ops"))


@query(
    "server_subtree_depths",
    o.with_views(_SERVED, "SELECT trace_id, name AS mcp, d AS depth, count(*) AS n FROM served GROUP BY 1, 2, 3", recursive=True),
)
def server_subtree_depths(spark, sf):
    return _served(settle(v.host(spark, sf))).groupBy("trace_id", "mcp", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_parents",
    o.with_views(o.FORKS + ", ", """lf AS (SELECT trace_id, child, arg_max(parent, (ts_ns, seq)) AS parent FROM forks GROUP BY 1, 2),
  c AS (SELECT *, last_value(CASE WHEN event = 'clone' THEN {'pid': pid, 'ts': ts_ns, 'cg': cgroup_id} END IGNORE NULLS)
     OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl FROM host WHERE event <> 'sched_fork'),
  g AS (SELECT trace_id, pid AS child, arg_min(cl.pid, (ts_ns, seq)) AS parent FROM c WHERE cl IS NOT NULL AND ts_ns - cl.ts BETWEEN 0 AND 199999999
     AND (cl.cg IS NULL OR cgroup_id IS NULL OR cl.cg = cgroup_id) GROUP BY 1, 2)
  SELECT trace_id, child, parent FROM (SELECT * FROM lf UNION ALL SELECT * FROM g ANTI JOIN lf USING (trace_id, child)) WHERE parent <> child"""),
)
def label_parents(spark, sf):
    return graph.label_parents(v.host(spark, sf))


@query(
    "inferred_forest",
    o.with_views(o.HOST + ", ", """c AS (SELECT *, last_value(CASE WHEN event = 'clone' THEN {'pid': pid, 'ts': ts_ns} END IGNORE NULLS)
     OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl,
     row_number() OVER (PARTITION BY trace_id, pid ORDER BY ts_ns, seq) AS rn FROM host)
  SELECT trace_id, pid, coalesce(CASE WHEN ts_ns - cl.ts <= 100000000 THEN cl.pid END, -1) AS parent FROM c WHERE rn = 1"""),
)
def inferred_forest(spark, sf):
    return graph.inferred_forest(v.host(spark, sf)).select("trace_id", "pid", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query(
    "heuristic_parent_truth",
    o.with_views(o.FORKS + ", ", """lf AS (SELECT trace_id, child, arg_max(parent, (ts_ns, seq)) AS parent FROM forks GROUP BY 1, 2),
  c AS (SELECT *, last_value(CASE WHEN event = 'clone' THEN {'pid': pid, 'ts': ts_ns, 'cg': cgroup_id} END IGNORE NULLS)
     OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl FROM host),
  g AS (SELECT trace_id, pid AS child, arg_min(cl.pid, (ts_ns, seq)) AS guess FROM c WHERE cl IS NOT NULL AND ts_ns - cl.ts BETWEEN 0 AND 199999999
     AND (cl.cg IS NULL OR cgroup_id IS NULL OR cl.cg = cgroup_id) GROUP BY 1, 2)
  SELECT trace_id, count(*) AS n, count(CASE WHEN guess = parent THEN 1 END) AS correct, count(CASE WHEN guess <> parent THEN 1 END) AS wrong,
    count(CASE WHEN guess IS NULL THEN 1 END) AS no_clone, round(count(CASE WHEN guess = parent THEN 1 END) * 1.0 / count(*), 6) AS share_correct
  FROM lf LEFT JOIN g USING (trace_id, child) GROUP BY 1"""),
)
def heuristic_parent_truth(spark, sf):
    """Clone-window parents against reported forks."""
    h = v.host(spark, sf)
    truth = graph.fork_edges(h).groupBy("trace_id", "child").agg(F.max_by("parent", F.struct("ts_ns", "seq")).alias("parent"))
    guess = graph.clone_candidates(h).groupBy("trace_id", "child").agg(F.min_by("parent", F.struct("ts_ns", "seq")).alias("parent"))
    return scoring.parent_truth(guess, truth, ["trace_id"]).withColumn("share_correct", F.round("share_correct", 6))


@query(
    "descendant_closure",
    o.with_views(o.TREE + ", ", """up AS (SELECT child AS node, child AS cur, 0 AS d FROM tree UNION ALL SELECT 0, 0, 0
    UNION ALL SELECT node, parent, d + 1 FROM up JOIN tree ON tree.child = up.cur WHERE up.cur % 10 <> 7 AND up.cur <> 0)
  SELECT node, cur AS root, d AS depth FROM up WHERE cur % 10 = 7""", recursive=True),
)
def descendant_closure(spark, sf):
    """Every node below a marked node (id ends in 7), with its nearest mark."""
    t = v.tree(spark, sf)
    roots = t.filter("child % 10 = 7").select("trace_id", F.col("child").alias("node"))
    return graph.descendants(t.select("trace_id", "child", "parent"), roots).select("node", "root", "depth")


@query(
    "projected_edges",
    o.with_views(o.TREE + ", ", """s AS (SELECT child AS node FROM tree WHERE event_type = 'signup'),
  up AS (SELECT child AS node, parent AS cur FROM tree JOIN s ON s.node = tree.child
    UNION ALL SELECT up.node, t.parent FROM up JOIN tree t ON t.child = up.cur WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.node = up.cur))
  SELECT cur AS parent, node AS child FROM up WHERE EXISTS (SELECT 1 FROM s WHERE s.node = up.cur)""", recursive=True),
)
def projected_edges(spark, sf):
    """The tree restricted to one kind of node: edges to the nearest proper ancestor kept."""
    from vestige.plans.fidelity import projected_edges as project

    t = v.tree(spark, sf)
    kept = t.filter("event_type = 'signup'").select("trace_id", F.col("child").alias("node"))
    return project(t.select("trace_id", "child", "parent"), kept).select("parent", "child")


@query(
    "time_forward_subtree",
    o.with_views(o.FORKS + ", ", """hop AS (SELECT trace_id, pid AS node, CAST(-1 AS BIGINT) AS at_ns, CAST(-1 AS BIGINT) AS at_seq FROM host
      WHERE event = 'execve' AND split_part(argv[1], '/', -1) = 'claude' AND list_contains(argv, '-p') GROUP BY 1, 2
    UNION SELECT f.trace_id, f.child, f.ts_ns, f.seq FROM hop JOIN forks f ON f.trace_id = hop.trace_id AND f.parent = hop.node AND (f.ts_ns, f.seq) > (hop.at_ns, hop.at_seq))
  SELECT trace_id, node, min(at_ns) AS at_ns FROM hop GROUP BY 1, 2""", recursive=True),
)
def time_forward_subtree(spark, sf):
    """Processes adopted by forks of processes already inside, from every agent start."""
    h = settle(v.host(spark, sf))
    roots = h.filter(detect.session_root(F.col("event"), F.col("path"), F.col("argv"))).select("trace_id", F.col("pid").alias("node")).distinct()
    got = graph.adopted(settle(graph.fork_edges(h)), roots)
    return got.select("trace_id", "node", F.greatest("at_ns", F.lit(-1)).alias("at_ns"))


@query(
    "reachable_pids",
    o.with_views(o.FORKS + ", ", """r AS (SELECT DISTINCT trace_id, pid AS node FROM host WHERE event = 'execve' AND path = '/usr/bin/node'
    UNION SELECT f.trace_id, f.child FROM r JOIN forks f ON f.trace_id = r.trace_id AND f.parent = r.node)
  SELECT trace_id, count(*) AS n, min(node) AS lo, max(node) AS hi, sum(node) AS total FROM r GROUP BY 1""", recursive=True),
)
def reachable_pids(spark, sf):
    h = v.host(spark, sf)
    roots = h.filter("event = 'execve' AND path = '/usr/bin/node'").select("trace_id", F.col("pid").alias("node"))
    got = graph.reachable(settle(graph.fork_edges(h).select("trace_id", "parent", "child").distinct()), roots)
    return got.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum("node").alias("total"))


@query(
    "fork_edges_once",
    o.with_views(o.FORKS, "SELECT trace_id, child, parent, min(ts_ns) AS ts_ns, 'sched_fork' AS via FROM forks GROUP BY 1, 2, 3"),
)
def fork_edges_once(spark, sf):
    e = graph.keep_first_edge(graph.fork_edges(v.host(spark, sf)))
    return e.select("trace_id", "child", "parent", "ts_ns", F.lit("sched_fork").alias("via"))


@query(
    "comm_subtree",
    o.with_views(o.HOST + ", ", """hist AS (SELECT trace_id, pid, count(*) AS n, bool_or(comm IN ('libuv-worker', 'MainThread')) AS di, bool_or(comm IN ('claude', 'sh')) AS an,
     bool_or(comm NOT IN ('libuv-worker', 'MainThread', 'claude', 'sh')) AS own FROM host GROUP BY 1, 2),
  r AS (SELECT trace_id, arg_min(pid, (ts_ns, seq)) AS pid FROM host WHERE event = 'execve' AND comm = 'claude' AND path LIKE '/usr/local/bin/%' GROUP BY 1),
  b AS (SELECT trace_id, arg_max(pid, (n, -pid)) AS pid FROM hist WHERE own GROUP BY 1)
  SELECT trace_id, pid FROM r UNION SELECT trace_id, pid FROM b WHERE trace_id NOT IN (SELECT trace_id FROM r)
  UNION SELECT trace_id, pid FROM hist WHERE di AND NOT an"""),
)
def comm_subtree(spark, sf):
    return subtree.comm_subtree(v.host(spark, sf), ["trace_id"])


@query(
    "session_and_server_bindings",
    o.with_views(o.STATES, "SELECT trace_id, pid, ts_ns, kind, session, server FROM states", recursive=True),
)
def session_and_server_bindings(spark, sf):
    """The binding fixpoint over whole traces."""
    states = binding.bind(settle(v.host(spark, sf)))
    return states.select("trace_id", "pid", "ts_ns", "kind", "session", "server")


@query(
    "attributed_events",
    o.with_views(o.ATTRIBUTED, """, spans AS (SELECT c.trace_id, c.server_key, c.tool_call_id, c.ts_ns AS lo, x.t_close_ns AS hi FROM calls c JOIN closes x USING (trace_id, tool_call_id))
  , told AS (SELECT h.trace_id, h.seq, coalesce(h.session, '') AS session, coalesce(m.mcp_id, '') AS mcp,
      coalesce((SELECT arg_min(s.tool_call_id, (s.lo, s.tool_call_id)) FROM spans s WHERE s.trace_id = h.trace_id AND s.server_key = h.server AND h.ts_ns >= s.lo AND (s.hi <= 0 OR h.ts_ns <= s.hi)), '') AS tool_call
    FROM here h LEFT JOIN mcps m ON m.trace_id = h.trace_id AND m.server_key = h.server)
  SELECT trace_id, session, mcp, tool_call, count(*) AS n FROM told GROUP BY 1, 2, 3, 4""", recursive=True),
)
def attributed_events(spark, sf):
    """Events per session, server and tool call."""
    p = binding.predictions(settle(v.host(spark, sf)), detector="layered", loose_reply=False)
    return p.groupBy("trace_id", "session", "mcp", "tool_call").agg(F.count(F.lit(1)).alias("n"))


@query(
    "graph_session_overview",
    o.with_views(o.STATES, """SELECT r.trace_id, r.label AS session, r.pid AS anchor_pid, r.ts_ns AS t_start_ns,
    (SELECT count(*) FROM mcps m WHERE m.trace_id = r.trace_id AND m.session_id = r.label) AS n_mcps, (SELECT count(*) FROM in_session i WHERE i.trace_id = r.trace_id AND i.session_id = r.label) AS n_descendants
    FROM ops r WHERE r.kind = 'root'""", recursive=True),
)
def graph_session_overview(spark, sf):
    return analyst.session_overview(graph_tables.build(settle(v.host(spark, sf))))


@query(
    "graph_touch_set",
    o.with_views(o.STATES + ", " + o.FILES.split("FROM ev)", 1)[1].lstrip(", "), """SELECT m.name AS mcp, e.kind, e.target, count(*) AS n_ops FROM (
    SELECT trace_id, pid, 'file' AS kind, path AS target FROM files UNION ALL SELECT trace_id, pid, 'socket', sock_key FROM socks) e
    JOIN in_mcp i USING (trace_id, pid) JOIN mcps m USING (trace_id, mcp_id) GROUP BY 1, 2, 3""", recursive=True),
)
def graph_touch_set(spark, sf):
    return analyst.touch_set(graph_tables.build(settle(v.host(spark, sf))))


@query(
    "graph_call_activity",
    o.with_views(o.ATTRIBUTED + ", " + o.FILES.split("FROM ev)", 1)[1].lstrip(", "), """, edges AS (SELECT i.trace_id, i.mcp_id, kind, ts_ns FROM (
    SELECT trace_id, pid, 'file' AS kind, ts_ns FROM files WHERE op <> 'unlink' UNION ALL SELECT trace_id, pid, 'socket', ts_ns FROM socks) e JOIN in_mcp i USING (trace_id, pid))
  SELECT c.trace_id, c.tool_call_id AS tool_call, c.name AS tool_name, c.mcp_id, (x.t_close_ns - c.ts_ns) // 1000000 - CASE WHEN (x.t_close_ns - c.ts_ns) % 1000000 < 0 THEN 1 ELSE 0 END AS dur_ms,
    count(CASE WHEN e.kind = 'file' THEN 1 END) AS n_file_ops, count(CASE WHEN e.kind = 'socket' THEN 1 END) AS n_socket_ops
  FROM calls c JOIN closes x USING (trace_id, tool_call_id) LEFT JOIN edges e ON e.trace_id = c.trace_id AND e.mcp_id = c.mcp_id AND c.ts_ns > 0 AND e.ts_ns >= c.ts_ns AND (x.t_close_ns < 0 OR e.ts_ns <= x.t_close_ns)
  GROUP BY 1, 2, 3, 4, 5""", recursive=True),
)
def graph_call_activity(spark, sf):
    return analyst.call_activity(graph_tables.build(settle(v.host(spark, sf))))


@query(
    "graph_bindings",
    o.with_views(o.STATES, """SELECT trace_id, pid, 'session' AS level, session_id AS id, bound_ns AS bound_at_ts_ns FROM in_session
  UNION ALL SELECT s.trace_id, s.pid, 'mcp', m.mcp_id, min(s.ts_ns) FROM states s JOIN mcps m ON m.trace_id = s.trace_id AND m.server_key = s.server GROUP BY 1, 2, 3, 4""", recursive=True),
)
def graph_bindings(spark, sf):
    """Every session and server that a process was ever bound to, and since when."""
    return analyst.bindings(graph_tables.build(settle(v.host(spark, sf))))


@query(
    "graph_call_list",
    o.with_views(o.ATTRIBUTED, """SELECT c.trace_id, c.tool_call_id, false AS is_builtin, c.ts_ns AS t_open_ns, x.t_close_ns, '' AS iteration_id, c.mcp_id, m.session_id
  FROM calls c JOIN closes x USING (trace_id, tool_call_id) JOIN mcps m ON m.trace_id = c.trace_id AND m.mcp_id = c.mcp_id""", recursive=True),
)
def graph_call_list(spark, sf):
    """All calls with their server and session."""
    return analyst.call_list(graph_tables.build(settle(v.host(spark, sf))))


@query(
    "graph_precise_calls",
    o.with_views(o.ATTRIBUTED, "SELECT trace_id, mcp_id, name, count(*) AS n, min(ts_ns) AS first_ns, count(CASE WHEN t_close_ns < 0 THEN 1 END) AS n_open FROM calls JOIN closes USING (trace_id, tool_call_id) GROUP BY 1, 2, 3", recursive=True),
)
def graph_precise_calls(spark, sf):
    """Calls whose times the sensor saw, per server and tool."""
    c = analyst.precise_calls(graph_tables.build(settle(v.host(spark, sf))))
    return c.groupBy("trace_id", "mcp_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("t_open_ns").alias("first_ns"), F.count_if(F.col("t_close_ns") < 0).alias("n_open"))


@query(
    "graph_session_subgraph",
    o.with_views(o.ATTRIBUTED + ", " + o.FILES.split("FROM ev)", 1)[1].lstrip(", "), """, mine AS (SELECT DISTINCT pid FROM in_session WHERE trace_id = 't1' AND session_id = 'sess_0')
  SELECT 'has_mcp' AS relation, session_id AS source, mcp_id AS target FROM mcps WHERE trace_id = 't1' AND session_id = 'sess_0'
  UNION ALL SELECT 'has_tool_call', c.mcp_id, c.tool_call_id FROM calls c JOIN mcps m ON m.trace_id = c.trace_id AND m.mcp_id = c.mcp_id WHERE c.trace_id = 't1' AND m.session_id = 'sess_0'
  UNION ALL SELECT 'member_of_session', CAST(pid AS VARCHAR), 'sess_0' FROM mine
  UNION ALL SELECT DISTINCT op, CAST(pid AS VARCHAR), path FROM files SEMI JOIN mine USING (pid) WHERE trace_id = 't1' AND op IN ('read', 'write')""", recursive=True),
)
def graph_session_subgraph(spark, sf):
    """All edges around the first session of one trace."""
    return analyst.session_subgraph(graph_tables.build(settle(v.host(spark, sf))), "t1", "sess_0")


@query(
    "graph_orphans_and_cohesion",
    o.with_views(o.STATES + ", " + o.FILES.split("FROM ev)", 1)[1].lstrip(", "), """, seen AS (SELECT trace_id, pid FROM host UNION SELECT trace_id, unnest([parent, child]) FROM forks)
  , touch AS (SELECT DISTINCT i.trace_id, i.session_id, i.pid, target FROM (SELECT trace_id, pid, 'file:' || path AS target FROM files UNION SELECT trace_id, pid, 'socket:' || sock_key FROM socks) t JOIN in_session i USING (trace_id, pid))
  , both_ AS (SELECT trace_id, session_id, target FROM touch GROUP BY 1, 2, 3 HAVING count(*) > 1)
  , score AS (SELECT t.trace_id, t.session_id, t.pid, count(b.target) * 1.0 / count(*) AS score FROM touch t LEFT JOIN both_ b USING (trace_id, session_id, target) GROUP BY 1, 2, 3)
  , exempt AS (SELECT trace_id, session_id, pid FROM in_session SEMI JOIN in_mcp USING (trace_id, pid) UNION SELECT trace_id, label, pid FROM ops WHERE kind = 'root')
  SELECT trace_id, pid, 'orphan' AS why FROM seen ANTI JOIN in_session USING (trace_id, pid)
  UNION ALL SELECT DISTINCT trace_id, pid, 'low_cohesion' FROM score ANTI JOIN exempt USING (trace_id, session_id, pid) WHERE score < 0.1""", recursive=True),
)
def graph_orphans_and_cohesion(spark, sf):
    """Orphan processes, and members with a low cohesion score, per trace."""
    t = graph_tables.build(settle(v.host(spark, sf)))
    orphans = analyst.orphan_processes(t).select("trace_id", "pid", F.lit("orphan").alias("why"))
    low = cohesion.from_graph(t).filter("demoted").select("trace_id", "pid", F.lit("low_cohesion").alias("why")).distinct()
    return orphans.unionByName(low)


@query(
    "agent_partition_sizes",
    o.with_views(o.HOST + """, roots AS (SELECT trace_id, pid, ts_ns, seq, 'session_' || (row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, seq) - 1) AS label FROM host
     WHERE event = 'execve' AND split_part(argv[1], '/', -1) = 'claude' AND list_contains(argv, '-p'))
  , cl AS (SELECT *, last_value(CASE WHEN event = 'clone' THEN pid END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_caller,
       row_number() OVER (PARTITION BY trace_id, pid ORDER BY ts_ns, seq) AS rn FROM host)
  , firsts AS (SELECT trace_id, pid, ts_ns, seq, CASE WHEN event = 'clone' THEN pid ELSE last_caller END AS caller FROM cl WHERE rn = 1 AND seq NOT IN (SELECT seq FROM roots))
  , points AS (SELECT trace_id, pid, ts_ns, seq FROM roots UNION ALL SELECT trace_id, pid, ts_ns, seq FROM firsts)
  , up AS MATERIALIZED (SELECT f.trace_id, f.seq, (SELECT arg_max(p.seq, (p.ts_ns, p.seq)) FROM points p WHERE p.trace_id = f.trace_id AND p.pid = f.caller AND f.caller <> f.pid AND (p.ts_ns, p.seq) < (f.ts_ns, f.seq)) AS up FROM firsts f)
  , chain AS (SELECT seq, up FROM up UNION ALL SELECT c.seq, u.up FROM chain c JOIN up u ON u.seq = c.up)
  , named AS (SELECT trace_id, pid, ts_ns, seq, label FROM roots UNION ALL
       SELECT f.trace_id, f.pid, f.ts_ns, f.seq, coalesce((SELECT max(r.label) FROM chain c JOIN roots r ON r.seq = c.up WHERE c.seq = f.seq), 'preroot') FROM firsts f)
  , now_ AS (SELECT e.trace_id, n.label FROM host e ASOF LEFT JOIN (SELECT *, ts_ns::HUGEINT * 10000000 + seq AS at FROM named) n ON n.trace_id = e.trace_id AND n.pid = e.pid AND n.at <= e.ts_ns::HUGEINT * 10000000 + e.seq)""",
                 "SELECT trace_id, label AS session, count(*) AS n FROM now_ GROUP BY 1, 2", recursive=True),
)
def agent_partition_sizes(spark, sf):
    """Events per agent-root partition."""
    return binding.partition_by_agent(settle(v.host(spark, sf))).groupBy("trace_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cgroup_partition_sizes",
    o.with_views(o.HOST, "SELECT 'cgroup_' || coalesce(CAST(cgroup_id AS VARCHAR), 'none') AS session, count(*) AS n FROM host GROUP BY 1"),
)
def cgroup_partition_sizes(spark, sf):
    return binding.partition_by_cgroup(v.host(spark, sf)).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


# ---- edge tables -------------------------------------------------------------


@query(
    "file_edge_counts",
    o.with_views(o.FILES, "SELECT trace_id, op, path, count(*) AS n, min(ts_ns) AS first_ns FROM files GROUP BY 1, 2, 3"),
)
def file_edge_counts(spark, sf):
    f = graph_tables.file_edges(v.host(spark, sf))
    return f.groupBy("trace_id", "op", "path").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"))


@query(
    "socket_edge_counts",
    o.with_views(o.FILES, "SELECT trace_id, op, sock_key, count(*) AS n, sum(len) AS bytes, sum(CASE WHEN fd = 0 THEN -1 ELSE fd END) AS fds FROM socks GROUP BY 1, 2, 3"),
)
def socket_edge_counts(spark, sf):
    s = graph_tables.socket_edges(v.host(spark, sf), fd_zero_is_missing=True)
    return s.groupBy("trace_id", "op", "sock_key").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"), F.sum("fd").alias("fds"))


@query(
    "session_vertices",
    o.with_views(o.HOST, """SELECT trace_id, 'sess_' || (row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, seq) - 1) AS session_id, pid AS anchor_pid,
    ts_ns AS t_start_ns, array_to_string(argv, ' ') AS argv FROM host WHERE event = 'execve' AND split_part(argv[1], '/', -1) = 'claude' AND list_contains(argv, '-p')"""),
)
def session_vertices(spark, sf):
    return graph_tables.session_rows(v.host(spark, sf)).select("trace_id", "session_id", "anchor_pid", "t_start_ns", "argv")


@query(
    "process_vertices",
    o.with_views(o.FORKS + ", ", """seen AS (SELECT trace_id, pid, ts_ns, seq, 0 AS part, comm, CASE WHEN event = 'execve' THEN array_to_string(argv, ' ') END AS argv FROM host
    UNION ALL SELECT trace_id, unnest([parent, child]), ts_ns, seq, 1, NULL, NULL FROM forks),
  f AS (SELECT trace_id, pid, ts_ns, argv, row_number() OVER (PARTITION BY trace_id, pid ORDER BY ts_ns, seq, part) AS rn FROM seen),
  r AS (SELECT trace_id, pid, arg_max(array_to_string(argv, ' '), (ts_ns, seq)) AS argv FROM host WHERE event = 'execve' AND split_part(argv[1], '/', -1) = 'claude' AND list_contains(argv, '-p') GROUP BY 1, 2)
  SELECT f.trace_id, f.pid, coalesce(r.argv, f.argv, '') AS first_argv, f.ts_ns AS t_first_seen_ns FROM f LEFT JOIN r USING (trace_id, pid) WHERE rn = 1"""),
)
def process_vertices(spark, sf):
    return graph_tables.process_rows(v.host(spark, sf)).select("trace_id", "pid", "first_argv", "t_first_seen_ns")


# ---- analyst questions on the order tables -------------------------------------------

_TOUCH = "t AS (SELECT o_custkey AS session, l_suppkey AS pid, l_partkey AS target, o_orderdate, l_shipdate, l_returnflag, o_orderpriority, o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    "session_overview",
    o.with_views(_TOUCH, """SELECT c_custkey AS session, coalesce(m, 0) AS n_mcps, coalesce(d, 0) AS n_descendants FROM customer
   LEFT JOIN (SELECT session, count(DISTINCT o_orderpriority) AS m, count(DISTINCT pid) AS d FROM t GROUP BY 1) x ON x.session = c_custkey"""),
)
def session_overview(spark, sf):
    """Customers as sessions, priorities as servers, suppliers as processes."""
    t = v.touches(spark, sf)
    one = F.lit("t").alias("trace_id")
    tables = {
        "Session": v.table(spark, sf, "customer").select(one, F.col("c_custkey").alias("session_id"), F.col("c_custkey").alias("anchor_pid"), F.lit(0).alias("t_start_ns")),
        "has_mcp": t.select(one, F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("mcp_id")).distinct(),
        "member_of_session": t.select(one, F.col("o_custkey").alias("session_id"), F.col("l_suppkey").alias("pid")).distinct(),
    }
    return analyst.session_overview(tables).select("session", "n_mcps", "n_descendants")


@query(
    "touch_counts",
    o.with_views(_TOUCH, "SELECT o_orderpriority AS mcp, pid, target, count(*) AS n_ops FROM t GROUP BY 1, 2, 3"),
)
def touch_counts(spark, sf):
    t = v.touches(spark, sf)
    return t.groupBy(F.col("o_orderpriority").alias("mcp"), F.col("l_suppkey").alias("pid"), F.col("l_partkey").alias("target")).agg(F.count(F.lit(1)).alias("n_ops"))


@query(
    "orphan_processes",
    o.with_views(o.FORKS + """, last_fork AS (SELECT trace_id, child AS c, arg_max(parent, (ts_ns, seq)) AS p FROM forks GROUP BY 1, 2)
, roots AS (SELECT DISTINCT trace_id, pid FROM host WHERE event = 'execve' AND split_part(argv[1], '/', -1) = 'claude' AND list_contains(argv, '-p'))
, inside AS (SELECT trace_id, pid FROM roots UNION SELECT i.trace_id, f.c FROM inside i JOIN last_fork f ON f.trace_id = i.trace_id AND f.p = i.pid)
, seen AS (SELECT trace_id, pid FROM host UNION SELECT trace_id, unnest([parent, child]) FROM forks)""", "SELECT trace_id, pid FROM seen ANTI JOIN inside USING (trace_id, pid)", recursive=True),
)
def orphan_processes(spark, sf):
    """Processes below no agent start: every vertex against the whole closure of the starts."""
    h = settle(v.host(spark, sf))
    forks = graph.fork_edges(h).groupBy("trace_id", "child").agg(F.max_by("parent", F.struct("ts_ns", "seq")).alias("parent"))
    roots = h.filter(detect.session_root(F.col("event"), F.col("path"), F.col("argv"))).select("trace_id", F.col("pid").alias("node")).distinct()
    inside = graph.descendants(settle(forks), roots).select("trace_id", F.col("node").alias("pid"))
    tables = {"Process": graph_tables.process_rows(h), "member_of_session": inside}
    return analyst.orphan_processes(tables).select("trace_id", "pid")


@query(
    "cohesion_scores",
    o.with_views(_TOUCH + ", ", """own AS (SELECT DISTINCT session, pid, target FROM t),
  sh AS (SELECT session, target FROM own GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT own.session, own.pid, count(*) AS n_targets, count(sh.target) AS n_shared, round(count(sh.target) * 1.0 / count(*), 6) AS score
  FROM own LEFT JOIN sh USING (session, target) WHERE own.pid % 10 <> 0 GROUP BY 1, 2"""),
)
def cohesion_scores(spark, sf):
    """Overlap of each supplier's parts with the rest of the customer's parts."""
    # Landed: touches, members and exempt ones all come from this join.
    t = settle(v.touches(spark, sf).select("o_custkey", "l_suppkey", "l_partkey"))
    one = F.lit("t").alias("trace_id")
    # A supplier acts once per customer here, so its touches are keyed by both.
    pid = F.struct(F.col("o_custkey").alias("session"), F.col("l_suppkey").alias("pid"))
    touch = t.select(one, pid.alias("pid"), F.col("l_partkey").alias("target"))
    member = t.select(one, F.col("o_custkey").alias("session_id"), pid.alias("pid"))
    exempt = member.filter("pid.pid % 10 = 0").distinct()
    c = cohesion.cohesion(touch, member, exempt, ["trace_id"])
    return c.select(F.col("session_id").alias("session"), "pid.pid", "n_targets", "n_shared", F.round("score", 6).alias("score"))


@query(
    "credential_forward_trace",
    o.with_views(o.FILES + ", ", """r AS (SELECT trace_id, pid, min(ts_ns) AS read_ns FROM files WHERE op = 'read' AND regexp_matches(path, '^/etc/p1') GROUP BY 1, 2),
  later AS (SELECT trace_id, pid, ts_ns, op, path AS target FROM files WHERE op = 'write' UNION ALL SELECT trace_id, pid, ts_ns, op, sock_key FROM socks WHERE op = 'connect')
  SELECT later.trace_id, later.pid, op, target, count(*) AS n FROM later JOIN r USING (trace_id, pid) WHERE ts_ns > read_ns GROUP BY 1, 2, 3, 4"""),
)
def credential_forward_trace(spark, sf):
    """Writes and connects after a process first read a credential path."""
    h = v.host(spark, sf)
    f, s = graph_tables.file_edges(h), graph_tables.socket_edges(h)
    later = f.filter("op = 'write'").select("trace_id", "pid", "ts_ns", "op", F.col("path").alias("target")).unionByName(
        s.filter("op = 'connect'").select("trace_id", "pid", "ts_ns", "op", F.col("sock_key").alias("target")))
    out = analyst.credential_trace(f.filter("op = 'read'"), later, "^/etc/p1")
    return out.groupBy("trace_id", "pid", "op", "target").agg(F.count(F.lit(1)).alias("n"))
