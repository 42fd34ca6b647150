"""As-of joins, interval joins, scans and windows on event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.operators import callwindows, graph, metrics, segments, timejoin
from vestige.operators.subtree import strip_counts
from vestige.plans import analyst, corpora
from vestige.workload import oracle as o
from vestige.workload import views as v
from vestige.workload.registry import query


@query(
    "asof_latest_binding",
    o.with_views(o.EV + ", ", """b AS (SELECT trace_id, pid, ts_ns AS at_ns, seq AS bseq, 'b' || seq AS bound FROM ev WHERE event_type = 'signup'),
  j AS (SELECT e.seq, (SELECT arg_max(bound, (at_ns, bseq)) FROM b WHERE b.trace_id = e.trace_id AND b.pid = e.pid AND b.at_ns <= e.ts_ns) AS bound FROM ev e)
  SELECT coalesce(bound, '') AS bound, count(*) AS n, min(seq) AS first_seq FROM j GROUP BY 1"""),
)
def asof_latest_binding(spark, sf):
    """Latest sign-up of the event's user at or before each event."""
    e = v.ev(spark, sf).select("trace_id", "pid", "ts_ns", "seq", "event_type")
    b = e.filter("event_type = 'signup'").select("trace_id", "pid", F.col("ts_ns").alias("at"), F.col("seq").alias("bseq"), F.concat(F.lit("b"), "seq").alias("bound"))
    j = timejoin.asof(e, b, ["trace_id", "pid"], "ts_ns", "at", ["bound"], right_ties=["bseq"])
    return j.groupBy(F.coalesce("bound", F.lit("")).alias("bound")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query(
    "asof_next_purchase",
    o.with_views(o.EV + ", ", """b AS (SELECT pid, ts_ns AS at_ns, seq AS bseq FROM ev WHERE event_type = 'purchase')
  SELECT e.seq, coalesce((SELECT min(at_ns) FROM b WHERE b.pid = e.pid AND b.at_ns >= e.ts_ns), -1) AS next_ns FROM ev e WHERE event_type = 'view'"""),
)
def asof_next_purchase(spark, sf):
    e = v.ev(spark, sf).select("trace_id", "pid", "ts_ns", "seq", "event_type")
    b = e.filter("event_type = 'purchase'").select("trace_id", "pid", F.col("ts_ns").alias("at"))
    j = timejoin.asof(e.filter("event_type = 'view'"), b.withColumn("next_ns", F.col("at")), ["trace_id", "pid"], "ts_ns", "at", ["next_ns"], forward=True)
    return j.select("seq", F.coalesce("next_ns", F.lit(-1)).alias("next_ns"))


@query(
    "interval_first_window",
    o.with_views(o.SPANS + ", ", """j AS (
    SELECT e.seq, arg_min(s.use_id, (s.lo, s.use_id)) AS use_id FROM ev e JOIN spans s
      ON s.pid = e.pid AND e.ts_ns BETWEEN s.lo AND s.hi WHERE e.event_type IN ('view', 'click', 'error') GROUP BY 1)
  SELECT e.seq, coalesce(j.use_id, -1) AS use_id FROM ev e LEFT JOIN j ON e.seq = j.seq WHERE e.event_type IN ('view', 'click', 'error')"""),
)
def interval_first_window(spark, sf):
    """First of the user's overlapping windows that contains each event."""
    e = v.ev(spark, sf).filter("event_type IN ('view', 'click', 'error')").select("trace_id", "pid", "ts_ns", "seq")
    s = v.spans(spark, sf).filter("hi > 0")
    j = timejoin.in_window(e, s, ["trace_id", "pid"], "ts_ns", "lo", "hi", "use_id")
    return j.select("seq", F.coalesce("use_id", F.lit(-1)).alias("use_id"))


@query(
    "interval_open_ended",
    o.with_views(o.WINDOWS + ", ", """j AS (SELECT e.seq, arg_min(w.use_id, (w.lo, w.use_id)) AS use_id FROM ev e JOIN win w
      ON w.pid = e.pid AND e.ts_ns >= w.lo AND (w.hi <= 0 OR e.ts_ns <= w.hi) WHERE e.event_type <> 'purchase' GROUP BY 1)
  SELECT coalesce(use_id, -1) AS use_id, count(*) AS n FROM ev e LEFT JOIN j ON e.seq = j.seq WHERE e.event_type <> 'purchase' GROUP BY 1"""),
)
def interval_open_ended(spark, sf):
    """Events per window where a user's last window is still open."""
    e = v.ev(spark, sf).filter("event_type <> 'purchase'").select("trace_id", "pid", "ts_ns", "seq")
    j = timejoin.in_window(e, v.windows(spark, sf), ["trace_id", "pid"], "ts_ns", "lo", "hi", "use_id")
    return j.groupBy(F.coalesce("use_id", F.lit(-1)).alias("use_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "window_activity_counts",
    o.with_views(o.SPANS, """SELECT s.use_id, (s.hi - s.lo) // 1000000 AS dur_ms,
    count(CASE WHEN e.event_type IN ('view', 'click') THEN 1 END) AS n_file_ops, count(CASE WHEN e.event_type = 'purchase' THEN 1 END) AS n_socket_ops
  FROM spans s LEFT JOIN ev e ON e.pid = s.pid AND e.ts_ns BETWEEN s.lo AND s.hi GROUP BY 1, 2"""),
)
def window_activity_counts(spark, sf):
    """File and socket operations inside every (overlapping) call window."""
    e = v.ev(spark, sf).select("trace_id", "pid", "ts_ns", "event_type")
    s = v.spans(spark, sf).withColumn("__hi", F.greatest("hi", F.lit(1)))
    t = timejoin.window_totals(
        e, s, ["trace_id", "pid"], "ts_ns", "lo", "__hi", ["use_id", "lo", "hi"],
        {"n_file_ops": F.col("event_type").isin("view", "click"), "n_socket_ops": F.col("event_type") == "purchase"},
    )
    return t.select("use_id", F.floor((F.col("hi") - F.col("lo")) / 1_000_000).alias("dur_ms"), "n_file_ops", "n_socket_ops")


@query(
    "window_overlap_pairs",
    o.with_views(o.SPANS + ", ", """r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY lo, use_id) AS p FROM spans),
  n AS (SELECT pid, count(*) AS n_windows FROM spans GROUP BY 1),
  x AS (SELECT a.pid, count(*) AS c FROM r a JOIN r b ON a.pid = b.pid AND a.p < b.p AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1)
  SELECT n.pid, n_windows, n_windows * (n_windows - 1) // 2 AS pairs, coalesce(c, 0) AS overlapping_pairs FROM n LEFT JOIN x ON n.pid = x.pid"""),
)
def window_overlap_pairs(spark, sf):
    return timejoin.overlap_pairs(v.spans(spark, sf), ["pid"], "lo", "hi", "use_id")


@query(
    "window_occupancy",
    o.with_views(o.SPANS + ", ", """s AS (SELECT * FROM spans), h AS (SELECT e.pid, e.seq, bool_or(s.use_id IS NOT NULL) AS hit FROM ev e
      LEFT JOIN s ON s.pid = e.pid AND e.ts_ns BETWEEN s.lo AND s.hi WHERE e.event_type IN ('click', 'error') GROUP BY 1, 2)
  SELECT pid, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS inside, round(count(CASE WHEN hit THEN 1 END) * 1.0 / count(*), 6) AS share FROM h GROUP BY 1"""),
)
def window_occupancy(spark, sf):
    """Share of a user's events inside any window."""
    e = v.ev(spark, sf).filter("event_type IN ('click', 'error')").select("pid", "ts_ns", "seq")
    out = analyst.occupancy(e, v.spans(spark, sf).filter("hi > 0"), ["pid"], "use_id")
    return out.withColumn("share", F.round("share", 6))


@query(
    "scan_last_clone",
    o.with_views(o.HOST, """SELECT e.seq, coalesce(last_value(CASE WHEN event = 'clone' THEN seq END IGNORE NULLS)
     OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS clone_seq FROM host e"""),
)
def scan_last_clone(spark, sf):
    """The clone seen last in the trace before each event."""
    h = v.host(spark, sf).select("trace_id", "ts_ns", "seq", "pid", "event", "cgroup_id")
    return graph.with_last_clone(h).select("seq", F.coalesce("clone.seq", F.lit(-1)).alias("clone_seq"))


@query(
    "clone_window_candidates",
    o.with_views(o.HOST + ", ", """c AS (SELECT *, last_value(CASE WHEN event = 'clone' THEN {'pid': pid, 'ts': ts_ns, 'cg': cgroup_id} END IGNORE NULLS)
     OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl FROM host)
  SELECT seq, pid AS child, cl.pid AS parent FROM c WHERE cl IS NOT NULL AND ts_ns - cl.ts BETWEEN 0 AND 199999999
     AND (cl.cg IS NULL OR cgroup_id IS NULL OR cl.cg = cgroup_id)"""),
)
def clone_window_candidates(spark, sf):
    """Events within 200 ms of the latest clone, same or unknown control group."""
    return graph.clone_candidates(v.host(spark, sf)).select("seq", "child", "parent")


@query(
    "running_totals",
    o.with_views(o.EV, """SELECT seq, sum(k) OVER (PARTITION BY pid ORDER BY ts_ns, seq) AS k_sum,
     count(*) OVER (PARTITION BY pid ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS n FROM ev"""),
)
def running_totals(spark, sf):
    e = v.ev(spark, sf).select("pid", "ts_ns", "seq", "k")
    return analyst.running_activity(e, ["pid"], {"k_sum": F.col("k"), "n": F.lit(1)}).select("seq", "k_sum", "n")


@query(
    "consecutive_call_pairs",
    o.with_views(o.WINDOWS, """SELECT use_id AS call, lead(use_id) OVER (PARTITION BY pid ORDER BY lo, use_id) AS next FROM win
   QUALIFY next IS NOT NULL"""),
)
def consecutive_call_pairs(spark, sf):
    """next_call edges: each purchase with the user's following one."""
    _, nxt = callwindows.call_chains(v.windows(spark, sf), ["pid"], ["lo", "use_id"], "use_id")
    return nxt.select("call", "next")


@query(
    "first_calls",
    o.with_views(o.WINDOWS, "SELECT pid, arg_min(use_id, (lo, use_id)) AS use_id FROM win GROUP BY 1"),
)
def first_calls(spark, sf):
    first, _ = callwindows.call_chains(v.windows(spark, sf), ["pid"], ["lo", "use_id"], "use_id")
    return first.select("pid", "use_id")


@query(
    "thread_disjointness",
    o.with_views(o.SPANS + ", ", """r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY lo, hi, use_id) AS p FROM spans),
  t AS (SELECT DISTINCT r.pid, r.p, e.k % 7 AS tid FROM r JOIN ev e ON e.pid = r.pid AND e.ts_ns BETWEEN r.lo AND r.hi AND r.hi > r.lo),
  a AS (SELECT DISTINCT pid, p FROM t),
  pairs AS (SELECT a.pid, a.p FROM a JOIN a b ON a.pid = b.pid AND b.p = a.p + 1),
  sh AS (SELECT DISTINCT t.pid, t.p FROM t JOIN t u ON t.pid = u.pid AND u.p = t.p + 1 AND t.tid = u.tid)
  SELECT pairs.pid, count(*) AS pairs, count(CASE WHEN sh.p IS NULL THEN 1 END) AS disjoint FROM pairs LEFT JOIN sh ON pairs.pid = sh.pid AND pairs.p = sh.p GROUP BY 1"""),
)
def thread_disjointness(spark, sf):
    """Do consecutive calls use disjoint threads?"""
    e = v.ev(spark, sf).select("pid", "ts_ns", (F.col("k") % 7).alias("tid"))
    return callwindows.consecutive_overlap(e, v.spans(spark, sf), ["pid"])


@query(
    "first_sightings",
    o.with_views(o.HOST, "SELECT trace_id, pid, min(ts_ns) AS ts_ns, arg_min(event, (ts_ns, seq)) AS event FROM host GROUP BY 1, 2"),
)
def first_sightings(spark, sf):
    return graph.first_sightings(v.host(spark, sf)).select("trace_id", "pid", "ts_ns", "event")


@query(
    "time_shifted_counts",
    o.with_views(o.EV + ", ", """s AS (SELECT trace_id, min(ts_ns) AS t0 FROM ev WHERE ts_ns > 0 GROUP BY 1)
  SELECT ev.trace_id, (ts_ns - t0) // 60000000000 AS minute, count(*) AS n FROM ev JOIN s ON ev.trace_id = s.trace_id GROUP BY 1, 2"""),
)
def time_shifted_counts(spark, sf):
    """Every trace rebased to its own first instant, then counted per minute."""
    moved, _ = corpora.rebase(v.ev(spark, sf))
    return moved.groupBy("trace_id", F.floor(F.col("ts_ns") / segments.MINUTE_NS).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "noise_strip_counts",
    o.with_views(o.HOST + ", ", """ex AS (SELECT trace_id, pid, split_part(argv[1], '/', -1) AS base, argv FROM host WHERE event = 'execve'),
  f AS (SELECT trace_id, pid, bool_or(regexp_matches(base, '^(runc(:|$)|containerd|docker-entrypoint|docker-init|strace$|/?bin/sh$)')
              OR (base = 'claude' AND list_contains(argv, 'mcp') AND list_contains(argv, 'add'))) AS noise,
          bool_or((lower(base) = 'claude' AND list_contains(argv, '-p')) OR regexp_matches(lower(base), '^mcp[-_]server[-_]')
              OR (base = 'node' AND len(argv) > 1 AND contains(argv[2], 'mcp-server'))) AS keep FROM ex GROUP BY 1, 2)
  SELECT h.trace_id, count(CASE WHEN f.noise AND NOT f.keep THEN 1 END) AS dropped, count(CASE WHEN coalesce(f.keep OR NOT f.noise, true) THEN 1 END) AS kept
  FROM host h LEFT JOIN f ON h.trace_id = f.trace_id AND h.pid = f.pid GROUP BY 1"""),
)
def noise_strip_counts(spark, sf):
    return strip_counts(v.host(spark, sf), ["trace_id"])


@query(
    "exact_percentiles",
    o.with_views(o.EV + ", ", """r AS (SELECT event_type, k, row_number() OVER (PARTITION BY event_type ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ev)
  SELECT event_type, any_value(n) AS n, max(CASE WHEN i = CAST(floor(0.5 * (n - 1)) AS BIGINT) THEN k END) AS p50_floor,
    max(CASE WHEN i = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN k END) AS p95_floor,
    max(CASE WHEN i = CAST(floor(0.5 * n) AS BIGINT) THEN k END) AS p50_count, max(CASE WHEN i = CAST(floor(0.95 * n) AS BIGINT) THEN k END) AS p95_count FROM r GROUP BY 1"""),
)
def exact_percentiles(spark, sf):
    """Both percentile rules, exactly, per event type."""
    picks = {
        "p50_floor": metrics.percentile_floor(0.5), "p95_floor": metrics.percentile_floor(0.95),
        "p50_count": metrics.percentile_of_count(0.5), "p95_count": metrics.percentile_of_count(0.95),
    }
    return metrics.exact_ranks(v.ev(spark, sf), ["event_type"], "k", picks)


@query(
    "activity_islands",
    o.with_views(o.EV + ", ", """b AS (SELECT trace_id, pid, ts_ns, lag(ts_ns) OVER (PARTITION BY trace_id, pid ORDER BY ts_ns) AS before FROM ev),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts_ns - before > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, pid ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS island FROM b)
  SELECT trace_id, pid, min(ts_ns) AS "start", max(ts_ns) + 3600000000 AS "end", count(*) AS n FROM i GROUP BY trace_id, pid, island"""),
)
def activity_islands(spark, sf):
    """Bursts of each user's events with at most an hour between two."""
    return timejoin.islands(v.ev(spark, sf), ["trace_id", "pid"], "ts_ns", 3_600_000_000)
