"""Clustering scores, comparisons, selections, and the agent layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.operators import callwindows, metrics, selection
from vestige.plans import agent_layer, analyst, corpora, fidelity, scoring
from vestige.session import settle
from vestige.sources import sessions as src
from vestige.workload import oracle as o
from vestige.workload import views as v
from vestige.workload.registry import query

_ROUND = "tp fp fn n_scored n_classes_true n_classes_pred".split()


def _ari_sql(views: str, table: str) -> str:
    """Adjusted Rand index over ``table`` (g, t, p)."""
    return o.with_views(views + ", ", f"""c AS (SELECT g, t, p, count(*) AS n FROM {table} GROUP BY 1, 2, 3),
  s AS (SELECT g, sum(n * (n - 1) / 2.0) AS c, sum(n) AS n FROM c GROUP BY 1),
  a AS (SELECT g, sum(n * (n - 1) / 2.0) AS a FROM (SELECT g, t, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
  b AS (SELECT g, sum(n * (n - 1) / 2.0) AS b FROM (SELECT g, p, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
  SELECT g, n AS n_events, round(CASE WHEN (a + b) / 2 = a * b / (n * (n - 1) / 2.0) THEN NULL ELSE (c - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2.0)) END, 6) AS ari
  FROM s JOIN a USING (g) JOIN b USING (g)""")


@query("rand_index_event_hours", _ari_sql(o.EV, "(SELECT pid % 10 AS g, event_type AS t, CASE WHEN k % 7 = 0 THEN '' ELSE 'h' || (ts_ns // 60000000000 % 24) END AS p FROM ev)"))
def rand_index_event_hours(spark, sf):
    e = v.ev(spark, sf).select((F.col("pid") % 10).alias("g"), F.col("event_type").alias("t"),
                               F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit("h"), F.floor(F.col("ts_ns") / 60_000_000_000) % 24)).alias("p"))
    return metrics.rand_index(metrics.contingency(e, ["g"], "t", "p"), ["g"]).withColumn("ari", F.round("ari", 6))


@query(
    "label_contingency",
    "SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p, count(*) AS n, min(doc_id) AS first FROM labels GROUP BY 1, 2",
)
def label_contingency(spark, sf):
    return metrics.contingency(v.table(spark, sf, "labels"), [], "quality", "toxic", "doc_id")


# Greedy choice over a two-by-two table in closed form: the best cell, then its diagonal partner.
_TWO_CLASS = """lab AS (SELECT doc_id % 5 AS g, 'q' || quality AS t, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 't' || toxic END AS p, doc_id FROM labels),
  c AS (SELECT g, t, p, count(*) AS n, min(doc_id) AS first FROM lab GROUP BY 1, 2, 3),
  best AS (SELECT g, p, t FROM c WHERE p <> '' QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, first, p, t) = 1),
  second AS (SELECT c.g, c.p, c.t FROM c JOIN best b ON c.g = b.g AND c.p <> b.p AND c.t <> b.t WHERE c.p <> ''),
  m AS (SELECT * FROM best UNION ALL SELECT * FROM second),
  j AS (SELECT c.g, c.t, c.p, c.n, coalesce(m.t, '') AS mapped FROM c LEFT JOIN m ON m.g = c.g AND m.p = c.p),
  r AS (SELECT g, coalesce(sum(CASE WHEN mapped = t THEN n END), 0) AS tp, coalesce(sum(CASE WHEN p <> '' AND mapped <> t THEN n END), 0) AS fp,
    coalesce(sum(CASE WHEN p = '' OR mapped <> t THEN n END), 0) AS fn, sum(n) AS n_scored, count(DISTINCT t) AS n_classes_true, count(DISTINCT CASE WHEN p <> '' THEN p END) AS n_classes_pred FROM j GROUP BY 1)"""


def _many_class_sql(views: str, table: str, by: str) -> str:
    """Scores of any number of classes over ``table`` (by.., t, p, o), greedy choice by an ordered walk; '' may be mapped."""
    return o.with_views(views, f""", x AS MATERIALIZED (SELECT {by}, t, p, count(*) AS n, min(o) AS first FROM ({table}) GROUP BY ALL),
  g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, first, p, t) AS r FROM x WHERE t <> '' OR p <> ''),
  pick AS (SELECT {by}, 0::BIGINT AS r, []::VARCHAR[] AS ps, []::VARCHAR[] AS ts, false AS took FROM (SELECT DISTINCT {by} FROM g)
    UNION ALL SELECT {by}, g.r, CASE WHEN free THEN list_append(ps, p) ELSE ps END, CASE WHEN free THEN list_append(ts, t) ELSE ts END, free FROM
      (SELECT k.ps, k.ts, g.*, NOT list_contains(k.ps, g.p) AND NOT list_contains(k.ts, g.t) AS free FROM pick k JOIN g USING ({by}) WHERE g.r = k.r + 1) g),
  m AS (SELECT {by}, p, t AS mapped FROM g SEMI JOIN (SELECT * FROM pick WHERE took) USING ({by}, r)),
  j AS (SELECT x.*, coalesce(mapped, '') AS mapped FROM x LEFT JOIN m USING ({by}, p)),
  s AS (SELECT {by}, coalesce(sum(CASE WHEN t <> '' AND mapped = t THEN n END), 0)::BIGINT AS tp, coalesce(sum(CASE WHEN NOT (t <> '' AND mapped = t) AND p <> '' AND mapped <> t THEN n END), 0)::BIGINT AS fp,
    coalesce(sum(CASE WHEN t <> '' AND (p = '' OR mapped <> t) THEN n END), 0)::BIGINT AS fn, coalesce(sum(CASE WHEN t <> '' THEN n END), 0)::BIGINT AS n_scored,
    count(DISTINCT CASE WHEN t <> '' THEN t END) AS n_classes_true, count(DISTINCT CASE WHEN p <> '' THEN p END) AS n_classes_pred, sum(n)::BIGINT AS n_events, sum(n * (n - 1) / 2.0) AS c FROM j GROUP BY {by}),
  a AS (SELECT {by}, sum(n * (n - 1) / 2.0) AS a FROM (SELECT {by}, t, sum(n) AS n FROM x GROUP BY ALL) GROUP BY {by}),
  b AS (SELECT {by}, sum(n * (n - 1) / 2.0) AS b FROM (SELECT {by}, p, sum(n) AS n FROM x GROUP BY ALL) GROUP BY {by}),
  q AS (SELECT *, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS pr, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS re, CASE WHEN n_events >= 2 THEN a * b / (n_events * (n_events - 1) / 2.0) ELSE 0.0 END AS e FROM s JOIN a USING ({by}) JOIN b USING ({by}))
  SELECT {by}, tp, fp, fn, n_scored, n_classes_true, n_classes_pred, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1,
    round(CASE WHEN (a + b) / 2 = e THEN 1.0 ELSE (c - e) / ((a + b) / 2 - e) END, 6) AS ari, n_events FROM q""", recursive=True)


def _rounded(scores):
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "ari") if c in scores.columns})


@query(
    "cluster_scores_labels",
    o.with_views(_TWO_CLASS, "SELECT g, tp, fp, fn, n_scored, n_classes_true, n_classes_pred, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM r"),
)
def cluster_scores_labels(spark, sf):
    """Mapped precision / recall / F1 of one label column against the other."""
    s = _label_scores(spark, sf)
    return s.select("g", *_ROUND, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _label_scores(spark, sf):
    lab = v.table(spark, sf, "labels").select(
        (F.col("doc_id") % 5).alias("g"), F.concat(F.lit("q"), "quality").alias("t"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("t"), "toxic")).alias("p"), "doc_id")
    return metrics.cluster_scores(lab, ["g"], "t", "p", order="doc_id")


@query(
    "trial_summary",
    o.with_views(_TWO_CLASS, """SELECT CAST(min(0) AS BIGINT) AS half, count(*) AS n_trials, round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS f1_mean, round(min(2.0 * tp / (2 * tp + fp + fn)), 6) AS f1_min,
     round(max(2.0 * tp / (2 * tp + fp + fn)), 6) AS f1_max FROM r"""),
)
def trial_summary(spark, sf):
    s = _label_scores(spark, sf).withColumn("half", F.lit(0).cast("bigint"))
    t = metrics.trial_summary(s, ["half"])
    return t.select("half", "n_trials", *[F.round(c, 6).alias(c) for c in ("f1_mean", "f1_min", "f1_max")])


@query(
    "cluster_scores_sessions",
    _many_class_sql(o.EV, "SELECT trace_id, CAST(pid AS VARCHAR) AS t, CAST(ts_ns // 60000000000 AS VARCHAR) AS p, seq AS o FROM ev", "trace_id"),
)
def cluster_scores_sessions(spark, sf):
    """Many classes: event users against minutes, per trace (greedy map in rounds)."""
    e = v.ev(spark, sf).select("trace_id", "seq", F.col("pid").cast("string").alias("t"), F.floor(F.col("ts_ns") / 60_000_000_000).cast("string").alias("p"))
    return _rounded(metrics.cluster_scores(e, ["trace_id"], "t", "p", order="seq", mode="compat"))


@query(
    "count_compare",
    o.with_views(o.EV, """SELECT pid, k AS event, count(CASE WHEN event_type = 'view' THEN 1 END) AS l1, count(CASE WHEN event_type = 'click' THEN 1 END) AS host,
    count(CASE WHEN event_type = 'click' THEN 1 END) - count(CASE WHEN event_type = 'view' THEN 1 END) AS delta FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1, 2"""),
)
def count_compare(spark, sf):
    """Full outer compare of two count tables."""
    e = v.ev(spark, sf).select("pid", F.col("k").alias("event"), "event_type")
    a = metrics.histogram(e.filter("event_type = 'view'"), ["pid"])
    b = metrics.histogram(e.filter("event_type = 'click'"), ["pid"])
    return metrics.compare_counts(a, b, ["pid", "event"], names=("l1", "host")).drop("ratio")


@query(
    "prediction_agreement",
    o.with_views(o.EV + ", ", """x AS (SELECT unnest(['session', 'mcp']) AS level, unnest([CASE WHEN k % 5 = 0 THEN '' ELSE 's' || (k % 3) END, 'm' || (k % 2)]) AS l,
     unnest([CASE WHEN k % 7 = 0 THEN '' ELSE 's' || (k % 4) END, CASE WHEN k % 3 = 0 THEN '' ELSE 'm' || (k % 2) END]) AS r FROM ev)
  SELECT level, count(CASE WHEN l = r THEN 1 END) AS match, count(CASE WHEN l <> '' AND r <> '' AND l <> r THEN 1 END) AS mismatch, count(CASE WHEN l <> '' AND r = '' THEN 1 END) AS left_only,
    count(CASE WHEN l = '' AND r <> '' THEN 1 END) AS right_only FROM x GROUP BY 1"""),
)
def prediction_agreement(spark, sf):
    e = v.ev(spark, sf)
    a = e.selectExpr("trace_id", "seq", "CASE WHEN k % 5 = 0 THEN '' ELSE concat('s', k % 3) END AS session", "concat('m', k % 2) AS mcp")
    b = e.selectExpr("trace_id", "seq", "CASE WHEN k % 7 = 0 THEN '' ELSE concat('s', k % 4) END AS session", "CASE WHEN k % 3 = 0 THEN '' ELSE concat('m', k % 2) END AS mcp")
    return metrics.agreement(a, b, ["trace_id", "seq"], ["session", "mcp"])


@query(
    "event_histogram",
    o.with_views(o.HOST, "SELECT trace_id, pid, event, count(*) AS n FROM host GROUP BY 1, 2, 3"),
)
def event_histogram(spark, sf):
    return metrics.histogram(v.host(spark, sf), ["trace_id", "pid"])


@query(
    "top_paths",
    o.with_views(o.HOST, """SELECT trace_id, path, count(*) AS n, row_number() OVER (PARTITION BY trace_id ORDER BY count(*) DESC, path) AS rank FROM host WHERE path IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 15"""),
)
def top_paths(spark, sf):
    """The 15 most used paths per trace."""
    return metrics.top_counts(v.host(spark, sf).filter("path IS NOT NULL"), "path", 15, ["trace_id"])


@query(
    "host_totals",
    o.with_views(o.HOST, "SELECT trace_id, count(DISTINCT pid) AS pids, count(DISTINCT tid) AS tids, count(*) AS n FROM host GROUP BY 1"),
)
def host_totals(spark, sf):
    h = v.host(spark, sf)
    return h.groupBy("trace_id").agg(F.count_distinct("pid").alias("pids"), F.count_distinct("tid").alias("tids"), F.count(F.lit(1)).alias("n"))


# ---- hooks and calls ---------------------------------------------------------------


@query(
    "tight_windows",
    o.with_views(o.HOOKS, "SELECT session_id, use_id, lo, hi FROM tight WHERE lo IS NOT NULL AND hi IS NOT NULL"),
)
def tight_windows(spark, sf):
    h = src.clean_hooks(v.hooks(spark, sf))
    return callwindows.tight_windows(h, ["session_id"]).select("session_id", "use_id", "lo", "hi")


@query(
    "orphan_tool_starts",
    o.with_views(o.HOOKS, "SELECT session_id, use_id, ts_ns AS lo FROM hooks h WHERE hook = 'PreToolUse' AND NOT EXISTS (SELECT 1 FROM hooks p WHERE p.session_id = h.session_id AND p.use_id = h.use_id AND p.hook = 'PostToolUse')"),
)
def orphan_tool_starts(spark, sf):
    return callwindows.orphan_starts(src.clean_hooks(v.hooks(spark, sf)), ["session_id"])


@query(
    "per_call_scores",
    o.with_views(o.HOOKS + ", ", """gt AS (SELECT session_id, use_id, lo, hi FROM tight WHERE lo IS NOT NULL AND hi IS NOT NULL), orph AS (SELECT session_id, use_id, lo FROM tight WHERE lo IS NOT NULL AND hi IS NULL),
  pred AS (SELECT session_id, use_id, min(lo) - 1000000 AS o, max(CASE WHEN use_id LIKE '%3' THEN -1 ELSE lo + 5000000000 END) AS c FROM tight WHERE lo IS NOT NULL AND use_id NOT LIKE '%7' GROUP BY 1, 2
     UNION ALL SELECT session_id, use_id || 'x', hi, hi + 5 FROM tight WHERE lo IS NULL),
  all_ids AS (SELECT session_id, use_id, lo, hi, false AS orphan FROM gt UNION ALL SELECT session_id, use_id, lo, NULL, true FROM orph),
  j AS (SELECT coalesce(a.session_id, p.session_id) AS session_id, CASE WHEN a.use_id IS NULL THEN 'extra' WHEN p.use_id IS NULL THEN 'missed' WHEN orphan THEN 'matched_orphan' ELSE 'matched' END AS status,
     NOT orphan AND p.use_id IS NOT NULL AND o > 0 AND o <= lo AND (c <= 0 OR c >= hi) AS cov FROM all_ids a FULL JOIN pred p ON a.session_id = p.session_id AND a.use_id = p.use_id)
  SELECT session_id, count(CASE WHEN status <> 'extra' THEN 1 END) AS n_truth, count(CASE WHEN status = 'matched' THEN 1 END) AS n_matched, count(CASE WHEN status = 'matched_orphan' THEN 1 END) AS n_matched_orphan,
    count(CASE WHEN status = 'missed' THEN 1 END) AS n_missed, count(CASE WHEN status = 'extra' THEN 1 END) AS n_extra, count(CASE WHEN cov THEN 1 END) AS n_covers FROM j GROUP BY 1"""),
)
def per_call_scores(spark, sf):
    """Matched, missed, extra and covered calls per session."""
    h = src.clean_hooks(v.hooks(spark, sf))
    by = ["session_id"]
    tight = callwindows.tight_windows(h, by)
    first = h.filter("hook = 'PreToolUse'").groupBy("session_id", F.col("tool_use_id").alias("use_id")).agg(F.max("ts_ns").alias("lo"))
    orphans = callwindows.orphan_starts(h, by).groupBy("session_id", "use_id").agg(F.max("lo").alias("lo"))
    pred = first.filter("use_id NOT LIKE '%7'").selectExpr(
        "session_id", "use_id AS tool_call_id", "lo - 1000000 AS t_open_ns", "CASE WHEN use_id LIKE '%3' THEN -1 ELSE lo + 5000000000 END AS t_close_ns")
    ends = h.filter("hook = 'PostToolUse'").groupBy("session_id", F.col("tool_use_id").alias("use_id")).agg(F.min("ts_ns").alias("hi"))
    extra = ends.join(first, ["session_id", "use_id"], "left_anti").selectExpr("session_id", "concat(use_id, 'x') AS tool_call_id", "hi AS t_open_ns", "hi + 5 AS t_close_ns")
    rows = scoring.per_call(tight, orphans, pred.unionByName(extra), by)
    t = scoring.call_totals(rows, by)
    return t.drop("identification", "timing_coverage", "precision")


def _agent(spark, sf):
    t = src.parse_transcript(v.transcript_lines(spark, sf))
    return agent_layer.from_transcript(v.sessions(spark, sf), t)


@query(
    "transcript_tool_calls",
    o.with_views(o.SESSIONS, """SELECT u.session_id, u.use_id AS tool_call_id, u.name, CAST(u.name = 'Bash' AS INT) AS is_builtin, u.at_ns AS t_open_ns, coalesce(r.at_ns, s.t_end_ns) AS t_close_ns,
    CAST(coalesce(r.is_error, true) AS INT) AS is_error, CASE WHEN u.name = 'Bash' THEN '' ELSE 'mcp/' || u.session_id || '/srv' || (u.conv_id % 5) END AS mcp_id
  FROM uses u JOIN sess s USING (session_id) LEFT JOIN results r ON r.session_id = u.session_id AND r.use_id = u.use_id"""),
)
def transcript_tool_calls(spark, sf):
    """Tool calls of transcripts: results close them, orphans end with the session."""
    c = _agent(spark, sf)["ToolCall"]
    return c.select("session_id", "tool_call_id", "name", F.col("is_builtin").cast("int").alias("is_builtin"), "t_open_ns", "t_close_ns", F.col("is_error").cast("int").alias("is_error"), "mcp_id")


@query(
    "transcript_outcomes",
    o.with_views(o.SESSIONS + ", ", """f AS (SELECT session_id, text FROM convo WHERE turn = last AND role = 'assistant')
  SELECT s.session_id, CASE WHEN f.session_id IS NULL THEN 'crash' WHEN length(f.text) % 7 = 0 THEN 'error' WHEN length(f.text) % 3 = 0 THEN 'max_turns' ELSE 'clean' END AS terminator_status,
    CASE WHEN f.session_id IS NULL THEN 'terminated' WHEN length(f.text) > 0 THEN 'responded' ELSE 'silent' END AS outcome, coalesce(length(f.text), 0) AS n_response, length(s.prompt) AS n_prompt
  FROM sess s LEFT JOIN f USING (session_id)"""),
)
def transcript_outcomes(spark, sf):
    a = _agent(spark, sf)
    r = a["Response"].select("session_id", F.length("text").alias("n_response"))
    p = a["Prompt"].select("session_id", F.length("text").alias("n_prompt"))
    return a["Session"].join(a["Iteration"].select("session_id", "outcome"), "session_id").join(r, "session_id", "left").join(p, "session_id").select(
        "session_id", "terminator_status", "outcome", F.coalesce("n_response", F.lit(0)).alias("n_response"), "n_prompt")


@query(
    "advertised_tools",
    o.with_views(o.SESSIONS, "SELECT session_id, session_id || '/' || name AS tool_key, CAST(name = 'Bash' AS INT) AS is_builtin FROM sess, unnest(['Bash', 'mcp__srv' || (conv_id % 5) || '__run']) AS x(name)"),
)
def advertised_tools(spark, sf):
    t = _agent(spark, sf)["Tool"]
    return t.select("session_id", "tool_key", F.col("is_builtin").cast("int").alias("is_builtin"))


@query(
    "iteration_transcripts",
    o.with_views(o.SESSIONS + ", ", """n AS (SELECT session_id, count(*) AS n FROM uses GROUP BY 1)
  SELECT 'iter/' || s.session_id || '/0' AS iteration_id, length(prompt) AS n_prompt, coalesce(n, 0) AS n_calls FROM sess s LEFT JOIN n USING (session_id)"""),
)
def iteration_transcripts(spark, sf):
    a = _agent(spark, sf)
    t = analyst.iteration_transcript(a["Iteration"], a["Prompt"], a["Response"], a["ToolCall"], ["session_id"])
    return t.select("iteration_id", F.length("prompt").alias("n_prompt"), "n_calls")


@query(
    "loose_windows",
    o.with_views(o.SESSIONS + ", ", """p AS (SELECT u.session_id, u.use_id, u.turn, r.at_ns AS hi FROM uses u JOIN results r ON r.session_id = u.session_id AND r.use_id = u.use_id)
  SELECT session_id, use_id, coalesce((SELECT max(q.hi) FROM p q WHERE q.session_id = p.session_id AND q.turn < p.turn), hi - 10000000000) AS lo, hi FROM p"""),
)
def loose_windows(spark, sf):
    """Windows from the previous result to this call's result."""
    c = callwindows.content_rows(src.parse_transcript(v.transcript_lines(spark, sf)), ["session_id"])
    return callwindows.loose_windows(c, ["session_id"]).select("session_id", "use_id", "lo", "hi")


@query(
    "use_result_pairs",
    o.with_views(o.SESSIONS, "SELECT u.session_id, u.use_id, u.turn * 3 + 1 AS use_rec, r.turn * 3 + 1 AS result_rec FROM uses u LEFT JOIN results r ON r.session_id = u.session_id AND r.use_id = u.use_id"),
)
def use_result_pairs(spark, sf):
    c = callwindows.content_rows(src.parse_transcript(v.transcript_lines(spark, sf)), ["session_id"])
    return callwindows.use_result_pairs(c, ["session_id"]).select("session_id", "use_id", "use_rec", "result_rec")


@query(
    "hook_tool_calls",
    o.with_views(o.HOOKS + ", ", """pre AS (SELECT session_id, use_id, max(ts_ns) AS o, arg_max(tool_name, ts_ns) AS name FROM hooks WHERE hook = 'PreToolUse' GROUP BY 1, 2),
  post AS (SELECT h.session_id, h.use_id, max(h.ts_ns) AS c FROM hooks h JOIN pre p ON p.session_id = h.session_id AND p.use_id = h.use_id WHERE hook = 'PostToolUse' AND h.ts_ns >= p.o GROUP BY 1, 2)
  SELECT session_id, use_id AS tool_call_id, name, o AS t_open_ns, coalesce(c, 999999999999999999) AS t_close_ns FROM pre LEFT JOIN post USING (session_id, use_id)"""),
)
def hook_tool_calls(spark, sf):
    """Calls, times and names from hook events alone."""
    h = src.clean_hooks(v.hooks(spark, sf))
    s = h.select("session_id").distinct().selectExpr("session_id", "'' AS prompt", "0L AS t_start_ns", "999999999999999999L AS t_end_ns")
    none = spark.createDataFrame([], "session_id string, seq bigint, type string, subtype string, tools array<string>, terminal_reason string, stop_reason string, is_error boolean, result string")
    c = agent_layer.from_hooks(s, none, h)["ToolCall"]
    return c.select("session_id", "tool_call_id", "name", "t_open_ns", "t_close_ns")


# ---- corpora and selection ---------------------------------------------------------


def _captures(spark, sf):
    """Documents as captured sessions: source is the server, language the prompt."""
    return v.table(spark, sf, "documents").selectExpr(
        "concat('d', doc_id) AS session_id", "source AS mcp", "lang AS prompt",
        "CASE WHEN doc_id % 3 = 0 THEN 'benign' ELSE concat('malicious:a', doc_id % 4) END AS variant",
        "CASE WHEN doc_id % 2 = 0 THEN 'malicious_fired' ELSE 'none' END AS gold_label", "concat('c', doc_id % 5) AS category", "n_chars",
    )


_CAP = """cap AS (SELECT 'd' || doc_id AS session_id, source AS mcp, lang AS prompt, CASE WHEN doc_id % 3 = 0 THEN 'benign' ELSE 'malicious:a' || (doc_id % 4) END AS variant,
    CASE WHEN doc_id % 2 = 0 THEN 'malicious_fired' ELSE 'none' END AS gold_label, 'c' || (doc_id % 5) AS category, n_chars FROM documents)"""


@query(
    "envelope_keys",
    o.with_views(_CAP, """SELECT mcp, prompt, count(CASE WHEN variant = 'benign' THEN 1 END) AS n_benign_sessions, count(CASE WHEN variant <> 'benign' AND gold_label = 'malicious_fired' THEN 1 END) AS n_fired_sessions,
    min(CASE WHEN variant = 'benign' THEN session_id END) AS representative FROM cap GROUP BY 1, 2 HAVING count(CASE WHEN variant = 'benign' THEN 1 END) > 0 AND count(CASE WHEN variant <> 'benign' AND gold_label = 'malicious_fired' THEN 1 END) > 0"""),
)
def envelope_keys(spark, sf):
    return selection.envelope_keys(_captures(spark, sf)).select("mcp", "prompt", "n_benign_sessions", "n_fired_sessions", "representative")


@query(
    "session_pairs",
    o.with_views(_CAP + ", ", """b AS (SELECT mcp, prompt, min(session_id) AS benign_session_id FROM cap WHERE variant = 'benign' GROUP BY 1, 2)
  SELECT mcp, prompt, benign_session_id, session_id AS malicious_session_id, split_part(variant, ':', 2) AS attack_slug FROM cap JOIN b USING (mcp, prompt) WHERE variant <> 'benign' AND gold_label = 'malicious_fired'"""),
)
def session_pairs(spark, sf):
    return selection.session_pairs(_captures(spark, sf)).select("mcp", "prompt", "benign_session_id", "malicious_session_id", "attack_slug")


@query(
    "pairs_with_policies",
    o.with_views(_CAP + ", ", """b AS (SELECT mcp, prompt, min(session_id) AS bs FROM cap WHERE variant = 'benign' GROUP BY 1, 2)
  SELECT CASE WHEN prompt = 'en' THEN 'envelope_missing' WHEN session_id LIKE '%4' THEN 'session_missing' ELSE 'ok' END AS status, count(*) AS n FROM cap JOIN b USING (mcp, prompt) WHERE variant <> 'benign' AND gold_label = 'malicious_fired' GROUP BY 1"""),
)
def pairs_with_policies(spark, sf):
    c = _captures(spark, sf)
    policies = c.filter("prompt <> 'en'").select("mcp", "prompt").distinct()
    have = c.filter("session_id NOT LIKE '%4'")
    p = selection.pair_policies(selection.session_pairs(c), policies, ["mcp", "prompt"], have)
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "diverse_pick",
    o.with_views(_CAP + ", ", """r AS (SELECT *, row_number() OVER (PARTITION BY category, mcp ORDER BY n_chars DESC, session_id) AS rn FROM cap)
  SELECT session_id, category, mcp FROM r ORDER BY rn > 1, n_chars DESC, session_id LIMIT 60"""),
)
def diverse_pick(spark, sf):
    """A report of 60: the strongest per (category, server) first, then the strongest rest."""
    return selection.diverse_pick(_captures(spark, sf), 60, "n_chars", ["category", "mcp"], "session_id").select("session_id", "category", "mcp")


@query(
    "capped_pick",
    o.with_views(_CAP + ", ", """r AS (SELECT *, row_number() OVER (PARTITION BY category, mcp ORDER BY n_chars DESC, session_id) AS rn FROM cap)
  SELECT session_id, category, mcp FROM r WHERE rn <= 2 ORDER BY n_chars DESC, session_id LIMIT 30"""),
)
def capped_pick(spark, sf):
    return selection.diverse_pick(_captures(spark, sf), 30, "n_chars", ["category", "mcp"], "session_id", cap=2).select("session_id", "category", "mcp")


@query(
    "novelty_pick",
    o.with_views(_CAP + ", ", """r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_chars DESC, session_id) AS c, row_number() OVER (PARTITION BY mcp ORDER BY n_chars DESC, session_id) AS m FROM cap)
  SELECT session_id FROM r ORDER BY NOT (c = 1 OR m = 1), n_chars DESC, session_id LIMIT 20"""),
)
def novelty_pick(spark, sf):
    return selection.novelty_pick(_captures(spark, sf), 20, "n_chars", "category", "mcp", "session_id").select("session_id")


@query(
    "first_paired_prompts",
    o.with_views(_CAP, "SELECT mcp, min(prompt) AS prompt FROM (SELECT mcp, prompt FROM cap GROUP BY 1, 2 HAVING bool_or(variant = 'benign') AND bool_or(variant <> 'benign')) GROUP BY 1"),
)
def first_paired_prompts(spark, sf):
    return selection.first_paired_prompt(_captures(spark, sf))


@query(
    "trial_sample",
    o.with_views(_CAP + ", ", """draws AS (SELECT mcp, session_id, unnest(range(10)) AS trial FROM cap),
  one AS (SELECT *, row_number() OVER (PARTITION BY trial, mcp ORDER BY md5('42|' || trial || '|s|' || session_id), session_id) AS r FROM draws),
  m AS (SELECT mcp, session_id, trial, row_number() OVER (PARTITION BY trial ORDER BY md5('42|' || trial || '|m|' || mcp), mcp) AS r FROM one WHERE r = 1)
  SELECT mcp, session_id, trial FROM m WHERE r <= 3"""),
)
def trial_sample(spark, sf):
    """Ten seeded trials of three distinct servers."""
    return selection.trial_sample(_captures(spark, sf), 10, 3)


# True classes from the forest of last forks and first clones, predicted ones from the ordered walk.
_LABELLED = o.ATTRIBUTED.replace("CASE WHEN argv[1] = '/opt/fs-tool' AND known IS NOT NULL THEN known WHEN argv", "CASE WHEN argv").replace(
    "event = 'sendto' AND k % 2 = 1 AND k BETWEEN 40", "event = 'sendto' AND k BETWEEN 40") + """
, last_fork AS (SELECT trace_id, child, arg_max(parent, (ts_ns, seq)) AS parent FROM forks GROUP BY 1, 2)
, near2 AS (SELECT *, last_value(CASE WHEN event = 'clone' THEN {'pid': pid, 'ts': ts_ns, 'cg': cgroup_id} END IGNORE NULLS)
     OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl FROM host WHERE event <> 'sched_fork')
, guess AS (SELECT trace_id, pid AS child, arg_min(cl.pid, (ts_ns, seq)) AS parent FROM near2 WHERE cl IS NOT NULL AND ts_ns - cl.ts BETWEEN 0 AND 199999999
     AND (cl.cg IS NULL OR cgroup_id IS NULL OR cl.cg = cgroup_id) GROUP BY 1, 2)
, parents AS MATERIALIZED (SELECT trace_id, child, parent FROM (SELECT * FROM last_fork UNION ALL SELECT * FROM guess ANTI JOIN last_fork USING (trace_id, child)) WHERE parent <> child)
, true_session AS (SELECT DISTINCT trace_id, pid FROM ops WHERE kind = 'root' UNION SELECT i.trace_id, p.child FROM true_session i JOIN parents p ON p.trace_id = i.trace_id AND p.parent = i.pid)
, true_server AS (SELECT DISTINCT trace_id, pid FROM ex WHERE (argv[1] = '/opt/fs-tool' AND known IS NOT NULL) OR argv[1] LIKE '%/mcp-server-%' OR argv[1] = 'node'
    UNION SELECT i.trace_id, p.child FROM true_server i JOIN parents p ON p.trace_id = i.trace_id AND p.parent = i.pid)
, true_windows AS MATERIALIZED (SELECT trace_id, 'u' || seq AS use_id, ts_ns AS lo, ts_ns + k * 1000000000 AS hi FROM ev WHERE event_type = 'purchase')
, windows_of AS (SELECT c.trace_id, c.server_key, c.tool_call_id, c.ts_ns AS lo, x.t_close_ns AS hi FROM calls c JOIN closes x USING (trace_id, tool_call_id))
, told AS MATERIALIZED (SELECT h.trace_id, h.ts_ns,
    CASE WHEN s.pid IS NOT NULL THEN 'cap_' || h.trace_id ELSE '' END AS ts, CASE WHEN m.pid IS NOT NULL THEN 'm_' || h.trace_id ELSE '' END AS tm,
    CASE WHEN m.pid IS NOT NULL THEN coalesce((SELECT arg_min(w.use_id, (w.lo, w.use_id)) FROM true_windows w WHERE w.trace_id = h.trace_id AND h.ts_ns >= w.lo AND (w.hi <= 0 OR h.ts_ns <= w.hi)), '') ELSE '' END AS tc,
    coalesce(h.session, '') AS ps, coalesce(c.mcp_id, '') AS pm,
    coalesce((SELECT arg_min(w.tool_call_id, (w.lo, w.tool_call_id)) FROM windows_of w WHERE w.trace_id = h.trace_id AND w.server_key = h.server AND h.ts_ns >= w.lo AND (w.hi <= 0 OR h.ts_ns <= w.hi)), '') AS pc
  FROM here h LEFT JOIN mcps c ON c.trace_id = h.trace_id AND c.server_key = h.server
  LEFT JOIN true_session s ON s.trace_id = h.trace_id AND s.pid = h.pid LEFT JOIN true_server m ON m.trace_id = h.trace_id AND m.pid = h.pid)"""


@query(
    "labelled_merge_scores",
    _many_class_sql(_LABELLED, """SELECT trace_id, 'session' AS level, ts AS t, ps AS p, ts_ns AS o FROM told UNION ALL SELECT trace_id, 'mcp', tm, pm, ts_ns FROM told
    UNION ALL SELECT trace_id, 'tool_call', tc, pc, ts_ns FROM told""", "trace_id, level"),
)
def labelled_merge_scores(spark, sf):
    """Truth labels, merge into trials, predictions, scores per level: the whole pipeline."""
    h = settle(v.host(spark, sf))
    meta = h.select("trace_id").distinct().selectExpr("trace_id", "concat('cap_', trace_id) AS session_id", "concat('m_', trace_id) AS mcp")
    windows = v.spans(spark, sf).selectExpr("trace_id", "concat('u', use_id) AS use_id", "lo", "hi")
    labelled = corpora.label(h, meta, windows)
    return _rounded(scoring.run_trials(labelled, mode="compat"))


@query(
    "stress_concat_counts",
    o.with_views(o.HOST, "SELECT trace_id AS src_session, 'stress' AS trace_id, 999999 AS cgroup_id, count(*) AS n FROM host GROUP BY 1"),
)
def stress_concat_counts(spark, sf):
    s = corpora.stress_concat(v.host(spark, sf))
    return s.groupBy("src_session", "trace_id", "cgroup_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "call_ambiguity",
    o.with_views(o.SPANS + ", ", """w AS (SELECT * FROM spans),
  x AS (SELECT w.trace_id, w.use_id, count(DISTINCT e.pid) AS n_host_pids, count(DISTINCT CASE WHEN e.pid % 3 = 0 THEN e.pid END) AS n_server_pids FROM w LEFT JOIN ev e ON e.trace_id = w.trace_id AND e.ts_ns BETWEEN w.lo AND w.hi GROUP BY 1, 2)
  SELECT trace_id, count(*) AS n_calls, round(avg(CASE WHEN n_server_pids > 1 THEN 1.0 ELSE 0.0 END), 6) AS ambiguous_share, round(avg(CASE WHEN n_server_pids = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_server_share FROM x GROUP BY 1"""),
)
def call_ambiguity(spark, sf):
    """Calls whose window shows more than one server process, or none."""
    e = v.ev(spark, sf).select("trace_id", "pid", "ts_ns", (F.col("pid") * 10).alias("tid"))
    w = v.spans(spark, sf)
    served = e.filter("pid % 3 = 0").select("trace_id", "pid").distinct()
    r = fidelity.ambiguity_rates(fidelity.call_ambiguity(e, w, served, ["trace_id"]), ["trace_id"])
    return r.withColumn("ambiguous_share", F.round("ambiguous_share", 6)).withColumn("no_server_share", F.round("no_server_share", 6))
