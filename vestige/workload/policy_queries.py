"""Policy decisions, coverage, rejection, sentinels, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.functions import globs, paths
from vestige.operators import policy, subtree
from vestige.plans import audit, evaluation
from vestige.workload import oracle as o
from vestige.workload import views as v
from vestige.workload.registry import query


def _reasons(mode, noise_floor):
    def run(spark, sf):
        d = policy.decide(v.policed(spark, sf), mode, noise_floor=noise_floor)
        return d.groupBy("policy", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))

    return run


def _reasons_sql(**kw):
    return o.with_views(o.POLICED + ", ", f"""d AS (SELECT n AS policy, {o.v1_reason(**kw)} AS reason FROM policed)
  SELECT policy, reason, count(*) AS n, count(CASE WHEN {o.OK_REASON} THEN 1 END) AS n_ok FROM d GROUP BY 1, 2""")


query("decide_v1", _reasons_sql())(_reasons("v1", False))
query("decide_v1_noise_floor", _reasons_sql(noise_floor=True))(_reasons("v1", True))
query("decide_v2_dotfiles", _reasons_sql(dotfile=True))(_reasons("v2", False))
query("decide_full_corpus", _reasons_sql(noise_floor=True, prefix=""))(_reasons("full", True))
query("decide_v6a_argv", _reasons_sql(noise_floor=True, argv=True, prefix="").replace(
    "argv[1] = 'ls' AND NOT (n % 2 = 0 OR false)",
    "argv[1] = 'ls' AND NOT (n % 2 = 0 OR argv[3] LIKE '/data/p' || (n % 10) || '/%')"))(_reasons("v6a", True))


@query(
    "decide_subtree_v3",
    o.with_views(o.POLICED + ", ", f"""hist AS (SELECT trace_id, pid, bool_or(comm IN ('libuv-worker', 'MainThread')) AS di, bool_or(comm IN ('claude', 'sh')) AS an FROM host GROUP BY 1, 2),
  d AS (SELECT p.trace_id, {o.v1_reason()} AS reason FROM policed p JOIN hist USING (trace_id, pid) WHERE di AND NOT an)
  SELECT trace_id, reason, count(*) AS n FROM d GROUP BY 1, 2"""),
)
def decide_subtree_v3(spark, sf):
    """The first rule on worker-thread processes only."""
    e = v.policed(spark, sf)
    inside = subtree.comm_history(v.host(spark, sf), ["trace_id"]).filter("has_distinctive AND NOT has_ancestor").select("trace_id", "pid")
    return policy.reasons(policy.decide(e.join(inside, ["trace_id", "pid"], "left_semi"), "v3"), ["trace_id"])


_SUPER = o.with_views(o.POLICED + ", ", """first_exec AS (SELECT trace_id, arg_min(seq, (ts_ns, seq)) AS seq FROM host WHERE event = 'execve' GROUP BY 1),
  d AS (SELECT n AS policy, CASE
    WHEN event = 'openat' AND (flags & 3) IN (1, 2) THEN CASE WHEN write_listed THEN 'write_ok' ELSE 'write_out_of_envelope' END
    WHEN event = 'openat' AND noise THEN 'noise_floor_read'
    WHEN event = 'openat' THEN CASE WHEN path LIKE '/data/p' || (n % 10) || '/%' THEN 'read_ok' ELSE 'read_out_of_envelope' END
    WHEN event = 'unlinkat' THEN CASE WHEN delete_listed THEN 'unlink_ok' ELSE 'unlink_out_of_envelope' END
    WHEN event = 'execve' AND p.seq = f.seq THEN 'launch'
    WHEN event = 'execve' AND NOT allow_spawn THEN 'execve_denied_no_spawn'
    WHEN event = 'execve' AND NOT binary_listed THEN 'execve_binary_not_allowed'
    WHEN event = 'execve' AND argv[1] = 'ls' AND n % 2 <> 0 THEN 'execve_argv_path_out'
    WHEN event = 'execve' AND argv[1] = 'node' THEN 'execve_argv_path_out'
    WHEN event = 'execve' THEN 'execve_ok'
    WHEN event IN ('connect', 'sendto') AND NOT allow_egress THEN 'denied_no_egress'
    WHEN event IN ('connect', 'sendto') AND family NOT IN (2, 10) THEN 'no_address'
    WHEN event IN ('connect', 'sendto') AND daddr = '10.0.0.' || (n % 8) THEN 'host_ok'
    WHEN event IN ('connect', 'sendto') THEN 'host_out_of_envelope' ELSE 'pass' END AS reason
    FROM policed p LEFT JOIN first_exec f USING (trace_id))
  SELECT policy, reason, count(*) AS n FROM d GROUP BY 1, 2""")


@query("supervisor_replay", _SUPER)
def supervisor_replay(spark, sf):
    """The inline supervisor's rule over recorded events."""
    return policy.reasons(policy.decide(v.policed(spark, sf, "supervisor"), "supervisor"), ["policy"])


@query(
    "policy_coverage",
    o.with_views(o.POLICED + ", ", f"""d AS (SELECT trace_id, pid, n AS policy, {o.v1_reason(noise_floor=True, prefix='')} AS reason FROM policed
     WHERE event IN ('openat', 'unlinkat', 'execve', 'connect', 'sendto')),
  c AS (SELECT trace_id, pid, policy, count(*) AS total, count(CASE WHEN {o.OK_REASON} THEN 1 END) AS inside FROM d GROUP BY 1, 2, 3)
  SELECT *, total - inside AS outside, round(inside * 1.0 / total, 6) AS coverage FROM c"""),
)
def policy_coverage(spark, sf):
    """Share of each process's security-relevant events inside its policy."""
    e = v.policed(spark, sf).filter(F.col("event").isin(*policy.SECURITY_EVENTS))
    c = policy.coverage(policy.decide(e, "full", noise_floor=True), ["trace_id", "pid", "policy"])
    return c.withColumn("coverage", F.round("coverage", 6))


@query(
    "coverage_distribution",
    o.with_views(o.POLICED + ", ", f"""d AS (SELECT pid, region, n AS policy, {o.v1_reason(noise_floor=True, prefix='')} AS reason FROM policed
     WHERE event IN ('openat', 'unlinkat', 'execve', 'connect', 'sendto')),
  c AS (SELECT pid, region, count(CASE WHEN {o.OK_REASON} THEN 1 END) * 1.0 / count(*) AS cov FROM d GROUP BY 1, 2)
  SELECT region, count(*) AS n, round(avg(cov), 6) AS mean, round(median(cov), 6) AS median, round(min(cov), 6) AS min,
    round(avg(CASE WHEN cov >= 0.75 THEN 1.0 ELSE 0.0 END), 6) AS share_ge_75 FROM c GROUP BY 1"""),
)
def coverage_distribution(spark, sf):
    e = v.policed(spark, sf).filter(F.col("event").isin(*policy.SECURITY_EVENTS))
    c = policy.coverage(policy.decide(e, "full", noise_floor=True), ["pid", "region"])
    d = audit.coverage_distribution(c, ["region"])
    return d.select("region", "n", *[F.round(x, 6).alias(x) for x in ("mean", "median", "min", "share_ge_75")])


@query(
    "benign_write_denials",
    o.with_views(o.POLICED + ", ", f"""d AS (SELECT n AS policy, event, write_intent, {o.v1_reason(dotfile=True)} AS reason FROM policed)
  SELECT policy, count(CASE WHEN event = 'openat' AND write_intent THEN 1 END) AS n_writes,
    count(CASE WHEN event = 'openat' AND write_intent AND NOT {o.OK_REASON} THEN 1 END) AS write_fp,
    count(CASE WHEN reason = 'write_denied_dotfile_in_scratch' THEN 1 END) AS dotfile_denials FROM d GROUP BY 1"""),
)
def benign_write_denials(spark, sf):
    return evaluation.benign_denials(policy.decide(v.policed(spark, sf), "v2"), ["policy"])


@query(
    "subtree_volume_impact",
    o.with_views(o.HOST + ", ", """hist AS (SELECT trace_id, pid, bool_or(comm IN ('libuv-worker', 'MainThread')) AND NOT bool_or(comm IN ('claude', 'sh')) AS ins FROM host GROUP BY 1, 2)
  SELECT trace_id, count(*) AS n_full, count(CASE WHEN ins THEN 1 END) AS n_subtree, round(count(CASE WHEN ins THEN 1 END) * 1.0 / count(*), 6) AS ratio
  FROM host JOIN hist USING (trace_id, pid) GROUP BY 1"""),
)
def subtree_volume_impact(spark, sf):
    h = v.host(spark, sf)
    inside = subtree.comm_history(h, ["trace_id"]).filter("has_distinctive AND NOT has_ancestor").select("trace_id", "pid")
    return evaluation.subtree_impact(h, inside, ["trace_id"]).withColumn("ratio", F.round("ratio", 6))


# Signatures by policy key: two leaves, the second under a not.
def _signatures(spark, sf):
    n = F.col("n_nationkey")
    return v.table(spark, sf, "nation").select(
        n.cast("bigint").alias("policy"),
        F.concat(
            F.lit('{"any":[{"kind":"l1_syscall","syscall":"openat","path_starts_with":"/tmp/mcp-'), n % 5,
            F.lit('/"},{"all":[{"kind":"text"},{"not":{"kind":"l1_syscall","syscall":"unlinkat","path_contains":"p'), n % 10, F.lit('"}}]}]}'),
        ).alias("predicates"),
    )


def _leaves(spark, sf):
    from vestige.sources.sessions import signature_predicates

    return signature_predicates(_signatures(spark, sf), "policy")


@query(
    "signature_leaves",
    """SELECT CAST(n_nationkey AS BIGINT) AS policy, 'openat' AS syscall, '/tmp/mcp-' || (n_nationkey % 5) || '/' AS needle, 0 AS negated FROM nation
  UNION ALL SELECT n_nationkey, 'unlinkat', 'p' || (n_nationkey % 10), 1 FROM nation""",
)
def signature_leaves(spark, sf):
    """Nested any/all/not trees flattened to their leaves."""
    return _leaves(spark, sf).select(
        "policy", "syscall", F.coalesce("path_contains", "path_starts_with").alias("needle"), F.col("negated").cast("int").alias("negated")
    )


_HITS = """hits AS (SELECT *, CASE WHEN event = 'openat' THEN path LIKE '/tmp/mcp-' || (n % 5) || '/%' WHEN event = 'unlinkat' THEN contains(path, 'p' || (n % 10)) ELSE false END AS hit FROM policed)"""


@query(
    "signature_rejection",
    o.with_views(o.POLICED + ", " + _HITS + ", ", f"""d AS (SELECT n AS policy, pid, ts_ns, seq, {o.v1_reason(noise_floor=True, prefix='')} AS reason FROM hits WHERE hit)
  SELECT policy, pid, count(*) AS n_sig_matches, count(CASE WHEN NOT {o.OK_REASON} THEN 1 END) AS n_rejected,
    round(count(CASE WHEN NOT {o.OK_REASON} THEN 1 END) * 1.0 / count(*), 6) AS rejection_rate,
    CAST(arg_min(NOT {o.OK_REASON}, (ts_ns, seq)) AS INT) AS first_hit_rejected,
    CAST(bool_or(NOT {o.OK_REASON}) AS INT) AS any_hit_rejected, CAST(bool_and(NOT {o.OK_REASON}) AS INT) AS all_hits_rejected FROM d GROUP BY 1, 2"""),
)
def signature_rejection(spark, sf):
    """Of the events that fit a process's signature, how many does its policy reject?"""
    d = policy.decide(v.policed(spark, sf), "full", noise_floor=True)
    hits = policy.match_signatures(d, _leaves(spark, sf), "policy")
    r = policy.rejection(hits, ["policy", "pid"]).withColumn("rejection_rate", F.round("rejection_rate", 6))
    for c in ("first_hit_rejected", "any_hit_rejected", "all_hits_rejected"):
        r = r.withColumn(c, F.col(c).cast("int"))
    return r


def _pairs(spark, sf):
    """Per process: coverage and rejection, flagged and grouped for the summaries."""
    e = policy.decide(v.policed(spark, sf), "full", noise_floor=True)
    cov = policy.coverage(e.filter(F.col("event").isin(*policy.SECURITY_EVENTS)), ["policy", "pid"])
    rej = policy.rejection(policy.match_signatures(e, _leaves(spark, sf), "policy"), ["policy", "pid"])
    out = cov.join(rej, ["policy", "pid"], "left").fillna(0, ["n_sig_matches", "n_rejected"])
    return out.withColumn("is_ace_bi", F.col("pid") % 3 == 0).withColumn("category", F.concat(F.lit("c"), F.col("policy") % 6))


_PAIRS = o.POLICED + ", " + _HITS + f""", d AS (SELECT n AS policy, pid, event, hit, ts_ns, seq, {o.v1_reason(noise_floor=True, prefix='')} AS reason FROM hits),
  cov AS (SELECT policy, pid, count(CASE WHEN {o.OK_REASON} THEN 1 END) * 1.0 / count(*) AS coverage FROM d WHERE event IN ('openat', 'unlinkat', 'execve', 'connect', 'sendto') GROUP BY 1, 2),
  rej AS (SELECT policy, pid, count(*) AS m, count(CASE WHEN NOT {o.OK_REASON} THEN 1 END) AS r, arg_min(NOT {o.OK_REASON}, (ts_ns, seq)) AS first_rej FROM d WHERE hit GROUP BY 1, 2),
  pairs AS (SELECT policy, pid, coverage, coalesce(m, 0) AS m, coalesce(r, 0) AS r, r * 1.0 / m AS rate, first_rej, pid % 3 = 0 AS bi, 'c' || (policy % 6) AS category
    FROM cov LEFT JOIN rej USING (policy, pid))"""
_AGGS = """count(*) AS n, round(avg(coverage), 6) AS coverage_mean, round(avg(CASE WHEN m > 0 THEN rate END), 6) AS rejection_mean, count(CASE WHEN m > 0 THEN 1 END) AS n_sig,
    count(CASE WHEN m > 0 AND first_rej THEN 1 END) AS first_stopped, count(CASE WHEN m > 0 AND r >= 1 THEN 1 END) AS any_stopped, count(CASE WHEN m > 0 AND r = m THEN 1 END) AS all_stopped"""


@query(
    "stopped_summary",
    o.with_views(_PAIRS, f"""SELECT 'full corpus' AS subset, {_AGGS} FROM pairs UNION ALL
  SELECT CASE WHEN bi THEN 'ace_bi' ELSE 'ace_c' END, {_AGGS} FROM pairs GROUP BY bi"""),
)
def stopped_summary(spark, sf):
    s = policy.stopped_summary(_pairs(spark, sf))
    return s.withColumn("coverage_mean", F.round("coverage_mean", 6)).withColumn("rejection_mean", F.round("rejection_mean", 6))


@query(
    "rejection_by_category",
    o.with_views(_PAIRS, "SELECT category, count(*) AS n, round(avg(rate), 6) AS mean FROM pairs WHERE m > 0 GROUP BY 1 HAVING count(*) >= 3"),
)
def rejection_by_category(spark, sf):
    return policy.group_means(_pairs(spark, sf), "category").withColumn("mean", F.round("mean", 6))


@query(
    "tiered_residual",
    o.with_views(_PAIRS + ", ", """t AS (SELECT p.*, CASE category WHEN 'c0' THEN 0 WHEN 'c1' THEN 1 WHEN 'c2' THEN 1 ELSE 99 END AS tier FROM pairs p WHERE m > 0)
  SELECT removed_up_to, count(*) AS n, count(CASE WHEN first_rej THEN 1 END) AS stopped, round(count(CASE WHEN first_rej THEN 1 END) * 1.0 / count(*), 6) AS rate
  FROM t JOIN (VALUES (-1), (0), (1)) x(removed_up_to) ON tier > removed_up_to GROUP BY 1"""),
)
def tiered_residual(spark, sf):
    tiers = spark.createDataFrame([("c0", 0), ("c1", 1), ("c2", 1)], "category string, tier int")
    return audit.tiered_residual(_pairs(spark, sf), tiers).withColumn("rate", F.round("rate", 6))


def _sentinel_sessions(spark, sf):
    """Per user: write, credential and token sentinels."""
    users = v.ev(spark, sf).select("trace_id", "pid").distinct()
    p = F.col("pid")
    return users.select(
        "trace_id", p.alias("user"), F.concat(F.lit("grp/git-"), p % 5).alias("mcp"),
        F.struct(
            F.concat(F.lit("mcp-"), p % 5).alias("token"), F.lit(None).cast("string").alias("url_token"),
            F.concat(F.lit("/tmp/mcp-"), p % 5, F.lit("/f"), p % 90 + 10).alias("write_path"),
            F.concat(F.lit("/etc/p"), p % 20).alias("cred_path"),
            F.lit("evil.example.com").alias("exfil_host"), F.concat(F.lit("10.0.0."), p % 8).alias("exfil_ip"),
        ).alias("session_sentinels"),
    )


@query(
    "sentinel_hits",
    o.with_views(o.HOST, """SELECT pid AS user, CASE
     WHEN event = 'openat' AND write_intent AND path = '/tmp/mcp-' || (pid % 5) || '/f' || (pid % 90 + 10) THEN 'write_path_open'
     WHEN event = 'openat' AND path = '/etc/p' || (pid % 20) THEN 'cred_path_open'
     WHEN event = 'openat' AND write_intent AND contains(path, '/tmp/mcp-' || (pid % 5)) THEN 'token_tmp_write' END AS role, count(*) AS n
   FROM host GROUP BY 1, 2 HAVING role IS NOT NULL"""),
)
def sentinel_hits(spark, sf):
    """Events on a user's sentinels, by the first rule they fit."""
    preds = policy.sentinel_predicates(_sentinel_sessions(spark, sf), "user")
    e = v.host(spark, sf).withColumn("user", F.col("pid"))
    return policy.match_sentinels(e, preds, "user").groupBy("user", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sentinel_outcomes",
    o.with_views(o.POLICED + ", ", f"""d AS (SELECT *, {o.v1_reason(prefix='')} AS reason FROM policed),
  s AS (SELECT pid, '/tmp/mcp-' || (pid % 5) || '/f' || (pid % 90 + 10) AS w, '/etc/p' || (pid % 20) AS c, '10.0.0.' || (pid % 8) AS x FROM (SELECT DISTINCT pid FROM host)),
  f AS (SELECT pid, coalesce(bool_or(event = 'openat' AND write_intent AND path = w), false) AS wf, coalesce(bool_or(event = 'openat' AND NOT write_intent AND path = c), false) AS cr,
     coalesce(bool_or(event IN ('connect', 'sendto') AND daddr = x), false) AS xf, coalesce(bool_or(event IN ('openat', 'unlinkat') AND path IN (w, c)), false) AS ak
     FROM d JOIN s USING (pid) WHERE {o.OK_REASON} GROUP BY 1)
  SELECT s.pid AS user, CAST(coalesce(wf, false) AS INT) AS write_fired, CAST(coalesce(cr, false) AS INT) AS cred_read, CAST(coalesce(xf, false) AS INT) AS exfil_fired,
    CAST(coalesce(ak, false) AS INT) AS any_kernel_fired, 2 AS n_kernel_paths, CAST(NOT (coalesce(wf, false) OR coalesce(cr, false) OR coalesce(xf, false) OR coalesce(ak, false)) AS INT) AS attack_stopped
  FROM s LEFT JOIN f USING (pid)"""),
)
def sentinel_outcomes(spark, sf):
    """Which sentinels would have fired under each user's policy."""
    s = _sentinel_sessions(spark, sf)
    d = policy.decide(v.policed(spark, sf), "full").withColumn("user", F.col("pid"))
    out = policy.outcomes(d, s, "user", policy.kernel_paths(s, None, "user"))
    return out.select("user", "n_kernel_paths", *[F.col(c).cast("int").alias(c) for c in ("write_fired", "cred_read", "exfil_fired", "any_kernel_fired", "attack_stopped")])


@query(
    "sentinels_repositioned",
    o.with_views(o.EV + ", ", """u AS (SELECT DISTINCT pid FROM ev), i AS (SELECT pid, (109 + 99 + 112 + 45 + 48 + pid % 5) % 15 AS i0 FROM u),
  pool AS (SELECT unnest(range(15)) AS j, unnest(['reddit','slack','postgres','sqlite','git','puppeteer','arxiv','aws-doc','linear','memory','chroma','dbhub','spec-workflow','excel','fetch']) AS name)
  SELECT pid AS user, '/tmp/mcp-' || (SELECT arg_min(name, (j - i0 + 15) % 15) FROM pool WHERE NOT contains('grp/git-' || (pid % 5), name)) || '-mcp-' || (pid % 5) || '/f' || (pid % 90 + 10) AS write_path,
    '/home/ubuntu/.aws/credentials' AS cred_path, 'raw.githubusercontent.com' AS exfil_host FROM i"""),
)
def sentinels_repositioned(spark, sf):
    """Sentinels moved to another server's scratch namespace."""
    r = policy.reposition_sentinels(_sentinel_sessions(spark, sf))
    return r.select("user", *[F.col(f"session_sentinels.{c}").alias(c) for c in ("write_path", "cred_path", "exfil_host")])


@query(
    "outcomes_by_signal",
    o.with_views(o.EV, """SELECT CASE pid % 4 WHEN 0 THEN 'ACE_BI' WHEN 1 THEN 'KERNEL' WHEN 2 THEN 'APP' ELSE 'BOTH' END AS signal, count(*) AS n,
     count(CASE WHEN pid % 3 > 0 THEN 1 END) AS n_kernel_testable, count(CASE WHEN k1 > 50 THEN 1 END) AS attack_stopped,
     count(CASE WHEN pid % 3 > 0 AND k1 > 50 THEN 1 END) AS attack_stopped_kt, count(CASE WHEN k1 <= 50 THEN 1 END) AS any_kernel_fired
   FROM (SELECT pid, max(k) - min(k) AS k1 FROM ev WHERE event_type = 'purchase' GROUP BY 1) GROUP BY 1"""),
)
def outcomes_by_signal(spark, sf):
    e = v.ev(spark, sf).filter("event_type = 'purchase'").groupBy("pid").agg((F.max("k") - F.min("k")).alias("k1"))
    p = F.col("pid")
    r = e.select(
        F.when(p % 4 == 1, "KERNEL").when(p % 4 == 2, "APP").when(p % 4 == 3, "BOTH").alias("primary_signal"),
        (p % 3).alias("n_kernel_paths"), (F.col("k1") > 50).alias("attack_stopped"), (F.col("k1") <= 50).alias("any_kernel_fired"),
    )
    return policy.outcome_buckets(r)


# ---- patterns over URLs ---------------------------------------------------------


@query(
    "url_host_policy",
    """WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
  SELECT host, CAST(host LIKE '%.example.com' OR host = 'm.therou.example.com' AS INT) AS host_ok, count(*) AS n,
    count(CASE WHEN path LIKE '/en/%' OR regexp_matches(path, '^/fr/[1-5].*$') OR regexp_matches(path, '^/.s/[^1-4].*$') THEN 1 END) AS path_ok FROM u GROUP BY 1, 2""",
)
def url_host_policy(spark, sf):
    """Hosts and paths of all pages against glob lists."""
    u = v.urls(spark, sf)
    hosts = F.array(F.lit("*.example.com"), F.lit("m.therou.example.com"))
    routes = F.array(F.lit("/en/**"), F.lit("/fr/[1-5]*"), F.lit("/?s/[!1-4]*"))
    ok = globs.matches(F.col("path"), globs.compile_list(routes))
    return u.groupBy("host", globs.host_covered(F.col("host"), globs.compile_list(hosts), hosts).cast("int").alias("host_ok")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("path_ok")
    )


@query(
    "supervisor_globs",
    """WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
  SELECT page_id, CAST(regexp_matches(path, '^/[^/][^/]/[^/]*$') AS INT) AS two, CAST(path LIKE '/en/%' AS INT) AS deep, CAST(regexp_matches(path, '^/.*7[^/]*$') AND NOT regexp_matches(path, '^/[^7]*7.*/') AS INT) AS mid FROM u""",
)
def supervisor_globs(spark, sf):
    """The supervisor's dialect: a final star stops at slashes, a double one does not."""
    p = F.col("path")
    one = lambda pat: globs.matches(p, globs.compile_list(F.array(F.lit(pat)), "supervisor")).cast("int")
    return v.urls(spark, sf).select("page_id", one("/??/*").alias("two"), one("/en/**").alias("deep"), one("/*7*").alias("mid"))


# ---- audits of pattern sets --------------------------------------------------------


def _patterns(spark, sf):
    """Pages as policies: their host and path pieces are patterns."""
    u = v.urls(spark, sf)
    part = lambda i: F.get(F.split("host", r"\."), F.lit(i))
    rows = F.array(
        F.struct(F.lit("host").alias("field"), F.col("host").alias("pattern")),
        F.struct(F.lit("label").alias("field"), part(0).alias("pattern")),
        F.struct(F.lit("path").alias("field"), F.col("path").alias("pattern")),
    )
    return u.select("page_id", F.explode(rows).alias("x")).select("page_id", "x.*").filter("length(pattern) > 0")


_PATTERNS = """u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
  pat AS (SELECT page_id, 'host' AS field, host AS pattern FROM u UNION ALL SELECT page_id, 'label', split_part(host, '.', 1) FROM u UNION ALL SELECT page_id, 'path', path FROM u)"""


@query(
    "pattern_diversity",
    o.with_views(_PATTERNS, "SELECT field, count(DISTINCT pattern) AS n_unique, count(*) AS n_mentions, count(DISTINCT page_id) AS n_policies FROM pat WHERE pattern <> '' GROUP BY 1"),
)
def pattern_diversity(spark, sf):
    return audit.field_diversity(_patterns(spark, sf), "page_id")


@query(
    "pattern_leakage",
    o.with_views(_PATTERNS, """, needle AS (SELECT DISTINCT split_part(host, '.', 1) AS needle FROM u)
  SELECT needle, count(DISTINCT pattern) AS n FROM pat JOIN needle ON contains(pattern, needle) WHERE pattern <> '' AND needle <> '' GROUP BY 1"""),
)
def pattern_leakage(spark, sf):
    """Which patterns contain a sentinel text anywhere?"""
    p = _patterns(spark, sf)
    needles = p.filter("field = 'label'").select(F.col("pattern").alias("needle"))
    hits = audit.leakage(p, needles, "page_id")
    return hits.groupBy("needle").agg(F.count_distinct("pattern").alias("n"))


@query(
    "policy_shapes",
    "SELECT n_nationkey % 3 <> 0 AS allow_spawn, n_nationkey % 4 <> 0 AS allow_egress, 2 AS n_reads, 2 AS n_writes, 3 AS n_binaries, count(*) AS n FROM nation GROUP BY 1, 2",
)
def policy_shapes(spark, sf):
    return audit.shapes(v.policy_rows(spark, sf))


@query(
    "pattern_jaccard",
    """WITH s AS (SELECT DISTINCT c_nationkey, o_custkey AS c_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
  n AS (SELECT c_nationkey, c_custkey, count(*) AS n FROM s GROUP BY 1, 2),
  r AS (SELECT *, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY md5('42|' || c_custkey), c_custkey) AS other FROM n),
  b AS (SELECT r.c_nationkey, r.c_custkey, r.other, count(y.l_suppkey) AS n_both FROM r JOIN s x ON x.c_custkey = r.c_custkey LEFT JOIN s y ON y.c_custkey = r.other AND y.l_suppkey = x.l_suppkey
    WHERE r.other IS NOT NULL GROUP BY 1, 2, 3)
  SELECT b.c_nationkey, b.c_custkey, b.other, n_both, n_both * 1.0 / (p.n + q.n - n_both) AS jaccard FROM b JOIN n p ON p.c_custkey = b.c_custkey JOIN n q ON q.c_custkey = b.other""",
)
def pattern_jaccard(spark, sf):
    """Similarity of the supplier sets of customers, over a seeded ring inside each nation."""
    t = v.touches(spark, sf).select(F.col("o_custkey").alias("c_custkey"), "l_suppkey")
    c = v.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return audit.neighbour_jaccard(t.join(c, "c_custkey"), "c_custkey", "l_suppkey", ["c_nationkey"])


@query(
    "masked_sentinel_shapes",
    o.with_views(o.EV + ", ", """u AS (SELECT DISTINCT pid FROM ev)
  SELECT 'write_path' AS field, '/tmp/<token>/f' || (pid % 90 + 10) AS shape, count(*) AS n FROM u GROUP BY 1, 2"""),
)
def masked_sentinel_shapes(spark, sf):
    s = _sentinel_sessions(spark, sf).select(
        F.lit("write_path").alias("field"), F.col("session_sentinels.write_path").alias("needle"), F.col("session_sentinels.token").alias("tok")
    )
    return audit.masked_inventory(s, "tok")


@query(
    "misaligned_policies",
    """WITH r AS (SELECT c_custkey AS key, c_mktsegment AS policy, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) AS n, count(*) OVER () AS total FROM customer)
  SELECT a.key, b.key AS donor, b.policy FROM r a JOIN r b ON b.n = a.n % a.total + 1 WHERE a.key <> b.key""",
)
def misaligned_policies(spark, sf):
    """Every customer key gets the next key's policy in a seeded order."""
    p = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("policy"))
    return policy.misaligned(p, "key").select("key", "donor", "policy")


@query(
    "baseline_policy_coverage",
    o.with_views(o.HOST, """SELECT pid, count(*) AS total,
    count(CASE WHEN write_intent AND regexp_matches(path, '^/tmp/mcp-' || (pid % 5) || '-.*/.*$') OR (NOT write_intent AND regexp_matches(path, '^(/etc|/usr|/opt|/lib)/')) THEN 1 END) AS inside_heuristic,
    count(CASE WHEN write_intent AND path LIKE '/tmp/mcp-%' OR (NOT write_intent AND regexp_matches(path, '^(/etc|/usr|/opt|/lib)/')) THEN 1 END) AS inside_null
    FROM host WHERE event = 'openat' GROUP BY 1"""),
)
def baseline_policy_coverage(spark, sf):
    """The permissive and the rule-based baseline over all opens."""
    from vestige.sources.sessions import compile_envelopes

    e = v.host(spark, sf).filter("event = 'openat'")
    keys = e.select("pid").distinct().withColumn("mcp", F.concat(F.lit("grp/"), F.col("pid") % 5))

    def inside(rows, name):
        d = policy.decide(e.join(compile_envelopes(rows), "pid"), "v1")
        return policy.coverage(d, ["pid"]).select("pid", "total", F.col("inside").alias(name))

    a = inside(policy.heuristic_policies(keys), "inside_heuristic")
    return a.join(inside(policy.null_policies(keys), "inside_null").drop("total"), "pid")


@query(
    "event_summary",
    o.with_views(o.HOST + ", ", """x AS (SELECT trace_id, 'event' AS kind, event AS value FROM host
    UNION ALL SELECT trace_id, CASE WHEN event = 'openat' THEN CASE WHEN write_intent THEN 'write_path' ELSE 'read_path' END WHEN event = 'unlinkat' THEN 'unlink_path' ELSE 'exec_path' END, path FROM host WHERE event IN ('openat', 'unlinkat', 'execve')
    UNION ALL SELECT trace_id, 'family', CAST(family AS VARCHAR) FROM host WHERE event IN ('connect', 'sendto')
    UNION ALL SELECT trace_id, 'comm', comm FROM host)
  SELECT trace_id, kind, value, count(*) AS n FROM x WHERE value <> '' GROUP BY 1, 2, 3"""),
)
def event_summary(spark, sf):
    from vestige.sources.hostlog import policy_events

    return evaluation.event_summary(policy_events(v.host(spark, sf)), ["trace_id"])


@query(
    "scratch_dotfiles",
    o.with_views(o.HOST, "SELECT pid, count(*) AS n FROM host WHERE path LIKE '/tmp/.%' GROUP BY 1"),
)
def scratch_dotfiles(spark, sf):
    return v.host(spark, sf).filter(paths.scratch_dotfile(F.col("path"))).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "signature_full_and_subtree",
    o.with_views(o.POLICED + ", " + _HITS + ", ", f"""hist AS (SELECT trace_id, pid, bool_or(comm IN ('libuv-worker', 'MainThread')) AND NOT bool_or(comm IN ('claude', 'sh')) AS ins FROM host GROUP BY 1, 2),
  d AS (SELECT trace_id, pid, {o.v1_reason(noise_floor=True, prefix='')} AS reason FROM hits WHERE hit)
  SELECT trace_id, count(*) AS n_full, count(CASE WHEN NOT {o.OK_REASON} THEN 1 END) AS n_full_rejected, count(CASE WHEN ins THEN 1 END) AS n_subtree,
    count(CASE WHEN ins AND NOT {o.OK_REASON} THEN 1 END) AS n_subtree_rejected FROM d JOIN hist USING (trace_id, pid) GROUP BY 1"""),
)
def signature_full_and_subtree(spark, sf):
    """Signature matches in whole traces beside those of the worker-thread processes."""
    h = v.host(spark, sf)
    inside = subtree.comm_history(h, ["trace_id"]).filter("has_distinctive AND NOT has_ancestor").select("trace_id", "pid")
    d = policy.decide(v.policed(spark, sf), "full", noise_floor=True)
    return evaluation.signature_counts(policy.match_signatures(d, _leaves(spark, sf), "policy"), inside, ["trace_id"])


@query("policy_document_diversity", "SELECT count(*) AS n, count(DISTINCT (c_nationkey, c_mktsegment)) AS n_unique FROM customer")
def policy_document_diversity(spark, sf):
    c = v.table(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    return audit.document_diversity(c, ["c_nationkey", "c_mktsegment"])
