"""Policies scored over a corpus of benign / fired session pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.operators import policy, subtree
from vestige.operators.selection import pair_policies

POLICY_COLUMNS = (
    "read_paths", "write_paths", "delete_paths", "allow_hosts", "allow_binaries", "read_paths_re", "write_paths_re",
    "delete_paths_re", "allow_hosts_re", "allow_binaries_re", "any_paths_re", "allow_egress", "allow_spawn",
)


def in_subtree(calls: DataFrame, is_ace_bi: DataFrame) -> DataFrame:
    """Calls (trace_id, ...) of each session's server subtree; built-in sessions keep every
    pid but start-up.  ``is_ace_bi`` (trace_id, is_ace_bi)."""
    marked = calls.join(is_ace_bi, "trace_id")
    served, built_in = marked.filter("NOT is_ace_bi"), marked.filter("is_ace_bi")
    pids = subtree.fork_subtree(served, ["trace_id"]).unionByName(subtree.builtin_subtree(built_in, ["trace_id"]))
    return marked.join(pids, ["trace_id", "pid"], "left_semi")


def with_policy(calls: DataFrame, sessions: DataFrame, policies: DataFrame, keys: list[str]) -> DataFrame:
    """Events joined to their session's policy.  Policies stay unhinted: their measured
    size decides between broadcast and shuffle."""
    return calls.join(sessions.select("trace_id", *keys).distinct(), "trace_id").join(policies, keys)


def evaluate(
    pairs: DataFrame,
    calls: DataFrame,
    policies: DataFrame,
    predicates: DataFrame,
    *,
    mode: str = "full",
    noise_floor: bool = True,
    keys: tuple[str, ...] = ("mcp", "prompt"),
) -> DataFrame:
    """Coverage on the benign and rejection on the fired session of every pair.

    ``calls``: paired calls by trace_id (= session id).  ``predicates`` (trace_id, place,
    event, ...): signature or sentinel predicates of the fired sessions, in the shape
    ``policy.sentinel_predicates`` gives.  The event table is decided once per session.
    """
    keys = list(keys)
    ready = pair_policies(pairs, policies, keys).filter("status = 'ok'")
    flag = ready.select(F.col("benign_session_id").alias("trace_id"), *keys, "is_ace_bi").unionByName(
        ready.select(F.col("malicious_session_id").alias("trace_id"), *keys, "is_ace_bi")
    ).distinct()
    kept = in_subtree(calls, flag.select("trace_id", "is_ace_bi").distinct())
    decided = policy.decide(with_policy(kept, flag, policies, keys), mode, noise_floor=noise_floor)
    cov = policy.coverage(decided.filter(F.col("event").isin(*policy.SECURITY_EVENTS)), ["trace_id", *keys]).withColumnRenamed("trace_id", "benign_session_id")
    slim = decided.select("trace_id", *keys, "seq", "ts_ns", "event", "path", "argv", "write_intent", "ok", "reason")
    hits = policy.match_sentinels(slim.withColumnRenamed("trace_id", "k").withColumn("trace_id", F.col("k")), predicates.withColumnRenamed("trace_id", "k"), "k")
    rej = policy.rejection(hits, ["trace_id", *keys]).withColumnRenamed("trace_id", "malicious_session_id")
    out = pairs.join(cov, ["benign_session_id", *keys], "left").join(rej, ["malicious_session_id", *keys], "left")
    return out.fillna(0, ["n_sig_matches", "n_rejected"])


def signature_as_predicates(leaves: DataFrame, key: str) -> DataFrame:
    """Signature leaves in the shape of sentinel predicates (prefix tests included)."""
    none = F.lit(None).cast("string")
    return leaves.select(
        key, "place", F.lit("signature").alias("role"), F.col("syscall").alias("event"),
        F.coalesce("path_contains", "path_starts_with").alias("needle"), none.alias("path_exact"),
        "path_contains", "path_starts_with", none.alias("argv_contains"), F.lit(False).alias("requires_write_intent"),
    )


def event_summary(events: DataFrame, by: list[str]) -> DataFrame:
    """Tidy summary: counts per event, distinct paths per kind, families, comms.

    One row per (kind, value) instead of one list per session, so a busy session's value
    lists never meet in one task.
    """
    ev, w = F.col("event"), F.coalesce("write_intent", F.lit(False))
    kinds = F.array(
        F.struct(F.lit("event").alias("kind"), ev.alias("value")),
        F.struct(F.when(ev == "openat", F.when(w, "write_path").otherwise("read_path")).when(ev == "unlinkat", "unlink_path")
                 .when(ev == "execve", "exec_path").alias("kind"), F.col("path").alias("value")),
        F.struct(F.lit("family").alias("kind"), F.col("family").cast("string").alias("value")),
        F.struct(F.lit("comm").alias("kind"), F.col("comm").alias("value")),
    )
    rows = events.select(*by, F.explode(kinds).alias("x")).select(*by, "x.*").filter("kind IS NOT NULL AND length(value) > 0")
    return rows.groupBy(*by, "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def subtree_impact(events: DataFrame, inside: DataFrame, by: list[str]) -> DataFrame:
    """Events in the whole trace and in the subtree, and their ratio."""
    flagged = events.join(inside.withColumn("__in", F.lit(1)), [*by, "pid"], "left")
    n, k = F.count(F.lit(1)), F.count("__in")
    return flagged.groupBy(*by).agg(n.alias("n_full"), k.alias("n_subtree"), F.try_divide(k.cast("double"), n).alias("ratio"))


def benign_denials(decided: DataFrame, by: list[str]) -> DataFrame:
    """Write false positives and dotfile denials on benign sessions."""
    writes = F.col("event").isin("openat", "open") & F.coalesce("write_intent", F.lit(False))
    return decided.groupBy(*by).agg(
        F.count_if(writes).alias("n_writes"), F.count_if(writes & ~F.col("ok")).alias("write_fp"),
        F.count_if(F.col("reason") == "write_denied_dotfile_in_scratch").alias("dotfile_denials"),
    )


def evaluate_flat(pairs: DataFrame, events: DataFrame, policies: DataFrame, predicates: DataFrame, *, mode: str = "v1",
                  keys: tuple[str, ...] = ("mcp", "prompt")) -> DataFrame:
    """Host-event evaluation without subtrees: strict and noise-floor coverage of the
    benign session, rejection on the fired one."""
    keys = list(keys)
    ready = pair_policies(pairs, policies, keys).filter("status = 'ok'")
    flag = ready.select(F.col("benign_session_id").alias("trace_id"), *keys).unionByName(
        ready.select(F.col("malicious_session_id").alias("trace_id"), *keys)
    ).distinct()
    joined = with_policy(events, flag, policies, keys)
    on = ["trace_id", *keys]

    def cov(noise_floor, name):
        c = policy.coverage(policy.decide(joined, mode, noise_floor=noise_floor), on)
        return c.select(*on, "total", F.col("coverage").alias(name))

    both = cov(False, "coverage_strict").join(cov(True, "coverage_nf").drop("total"), on).withColumnRenamed("trace_id", "benign_session_id")
    slim = policy.decide(joined, mode, noise_floor=True).select(*on, "seq", "ts_ns", "event", "path", "argv", "write_intent", "ok", "reason")
    hits = policy.match_sentinels(slim.withColumn("k", F.col("trace_id")), predicates.withColumnRenamed("trace_id", "k"), "k")
    rej = policy.rejection(hits, on).withColumnRenamed("trace_id", "malicious_session_id")
    return pairs.join(both, ["benign_session_id", *keys], "left").join(rej, ["malicious_session_id", *keys], "left").fillna(
        0, ["n_sig_matches", "n_rejected"]
    )


def signature_counts(decided_hits: DataFrame, inside: DataFrame, by: list[str]) -> DataFrame:
    """Signature matches and rejections in the whole trace and in the subtree, one pass."""
    marked = decided_hits.join(inside.withColumn("__in", F.lit(True)), [*by, "pid"], "left")
    sub, rej = F.coalesce("__in", F.lit(False)), ~F.col("ok")
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_full"), F.count_if(rej).alias("n_full_rejected"),
        F.count_if(sub).alias("n_subtree"), F.count_if(sub & rej).alias("n_subtree_rejected"),
    )
