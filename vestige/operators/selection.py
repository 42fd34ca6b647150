"""Choosing sessions: samples, diversified picks, benign/fired pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestige.functions import naming
from vestige.operators import needles
from vestige.operators.segments import first_rows
from vestige.session import settle

# Fixed value: the server name of sessions that use built-in tools only.
BUILTIN_SERVER = "builtin/claude-code"


def trial_sample(sessions: DataFrame, trials: int, n: int, seed: int = 42, mcp: str = "mcp", ident: str = "session_id") -> DataFrame:
    """Per trial, ``n`` distinct servers and one session of each, by seeded digest order."""
    drawn = lambda what, name: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"), F.lit(what), F.col(name).cast("string")))
    draws = sessions.select(mcp, ident).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    one = first_rows(draws, ["trial", mcp], [drawn("s", ident), F.col(ident)])
    return first_rows(one, ["trial"], [drawn("m", mcp), F.col(mcp)], n)


def strength(hits: Column, sentinel_hits: Column, is_ace_bi: Column) -> Column:
    return F.when(is_ace_bi, sentinel_hits).otherwise(hits)


def diverse_pick(candidates: DataFrame, target: int, score: str, key: list[str], ident: str, cap: int | None = None) -> DataFrame:
    """Strongest first: one per key and then the rest, or at most ``cap`` per key."""
    order = [F.col(score).desc(), F.col(ident)]
    if cap is not None:
        return first_rows(candidates, key, order, cap).orderBy(*order).limit(target)
    # Ranks beyond ``target`` inside a key can never be reached, so each key is trimmed.
    ranked = candidates.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    late = F.col("__r") > 1
    return ranked.filter(F.col("__r") <= target).orderBy(late, *order).limit(target).drop("__r")


def novelty_pick(candidates: DataFrame, target: int, score: str, category: str, mcp: str, ident: str) -> DataFrame:
    """Strongest first, skipping rows whose category and server were both seen; then fill.

    A row is picked exactly if it is the first of its category or the first of its
    server among the picked; every first of a category and every first of a server in
    sorted order brings something unseen, and a row that is neither has both seen.
    """
    order = [F.col(score).desc(), F.col(ident)]
    new = (
        first_rows(candidates, [category], order)
        .unionByName(first_rows(candidates, [mcp], order))
        .dropDuplicates([ident])
        .withColumn("__late", F.lit(0))
    )
    fill = candidates.join(new.select(ident), ident, "left_anti").orderBy(*order).limit(target)
    both = new.unionByName(fill.withColumn("__late", F.lit(1)))
    return both.orderBy("__late", *order).limit(target).drop("__late")


def first_paired_prompt(sessions: DataFrame, mcps: list[str] | None = None) -> DataFrame:
    """Per server, the first prompt that has a benign and a malicious session."""
    rows = sessions.filter(F.col("mcp").isin(*mcps)) if mcps else sessions
    both = rows.groupBy("mcp", "prompt").agg(
        F.bool_or(F.col("variant") == "benign").alias("b"), F.bool_or(F.col("variant").startswith("malicious")).alias("m")
    )
    return both.filter("b AND m").groupBy("mcp").agg(F.min("prompt").alias("prompt"))


def envelope_keys(sessions: DataFrame) -> DataFrame:
    """One row per (server, prompt) that has benign and fired sessions."""
    benign = F.col("variant") == "benign"
    fired = F.col("variant").startswith("malicious") & (F.col("gold_label") == "malicious_fired")
    g = sessions.groupBy("mcp", "prompt").agg(
        F.count_if(benign).alias("n_benign_sessions"),
        F.count_if(fired).alias("n_fired_sessions"),
        F.min_by("session_id", F.when(benign, F.col("session_id"))).alias("representative"),
        F.min_by("category", F.when(F.col("category").isNotNull(), F.col("session_id"))).alias("category"),
    )
    return g.filter("n_benign_sessions > 0 AND n_fired_sessions > 0").withColumn(
        "is_ace_bi", F.col("mcp") == BUILTIN_SERVER
    )


def session_pairs(sessions: DataFrame) -> DataFrame:
    """Every fired session with the first benign session of its (server, prompt)."""
    benign = sessions.filter("variant = 'benign'").groupBy("mcp", "prompt").agg(F.min("session_id").alias("benign_session_id"))
    fired = sessions.filter(F.col("variant").startswith("malicious") & (F.col("gold_label") == "malicious_fired"))
    return fired.join(benign, ["mcp", "prompt"]).select(
        "mcp", "prompt", "benign_session_id", F.col("session_id").alias("malicious_session_id"),
        "variant", "category", (F.col("mcp") == BUILTIN_SERVER).alias("is_ace_bi"),
        F.when(F.col("mcp") != BUILTIN_SERVER, naming.attack_slug(F.col("variant"))).alias("attack_slug"),
        *([F.col("session_sentinels")] if "session_sentinels" in sessions.columns else []),
    )


def pair_policies(pairs: DataFrame, policies: DataFrame, keys: list[str], sessions: DataFrame | None = None, session_key: str = "malicious_session_id") -> DataFrame:
    """Pairs with their policy and a status: ok, envelope_missing or session_missing."""
    marked = pairs.join(policies.withColumn("__p", F.lit(True)), keys, "left")
    status = F.when(F.col("__p").isNull(), "envelope_missing")
    if sessions is not None:
        have = sessions.select(F.col("session_id").alias(session_key), F.lit(True).alias("__s")).distinct()
        marked = marked.join(have, session_key, "left")
        status = status.when(F.col("__s").isNull(), "session_missing")
    return marked.withColumn("status", status.otherwise("ok")).drop("__p", "__s")


def sentinel_counts(text: DataFrame, sentinels: DataFrame, by: list[str], value: str = "value", distinctive: bool = True) -> DataFrame:
    """How often each sentinel of a session occurs in the session's text."""
    s = sentinels.filter(~F.col("field").isin("token", "url_token")) if distinctive else sentinels
    s = s.filter(F.length("needle") > 0)
    hits = text.join(s, by)
    n = F.floor((F.length(value) - F.length(F.replace(F.col(value), F.col("needle"), F.lit("")))) / F.length("needle"))
    return hits.groupBy(*by, "field", "needle").agg(F.sum(n).cast("bigint").alias("n"))


def raw_line_hits(lines: DataFrame, predicates: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Lines per group that contain a predicate's call name and path text.

    Lines are searched for the path text, the rarer of the two, or for the call name where a
    predicate has none; only lines that hold it are compared with the predicate.
    """
    text = F.coalesce("path_contains", "path_starts_with")
    p = settle(predicates.select(*by, "syscall", text.alias("needle"), F.when(F.length(text) > 0, text).otherwise(F.col("syscall")).alias("anchor")).filter("syscall IS NOT NULL").distinct())
    # An empty call name and an empty path text are in every line.
    always = p.filter("anchor = ''").select(*by).distinct()
    met = needles.find(lines, p, by, "seq", value, "anchor").join(p, [*by, "anchor"]).join(lines.select(*by, "seq", value), [*by, "seq"])
    hits = met.filter(F.col(value).contains(F.col("syscall"))).select(*by, "seq")
    every = lines.filter(F.col(value).isNotNull()).join(always, by, "left_semi").select(*by, "seq")
    return hits.unionByName(every).groupBy(*by).agg(F.count_distinct("seq").alias("n_hits"))
