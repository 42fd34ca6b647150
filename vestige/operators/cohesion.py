"""Do a process's targets overlap with what the rest of its session touches?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.session import settle


def cohesion(touches: DataFrame, members: DataFrame, exempt: DataFrame, by: list[str], threshold: float = 0.10) -> DataFrame:
    """Score per (session, pid) not exempt: targets also touched by another member of the
    session, over own targets.

    ``touches`` (trace.., pid, target), ``members`` (trace.., session_id, pid), ``exempt``
    (trace.., session_id, pid: anchors and server members).  A target is shared if at
    least two members touched it, so counting distinct pids per target replaces comparing
    members pairwise.  All scores use the memberships before any demotion.
    """
    s = [*by, "session_id"]
    member = settle(members.select(*s, "pid").distinct())
    own = settle(touches.select(*by, "pid", "target").distinct().join(member, [*by, "pid"]))
    # A target that one member touched is alone: it takes one from the shared ones of that member,
    # so the touches need not be joined to the shared targets.  A null target is never shared.
    alone = own.filter("target IS NOT NULL").groupBy(*s, "target").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("pid")).filter("n = 1")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    marked = own.select(*s, "pid", one.alias("t"), F.when(F.col("target").isNull(), none).otherwise(one).alias("k")).unionByName(
        alone.select(*s, "pid", none.alias("t"), (-one).alias("k"))
    )
    score = marked.groupBy(*s, "pid").agg(F.sum("t").alias("n_targets"), F.sum("k").alias("n_shared"))
    cand = member.join(exempt.select(*s, "pid"), [*s, "pid"], "left_anti")
    return cand.join(score, [*s, "pid"], "left").withColumn(
        "score", F.try_divide(F.col("n_shared").cast("double"), F.col("n_targets"))
    ).withColumn("demoted", F.coalesce(F.col("score") < threshold, F.lit(False)))


def from_graph(tables: dict[str, DataFrame], threshold: float = 0.10) -> DataFrame:
    from vestige.plans.graph_tables import all_edges

    touches = all_edges(tables).select("trace_id", "pid", F.concat_ws(":", "kind", "target").alias("target"))
    members = tables["member_of_session"]
    served = members.join(tables["member_of_mcp"].select("trace_id", "pid").distinct(), ["trace_id", "pid"], "left_semi")
    anchors = tables["Session"].select("trace_id", "session_id", F.col("anchor_pid").alias("pid"))
    exempt = served.select("trace_id", "session_id", "pid").unionByName(anchors)
    return cohesion(touches, members, exempt, ["trace_id"], threshold)


def demote(tables: dict[str, DataFrame], scores: DataFrame) -> dict[str, DataFrame]:
    """Graph tables without the demoted memberships, which move to a table of their own."""
    out = scores.filter("demoted").select("trace_id", "session_id", "pid", "score")
    keys = ["trace_id", "session_id", "pid"]
    kept = tables["member_of_session"].join(out, keys, "left_anti")
    return {**tables, "member_of_session": kept, "demoted_session_membership": out.withColumn("reason", F.lit("low_cohesion"))}


def stats(scores: DataFrame, threshold: float = 0.10) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("n_pids_examined"), F.count_if("demoted").alias("n_pids_demoted"),
        F.lit(threshold).alias("threshold"),
    )
