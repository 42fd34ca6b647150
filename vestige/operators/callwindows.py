"""When each tool call was running: loose windows from transcripts, tight from hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.functions import naming
from vestige.operators.segments import first_rows, ordinal, scan_last, scan_next
from vestige.operators.timejoin import asof, window_totals
from vestige.session import settle

FIRST_CALL_NS = 10_000_000_000


def content_rows(transcript: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """One row per content block, in (record, block) order, with the record's time."""
    return transcript.filter("content IS NOT NULL").select(
        *by, F.col(order).alias("rec"), F.col("type").alias("rec_type"), "parent_tool_use_id",
        naming.iso_to_ns(F.col("timestamp")).alias("rec_ns"), F.posexplode_outer("content").alias("pos", "c"),
    ).select(
        *by, "rec", "rec_type", "rec_ns", F.coalesce("pos", F.lit(0)).alias("pos"), "parent_tool_use_id",
        F.col("c.type").alias("kind"), F.col("c.id").alias("use_id"), F.col("c.name").alias("name"),
        F.col("c.tool_use_id").alias("result_of"), F.col("c.is_error").alias("is_error"),
    )


def use_result_pairs(content: DataFrame, by: list[str]) -> DataFrame:
    """Record numbers of each tool use and of its last result."""
    uses = content.filter("kind = 'tool_use'").select(*by, "use_id", F.col("rec").alias("use_rec"), "name")
    ends = content.filter("kind = 'tool_result'").groupBy(*by, F.col("result_of").alias("use_id")).agg(
        F.max("rec").alias("result_rec")
    )
    return uses.join(ends, [*by, "use_id"], "left")


def loose_windows(content: DataFrame, by: list[str], start_of: DataFrame | None = None) -> DataFrame:
    """From the previous result's time to this call's result.

    The first call starts 10 s before its end, or at the session's start when
    ``start_of`` (by.., t_start_ns) is given.
    """
    # The result that closes a pending use moves the boundary; the use reads the latest.
    results = content.filter("kind = 'tool_result' AND rec_ns IS NOT NULL").select(
        *by, F.col("result_of").alias("use_id"), F.col("rec").alias("end_rec"), F.col("pos").alias("end_pos"),
        F.col("rec_ns").alias("end_ns"), F.col("is_error").alias("end_error"),
    )
    uses = content.filter("kind = 'tool_use'").select(*by, "use_id", "rec", "pos", "name")
    paired = first_rows(
        uses.join(results, [*by, "use_id"]).filter(F.struct("rec", "pos") < F.struct("end_rec", "end_pos")),
        [*by, "use_id", "end_rec", "end_pos"], [F.col("rec").desc(), F.col("pos").desc()],
    )
    paired = first_rows(paired, [*by, "use_id", "rec", "pos"], [F.col("end_rec"), F.col("end_pos")])
    moves = paired.select(*by, F.col("end_rec").alias("rec"), F.col("end_pos").alias("pos"), F.col("end_ns").alias("moved_to"))
    asks = paired.select(*by, "rec", "pos", "use_id", "name", "end_ns", "end_error")
    both = asks.unionByName(moves, allowMissingColumns=True)
    seen = scan_last(both, by, ["rec", "pos"], F.col("moved_to"), "lower").filter("use_id IS NOT NULL")
    first = F.col("end_ns") - FIRST_CALL_NS
    if start_of is not None:
        seen = seen.join(start_of, by, "left")
        first = F.col("t_start_ns")
    return seen.select(
        *by, "use_id", "name", F.coalesce("lower", first).alias("lo"), F.col("end_ns").alias("hi"),
        F.coalesce("end_error", F.lit(False)).alias("is_error"),
    )


def tight_windows(hooks: DataFrame, by: list[str]) -> DataFrame:
    """From the tool-start hook to the tool-end hook of one use id.  Starts without an
    end, and ends without a start, give no window."""
    pre, post = F.col("hook") == "PreToolUse", F.col("hook") == "PostToolUse"
    calls = hooks.filter((pre | post) & (F.length("tool_use_id") > 0)).groupBy(*by, F.col("tool_use_id").alias("use_id")).agg(
        F.max(F.when(pre, F.col("ts_ns"))).alias("lo"),
        F.min(F.when(post, F.col("ts_ns"))).alias("hi"),
        F.max(F.when(pre, F.col("tool_name"))).alias("name"),
        F.bool_or(post & F.coalesce("is_error", F.lit(False))).alias("is_error"),
    )
    return calls.filter("lo IS NOT NULL AND hi IS NOT NULL")


def orphan_starts(hooks: DataFrame, by: list[str]) -> DataFrame:
    """Tool starts that no tool end answers."""
    ids = hooks.filter(F.length("tool_use_id") > 0)
    pre = ids.filter("hook = 'PreToolUse'").select(*by, F.col("tool_use_id").alias("use_id"), F.col("ts_ns").alias("lo"))
    post = ids.filter("hook = 'PostToolUse'").select(*by, F.col("tool_use_id").alias("use_id"))
    return pre.join(post, [*by, "use_id"], "left_anti")


def choose_windows(tight: DataFrame, loose: DataFrame, by: list[str], prefer: str = "auto") -> DataFrame:
    """Windows with their ``source``; ``auto`` takes hooks for every session that has any."""
    t = tight.withColumn("source", F.lit("hooks"))
    l = loose.withColumn("source", F.lit("stream"))
    if prefer == "hooks":
        return t
    if prefer == "stream":
        return l
    has = tight.select(*by).distinct()
    return t.unionByName(l.join(has, by, "left_anti"), allowMissingColumns=True)


def window_activity(edges: DataFrame, calls: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Edge counts inside each call window; NULL where the window is not closed."""
    valid = calls.filter("t_open_ns > 0 AND t_close_ns >= t_open_ns")
    counts = window_totals(edges, valid, by, "ts_ns", "t_open_ns", "t_close_ns", ["tool_call_id"], measures)
    return calls.join(counts, [*by, "tool_call_id"], "left")


def consecutive_overlap(events: DataFrame, windows: DataFrame, by: list[str], key: str = "tid") -> DataFrame:
    """Per group: consecutive window pairs with activity on both sides, and how many of
    them share no thread.  A window without length counts as a neighbour, not as a pair.

    Every event belongs to the stretch between one window's opening and the next one's.  Two
    consecutive windows share a key if an event lies in both, or if a key seen in the first
    window's own stretch is next seen, after the second one's opening, before that one's end:
    then the first window's other events lie in the overlap, where there are none.  So each
    (key, stretch) is looked at once, with the key's next stretch, and no window lists its keys.
    """
    named = settle(ordinal(windows, by, ["lo", "hi", "use_id"], "ord").select(*by, "lo", "hi", F.col("ord").cast("bigint").alias("ord")))
    points = events.filter(F.col(key).isNotNull()).select(*by, F.col("ts_ns").alias("t"), key)
    held = asof(points, named, by, "t", "lo", ["ord", "hi"], right_ties=["ord"]).filter("ord IS NOT NULL")
    stretches = held.groupBy(*by, key, "ord").agg(F.min("t").alias("first_t"), F.bool_or(F.col("t") <= F.col("hi")).alias("inside"))
    linked = scan_next(stretches, [*by, key], ["ord"], F.col("first_t"), "next_t")
    reach = linked.filter("inside").groupBy(*by, "ord").agg(F.min("next_t").alias("next_t"))
    nxt = named.select(*by, (F.col("ord") - 1).alias("ord"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = named.join(nxt, [*by, "ord"]).filter("hi > lo AND hi2 > lo2")
    # Three ranges of each pair, counted by running totals: the two windows and what they have in common.
    ranges = F.array(*[F.struct(F.lit(n).alias("which"), lo.alias("from"), hi.alias("to")) for n, lo, hi in (
        (0, F.col("lo"), F.col("hi")), (1, F.col("lo2"), F.col("hi2")), (2, F.col("lo2"), F.least("hi", "hi2")))])
    asked = pairs.select(*by, "ord", F.explode(ranges).alias("r")).select(*by, "ord", "r.*").filter("from <= to")
    counts = window_totals(points, asked, by, "t", "from", "to", ["ord", "which"], {"n": F.lit(1)})
    seen = counts.groupBy(*by, "ord").agg(*[F.max(F.when(F.col("which") == k, F.col("n"))).alias(f"n{k}") for k in range(3)]).filter("n0 > 0 AND n1 > 0")
    told = seen.join(pairs, [*by, "ord"]).join(reach, [*by, "ord"], "left")
    shared = (F.coalesce("n2", F.lit(0)) > 0) | F.coalesce(F.col("next_t") <= F.col("hi2"), F.lit(False))
    return told.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~shared).alias("disjoint"))


def call_chains(calls: DataFrame, by: list[str], order: list[str], ident: str) -> tuple[DataFrame, DataFrame]:
    """First call of each iteration and next-call edges."""
    spot = ordinal(calls, by, order, "ord").select(*by, "ord", ident)
    first = spot.filter("ord = 1").select(*by, ident)
    nxt = spot.select(*by, (F.col("ord") - 1).alias("ord"), F.col(ident).alias("next"))
    return first, spot.join(nxt, [*by, "ord"]).select(*by, F.col(ident).alias("call"), "next")
