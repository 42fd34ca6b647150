"""Audits of a policy set and of its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestige.operators.needles import find
from vestige.operators.segments import scan_next
from vestige.session import settle


def field_diversity(patterns: DataFrame, key: str) -> DataFrame:
    """Per field: distinct patterns, mentions, policies that mention any.

    ``patterns`` (key, field, pattern)."""
    return patterns.groupBy("field").agg(
        F.count_distinct("pattern").alias("n_unique"), F.count(F.lit(1)).alias("n_mentions"),
        F.count_distinct(key).alias("n_policies"),
    )


def shapes(policies: DataFrame) -> DataFrame:
    """How many policies share (spawn, egress, number of reads, writes, binaries)."""
    cols = [
        F.col("allow_spawn"), F.col("allow_egress"), F.size("read_paths").alias("n_reads"),
        F.size("write_paths").alias("n_writes"), F.size("allow_binaries").alias("n_binaries"),
    ]
    return policies.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def document_diversity(policies: DataFrame, body: list[str]) -> DataFrame:
    text = F.xxhash64(F.to_json(F.struct(*body)))
    return policies.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(text).alias("n_unique"))


def neighbour_jaccard(sets: DataFrame, key: str, item: str, group: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Jaccard of random pairs: every key with the next one in a seeded digest order
    (within its group, if given).

    ``sets`` (key, item[, group..]).  A seeded ring samples as many pairs as there are keys
    without listing all pairs; repeat with other seeds for more.
    """
    by = group or ["__one"]
    rows = sets if group else sets.withColumn("__one", F.lit(1))
    # Landed: the ring, the sizes and both sides of every pair read these rows.
    rows = settle(rows.select(*by, key, item).distinct())
    ring = rows.select(*by, key).distinct().withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    ring = scan_next(settle(ring), by, ["__h", key], F.struct(key), "__next")
    pairs = ring.filter("__next IS NOT NULL").select(*by, key, F.col(f"__next.{key}").alias("other"))
    size = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    mine = pairs.join(rows, [*by, key])
    theirs = rows.select(*by, F.col(key).alias("other"), item, F.lit(1).alias("both"))
    shared = mine.join(theirs, [*by, "other", item], "left").groupBy(*by, key, "other").agg(F.count("both").alias("n_both"))
    out = shared.join(size.withColumnRenamed("n", "n_a"), [*by, key]).join(
        size.select(*by, F.col(key).alias("other"), F.col("n").alias("n_b")), [*by, "other"]
    )
    j = F.col("n_both").cast("double") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return out.select(*(group or []), key, "other", "n_both", j.alias("jaccard"))


def leakage(patterns: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """Policy patterns that contain a sentinel text: (key, pattern, needle)."""
    p = settle(patterns.filter(F.length("pattern") > 0).select(key, "pattern").distinct())
    texts = p.select("pattern", F.col("pattern").alias("text")).distinct()
    return p.join(find(texts, needles, [], "pattern", "text"), "pattern").select(key, "pattern", "needle")


def coverage_distribution(scores: DataFrame, by: list[str], value: str = "coverage", thresholds=(0.75, 0.9, 0.95, 1.0)) -> DataFrame:
    from vestige.operators.metrics import exact_ranks

    v = F.col(value)
    share = [F.avg((v >= t).cast("double")).alias(f"share_ge_{int(t * 100)}") for t in thresholds]
    basics = scores.filter(v.isNotNull()).groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), *share)
    mid = exact_ranks(scores, by, value, {"lo": F.floor((F.col("n") - 1) / 2), "hi": F.floor(F.col("n") / 2)})
    mid = mid.select(*by, "n", ((F.col("lo") + F.col("hi")) / 2).alias("median"))
    if by:
        return basics.join(mid, by)
    one = F.lit(1).alias("__one")
    return basics.select(one, "*").join(mid.select(one, "*"), "__one").drop("__one")


def masked_inventory(needles: DataFrame, token: str, value: str = "needle") -> DataFrame:
    """Sentinel texts with their session token masked, and how often each shape occurs."""
    shape = F.when(F.length(token) > 0, F.replace(F.col(value), F.col(token), F.lit("<token>"))).otherwise(F.col(value))
    return needles.groupBy("field", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def tiered_residual(pairs: DataFrame, tiers: DataFrame, key: str = "category") -> DataFrame:
    """Stopped rate on what is left after removing tiers 0, 1, ... of categories.

    ``tiers`` (key, tier); categories without a tier are never removed.
    """
    level = pairs.join(tiers, key, "left").withColumn("tier", F.coalesce("tier", F.lit(1 << 30)))
    counted = level.filter("n_sig_matches > 0").groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("first_hit_rejected").alias("k")
    )
    cuts = tiers.select("tier").distinct().unionByName(tiers.sparkSession.range(1).select(F.lit(-1).alias("tier"))).distinct()
    # Every level keeps the rows above it: running sums over the distinct levels.
    levels = counted.join(cuts.withColumn("cut", F.lit(True)), "tier", "full").select(
        F.col("tier").alias("removed_up_to"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("cut", F.lit(False)).alias("cut"))
    above = Window.orderBy(F.col("removed_up_to").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = levels.select("removed_up_to", "cut", F.sum("n").over(above).alias("n"), F.sum("k").over(above).alias("stopped")).filter("cut AND n > 0")
    return left.select("removed_up_to", "n", "stopped", F.try_divide(F.col("stopped").cast("double"), F.col("n")).alias("rate"))
