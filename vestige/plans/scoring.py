"""Attribution scores: per trial and level, per call, and across methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.operators import binding, cohesion
from vestige.operators.metrics import agreement, cluster_scores
from vestige.plans import graph_tables

LEVELS = {"session": "src_session", "mcp": "src_mcp", "tool_call": "src_tool_call"}


def long_form(labelled: DataFrame, predicted: DataFrame, keys=("trace_id", "seq")) -> DataFrame:
    """One row per event and level with its true and predicted class."""
    truth = labelled.select(*keys, "ts_ns", *LEVELS.values())
    rows = truth.join(predicted.select(*keys, *LEVELS), list(keys))
    cells = F.array(*[F.struct(F.lit(k).alias("level"), F.col(v).alias("true"), F.col(k).alias("pred")) for k, v in LEVELS.items()])
    return rows.select("trace_id", "ts_ns", F.explode(cells).alias("x")).select("trace_id", "ts_ns", "x.*")


def run_trials(merged: DataFrame, *, detector: str = "strict", mode: str = "strict", **options) -> DataFrame:
    """Scores per merged trace (= trial) and level."""
    predicted = binding.predictions(merged, detector=detector, **options)
    return cluster_scores(long_form(merged, predicted), ["trace_id", "level"], "true", "pred", mode=mode, order="ts_ns")


def run_trials_with_cohesion(merged: DataFrame, threshold: float = 0.10, mode: str = "strict") -> DataFrame:
    """Session scores before and after low-cohesion members are dropped."""
    tables = graph_tables.build(merged)
    bad = cohesion.from_graph(tables, threshold).filter("demoted").select("trace_id", "pid", F.lit(True).alias("__bad"))
    predicted = binding.predictions(merged, detector="layered")
    filtered = predicted.join(bad, ["trace_id", "pid"], "left").withColumn(
        "session", F.when(F.col("__bad"), "").otherwise(F.col("session"))
    ).drop("__bad")
    score = lambda p: cluster_scores(long_form(merged, p), ["trace_id", "level"], "true", "pred", mode=mode, order="ts_ns")
    return score(predicted).withColumn("stage", F.lit("before")).unionByName(score(filtered).withColumn("stage", F.lit("after")))


def method_agreement(left: DataFrame, right: DataFrame, keys=("trace_id", "seq")) -> DataFrame:
    """match / mismatch / only-left / only-right per level of two prediction tables."""
    return agreement(left, right, list(keys), list(LEVELS))


def per_call(truth: DataFrame, orphans: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """Status of every true and predicted call, with window gaps and cover test.

    ``truth`` (by.., use_id, lo, hi), ``orphans`` (by.., use_id, lo), ``predicted``
    (by.., tool_call_id, t_open_ns, t_close_ns).
    """
    g = truth.select(*by, "use_id", "lo", "hi", F.lit(False).alias("orphan")).unionByName(
        orphans.select(*by, "use_id", "lo", F.lit(True).alias("orphan")), allowMissingColumns=True
    )
    p = predicted.select(*by, F.col("tool_call_id").alias("use_id"), "t_open_ns", "t_close_ns", F.lit(True).alias("__p"))
    j = g.withColumn("__g", F.lit(True)).join(p, [*by, "use_id"], "full_outer")
    both = F.col("__g") & F.col("__p")
    paired = both & ~F.col("orphan")
    lo_ok = (F.col("t_open_ns") > 0) & (F.col("t_open_ns") <= F.col("lo"))
    hi_ok = (F.col("t_close_ns") <= 0) | (F.col("t_close_ns") >= F.col("hi"))
    return j.select(
        *by, "use_id",
        F.when(F.col("__g").isNull(), "extra").when(F.col("__p").isNull(), "missed")
        .when(F.col("orphan"), "matched_orphan").otherwise("matched").alias("status"),
        F.when(paired & (F.col("t_open_ns") > 0), (F.col("lo") - F.col("t_open_ns")) / 1e6).alias("open_gap_ms"),
        F.when(paired & (F.col("t_close_ns") > 0), (F.col("t_close_ns") - F.col("hi")) / 1e6).alias("close_gap_ms"),
        F.when(paired, lo_ok & hi_ok).alias("covers"),
    )


def call_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    st = F.col("status")
    out = rows.groupBy(*by).agg(
        F.count_if(st != "extra").alias("n_truth"),
        F.count_if(st == "matched").alias("n_matched"),
        F.count_if(st == "matched_orphan").alias("n_matched_orphan"),
        F.count_if(st == "missed").alias("n_missed"),
        F.count_if(st == "extra").alias("n_extra"),
        F.count_if("covers").alias("n_covers"),
    )
    hit = (F.col("n_matched") + F.col("n_matched_orphan")).cast("double")
    return (
        out.withColumn("identification", F.try_divide(hit, F.col("n_truth")))
        .withColumn("timing_coverage", F.try_divide(F.col("n_covers").cast("double"), F.col("n_matched")))
        .withColumn("precision", F.try_divide(hit, hit + F.col("n_extra")))
    )


def parent_truth(heuristic: DataFrame, reported: DataFrame, by: list[str]) -> DataFrame:
    """How often the clone-window parent equals the reported one.

    Both (by.., child, parent).  Children without a heuristic parent count as no_clone.
    """
    h = heuristic.select(*by, "child", F.col("parent").alias("guess"))
    j = reported.select(*by, "child", "parent").join(h, [*by, "child"], "left")
    n = F.count(F.lit(1))
    right = F.count_if(F.col("guess") == F.col("parent"))
    return j.groupBy(*by).agg(
        n.alias("n"), right.alias("correct"), F.count_if(F.col("guess") != F.col("parent")).alias("wrong"),
        F.count_if(F.col("guess").isNull()).alias("no_clone"), F.try_divide(right.cast("double"), n).alias("share_correct"),
    )
