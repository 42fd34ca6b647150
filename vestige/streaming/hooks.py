"""Hook logs and event rates as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.schema import HOOK_EVENT
from vestige.sources.sessions import clean_hooks


def read_hook_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Append-only hook logs, with an event time for watermarks."""
    raw = spark.readStream.schema(HOOK_EVENT).options(**options).json(folder)
    return clean_hooks(raw).withColumn("event_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("bigint")))


def call_windows(hooks: DataFrame, late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Tool-start joined with its tool-end as both arrive (session_id, use_id, lo, hi)."""
    ids = hooks.filter(F.length("tool_use_id") > 0)
    pre = ids.filter("hook = 'PreToolUse'").select(
        "session_id", F.col("tool_use_id").alias("use_id"), F.col("tool_name").alias("name"),
        F.col("ts_ns").alias("lo"), F.col("event_time").alias("started"),
    ).withWatermark("started", late)
    post = ids.filter("hook = 'PostToolUse'").select(
        F.col("session_id").alias("s"), F.col("tool_use_id").alias("u"),
        F.col("ts_ns").alias("hi"), F.col("event_time").alias("ended"), "is_error",
    ).withWatermark("ended", late)
    fits = F.expr(f"session_id = s AND use_id = u AND ended >= started AND ended <= started + INTERVAL {longest}")
    return pre.join(post, fits).select("session_id", "use_id", "name", "lo", "hi", "is_error")


def event_rates(events: DataFrame, late: str = "1 minute", window: str = "1 minute") -> DataFrame:
    """Event counts per trace, kind and time window; repeated (trace_id, seq) count once."""
    timed = events.withColumn("event_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("bigint")))
    once = timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["trace_id", "seq"])
    return once.groupBy(F.window("event_time", window), "trace_id", "event").agg(F.count(F.lit(1)).alias("n"))


def activity_bursts(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of activity per trace and pid (start, end, n), each told when the watermark has passed its end.

    The same bursts as ``timejoin.islands`` finds over the whole table, as long as no event is
    later than ``late``; state is one row for each open burst.
    """
    timed = events.withColumn("event_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("bigint")))
    spans = timed.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), "trace_id", "pid").agg(F.count(F.lit(1)).alias("n"))
    return spans.select("trace_id", "pid", (F.unix_micros("w.start") * 1000).alias("start"), (F.unix_micros("w.end") * 1000).alias("end"), "n")
