"""Host sensor logs: JSON lines, wildcard traces, marks, system-call names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.functions import paths
from vestige.schema import HOST_NESTED, canonical


def read_host_json(spark: SparkSession, path: str | list[str], trace: Column | None = None) -> DataFrame:
    """JSON-lines events, nested or flat, as canonical rows (bad lines skipped)."""
    raw = (
        spark.read.schema(HOST_NESTED)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", "true")
        .json(path)
        .withColumn("trace_id", trace if trace is not None else F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        .withColumn("seq", F.monotonically_increasing_id())
    )
    return host_events(raw)


def stream_host_json(spark: SparkSession, path: str, trace: Column) -> DataFrame:
    """The same as a stream.

    A line's place in its file is not available there, so ``seq`` is a hash of the file and of
    all fields: it tells events apart, and a line that is read again keeps its number.
    """
    raw = spark.readStream.schema(HOST_NESTED).option("mode", "PERMISSIVE").json(path)
    seq = F.xxhash64(F.col("_metadata.file_path"), F.to_json(F.struct(*[F.col(c) for c in raw.columns])))
    return host_events(raw.withColumn("seq", seq).withColumn("trace_id", trace))


def parse_host_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Canonical rows from a table of JSON text lines that also has trace_id and seq."""
    parsed = lines.withColumn(
        "__row", F.from_json(value, HOST_NESTED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    rest = [c for c in ("trace_id", "seq") if c in lines.columns]
    return host_events(parsed.select(*rest, "__row.*"))


def host_events(raw: DataFrame) -> DataFrame:
    """Drop broken rows and sensor metadata, merge the nested and flat layouts."""
    kept = raw.filter(
        F.col("_corrupt_record").isNull()
        & F.col("event").isNotNull()
        & ~F.col("event").startswith("_")
        & F.col("pid").isNotNull()
    )
    both = {
        c: F.coalesce(F.col(f"args.{c}"), F.col(c)) for c in ("path", "argv", "flags", "fd", "family")
    }
    nested = {c: F.col(f"args.{c}") for c in ("daddr", "dport", "len", "parent_pid", "child_pid", "parent_comm")}
    return canonical(
        kept,
        **both,
        **nested,
        buf=F.col("args.buf_b64"),
        ts_ns=F.coalesce(F.col("ts_ns"), F.lit(0)),
        write_intent=paths.write_by_accmode(both["flags"]),
    )


# Calls that keep a path, and calls that keep a socket.
_WITH_PATH = ("openat", "unlinkat", "execve")
_WITH_SOCKET = ("connect", "sendto")


def policy_events(events: DataFrame) -> DataFrame:
    """Rows the policy checks read: runtime start-up and exits dropped, fields pruned."""
    kept = events.filter(
        F.col("event").isNotNull()
        & ~F.col("event").isin("_calibration", "exit_group")
        & ~F.coalesce(F.col("comm"), F.lit("")).startswith("runc:")
    )
    opened = F.col("event") == "openat"
    return kept.select(
        "trace_id", "seq", "ts_ns", "pid", "comm", "event",
        F.when(F.col("event").isin(*_WITH_PATH), F.col("path")).alias("path"),
        F.when(F.col("event") == "execve", F.col("argv")).alias("argv"),
        F.when(opened, paths.write_by_accmode(F.col("flags"))).alias("write_intent"),
        F.when(F.col("event").isin(*_WITH_SOCKET), F.col("family")).alias("family"),
        F.when(F.col("event").isin(*_WITH_SOCKET), F.col("fd")).alias("fd"),
        F.when(F.col("event").isin(*_WITH_SOCKET), F.col("daddr")).alias("daddr"),
    )


def parse_wildcard(lines: DataFrame, value: str = "value") -> DataFrame:
    """``T|ns|nr|tgid|tid|comm`` and ``F|ns|ppid|cpid|comm`` rows; comm may hold pipes."""
    v = F.col(value)
    sys_call = r"^T\|(\d+)\|(\d+)\|(\d+)\|(\d+)\|(.*)$"
    fork = r"^F\|(\d+)\|(\d+)\|(\d+)\|(.*)$"
    is_call, is_fork = v.rlike(sys_call), v.rlike(fork)

    def pick(i_call, i_fork, kind="bigint"):
        a = F.when(is_call, F.regexp_extract(v, sys_call, i_call)) if i_call else F.lit(None)
        b = F.when(is_fork, F.regexp_extract(v, fork, i_fork)) if i_fork else F.lit(None)
        return F.coalesce(a, b).try_cast(kind)

    keep = [c for c in lines.columns if c != value]
    return lines.filter(is_call | is_fork).select(
        *keep,
        F.when(is_call, "syscall").otherwise("fork").alias("kind"),
        pick(1, 1).alias("ts_ns"),
        pick(2, None, "int").alias("nr"),
        pick(3, None).alias("tgid"),
        pick(4, None).alias("tid"),
        pick(None, 2).alias("parent"),
        pick(None, 3).alias("child"),
        pick(5, 4, "string").alias("comm"),
    )


def boot_offset(lines: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The ``BOOT|nsecs=`` value of each trace."""
    ns = F.regexp_extract(value, r"^BOOT\|.*?nsecs=(\d+)", 1)
    return (
        lines.filter(F.length(ns) > 0)
        .groupBy(*by)
        .agg(F.min(ns.cast("bigint")).alias("boot_ns"))
    )


# Names used when no kernel header table is given.
FALLBACK_NAMES = {0: "read", 1: "write", 3: "close", 257: "openat"}


def name_calls(calls: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add ``syscall``; numbers without a name become ``sc_<nr>``."""
    if names is None:
        table = F.create_map(*[F.lit(x) for kv in FALLBACK_NAMES.items() for x in kv])
        known = F.try_element_at(table, F.col("nr"))
        return calls.withColumn("syscall", F.coalesce(known, F.concat(F.lit("sc_"), F.col("nr"))))
    joined = calls.join(names.select("nr", F.col("name").alias("__name")), "nr", "left")
    return joined.withColumn(
        "syscall", F.coalesce("__name", F.concat(F.lit("sc_"), F.col("nr")))
    ).drop("__name")


def read_call_names(spark: SparkSession, header: str) -> DataFrame:
    """``nr, name`` from the ``#define __NR_<name> <nr>`` lines of a kernel header."""
    pattern = r"^#define\s+__NR_(\w+)\s+(\d+)"
    v = F.col("value")
    return (
        spark.read.text(header)
        .filter(v.rlike(pattern))
        .select(
            F.regexp_extract(v, pattern, 2).cast("int").alias("nr"),
            F.regexp_extract(v, pattern, 1).alias("name"),
        )
        .dropDuplicates(["nr"])
    )


def marks(lines: DataFrame, by: list[str], value: str = "value", order: str = "seq") -> DataFrame:
    """First ``MARK <ns> <name>`` line per name."""
    pattern = r"^MARK (\d+) (\S+)"
    v = F.col(value)
    return (
        lines.filter(v.rlike(pattern))
        .select(
            *by, order,
            F.regexp_extract(v, pattern, 2).alias("mark"),
            F.regexp_extract(v, pattern, 1).cast("bigint").alias("mark_ns"),
        )
        .groupBy(*by, "mark")
        .agg(F.min_by("mark_ns", order).alias("mark_ns"))
    )
