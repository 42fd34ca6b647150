"""strace text as event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.functions import paths
from vestige.functions import strace as st
from vestige.operators.segments import first_rows, scan_last
from vestige.schema import canonical
from vestige.session import settle

_HEAD = r"^(\d+)\s+(\d+\.\d+)\s+"
# Oracle form: a closed call, or one cut off before its result.
_CLOSED = _HEAD + r"([a-z][a-z_0-9]*)\((.*?)\)\s*=\s*(.*?)$"
_CUT = _HEAD + r"([a-z][a-z_0-9]*)\((.*)<unfinished\s*\.\.\.>\s*$"
# Paired form: closed, start and end of a split call.
_WHOLE = _HEAD + r"([a-zA-Z0-9_]+)\((.*)\)\s*=\s*(-?\d+|\?|-1\s+\S+.*)$"
_START = _HEAD + r"([a-zA-Z0-9_]+)\((.*)\s+<unfinished\s+\.\.\.>\s*$"
_END = _HEAD + r"<\.\.\.\s+(\S+)\s+resumed>\s*(.*)\)\s*=\s*(-?\d+|\?)"
_SIGNAL = r"^\d+\s+\d+\.\d+\s+(?:---\s+SIG|\+\+\+)"


def _ns(epoch: Column) -> Column:
    """``sec.micros`` text to integer nanoseconds, the fraction read as six digits."""
    sec = F.substring_index(epoch, ".", 1).cast("bigint")
    frac = F.rpad(F.substring_index(epoch, ".", -1), 6, "0").substr(1, 6).cast("bigint")
    return sec * 1_000_000_000 + frac * 1_000


def parse_oracle(lines: DataFrame, value: str = "value") -> DataFrame:
    """``pid, ts_ns, syscall, args_raw, ret`` of closed and cut-off calls (ret '?')."""
    v = F.col(value)
    closed, cut = v.rlike(_CLOSED), v.rlike(_CUT)

    def pick(i):
        return F.when(closed, F.regexp_extract(v, _CLOSED, i)).otherwise(F.regexp_extract(v, _CUT, i))

    keep = [c for c in lines.columns if c != value]
    return lines.filter(closed | cut).select(
        *keep,
        pick(1).cast("bigint").alias("pid"),
        _ns(pick(2)).alias("ts_ns"),
        pick(3).alias("syscall"),
        F.trim(pick(4)).alias("args_raw"),
        F.when(closed, F.trim(F.regexp_extract(v, _CLOSED, 5))).otherwise("?").alias("ret"),
    )


def pair_calls(lines: DataFrame, by: list[str], value: str = "value", order: str = "seq") -> DataFrame:
    """Closed calls, and split calls joined end to start.

    A resumed line ends the latest unfinished line of its pid if the call name agrees;
    each unfinished line is ended at most once.  The event carries the start's time.
    """
    v = F.col(value)
    # One pass per form, each with its own expression, so a line meets few of them.
    live = lines.filter(~v.rlike(_SIGNAL))

    def form(name, pattern, groups):
        return F.when(v.rlike(pattern), F.struct(F.lit(name).alias("kind"), *[
            F.regexp_extract(v, pattern, i).alias(n) if i else F.lit(None).cast("string").alias(n) for n, i in groups
        ]))

    full = (("pid", 1), ("epoch", 2), ("event", 3), ("args", 4), ("ret", 5))
    cut = (("pid", 1), ("epoch", 2), ("event", 3), ("args", 4), ("ret", None))
    parsed = live.select(
        *by, order, F.coalesce(form("whole", _WHOLE, full), form("start", _START, cut), form("end", _END, full)).alias("x")
    )
    rows = parsed.filter("x IS NOT NULL").select(*by, order, "x.*").withColumn("pid", F.col("pid").cast("bigint"))
    # Parsing is the costly part: it runs once, and the scans below read its table.
    rows = settle(rows.withColumn("clock", _ns(F.col("epoch"))))
    whole = rows.filter("kind = 'whole'").drop("kind")
    parts = rows.filter("kind <> 'whole'")
    # File order decides which start is the latest, so the line number is the clock.
    start = F.when(F.col("kind") == "start", F.struct(order, "clock", "epoch", "event", "args"))
    ends = (
        scan_last(parts, [*by, "pid"], [order], start, "opened")
        .filter("kind = 'end' AND opened.event = event")
    )
    # The first fitting end consumes the start.
    ends = first_rows(
        ends.withColumn("opened_at", F.col(f"opened.{order}")), [*by, "pid", "opened_at"], [F.col(order)]
    )
    joined_args = F.regexp_replace(
        F.concat_ws(",", F.col("opened.args"), F.col("args")), r"^,+|,+$", ""
    )
    ends = ends.select(
        *by,
        order,
        "pid",
        F.col("opened.epoch").alias("epoch"),
        "event",
        joined_args.alias("args"),
        "ret",
        F.col("opened.clock").alias("clock"),
    )
    return whole.unionByName(ends)


def project_calls(calls: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Typed fields of paired calls: path, write intent, argv, family, return code."""
    args = F.col("args")
    opens = F.col("event").isin("openat", "open")
    words = st.argv_list(args)
    return calls.select(
        *by,
        order,
        F.col("clock").alias("ts_ns"),
        F.col("epoch").cast("double").alias("ts"),
        "event",
        "pid",
        F.when(F.col("event").isin(*st.PATH_CALLS), st.first_quoted(args)).alias("path"),
        F.when(opens, paths.write_by_words(args)).alias("write_intent"),
        F.when((F.col("event") == "execve") & (F.size(words) > 0), words).alias("argv"),
        F.when(F.col("event") == "connect", st.family_number(args)).alias("family"),
        st.return_code(F.col("ret")).alias("ret"),
    )


def parse_paired(lines: DataFrame, by: list[str], value: str = "value", order: str = "seq") -> DataFrame:
    return project_calls(pair_calls(lines, by, value, order), by, order)


def as_canonical(calls: DataFrame) -> DataFrame:
    """Paired calls (keyed by trace_id) as canonical rows, with clone children as forks."""
    child = F.when(
        F.col("event").isin("clone", "clone3") & (F.col("ret") > 0), F.col("ret")
    )
    return canonical(calls, child_pid=child, parent_pid=F.when(child.isNotNull(), F.col("pid")))


def oracle_execs(oracle: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """First execve per pid with its program path and argv."""
    execs = oracle.filter("syscall = 'execve'").select(
        *by, "pid", "ts_ns", order,
        st.exec_image(F.col("args_raw")).alias("image"),
        st.exec_words(F.col("args_raw")).alias("argv"),
    )
    return first_rows(execs, [*by, "pid"], [F.col("ts_ns"), F.col(order)])
