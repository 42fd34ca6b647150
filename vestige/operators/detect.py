"""Which execve starts an agent session, which starts a tool server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.functions.paths import basename
from vestige.operators.timejoin import asof
from vestige.session import settle

# Agent binary and its per-session switches.
AGENT = "claude"
SESSION_SWITCHES = ("-p", "--print")
# Programs that run a script given as their first argument.
WRAPPERS = ("node", "python", "python3", "uv", "uvx")
# The name shapes of the broadened detector.
BROAD = r"^mcp[-_]|[-_.]mcp[-_]?server|[-_.]mcp$|[-_]mcp[-_]"


def arg(argv: Column, i: int) -> Column:
    return F.get(argv, F.lit(i))


def program(argv: Column, path: Column) -> Column:
    return F.coalesce(arg(argv, 0), path, F.lit(""))


def session_root(event: Column, path: Column, argv: Column, switches=SESSION_SWITCHES, agent: str = AGENT) -> Column:
    """The agent started for one prompt.  The session-partition study accepts '-p' only."""
    marked = F.arrays_overlap(argv, F.array(*[F.lit(s) for s in switches]))
    return (event == "execve") & (basename(program(argv, path)) == agent) & F.coalesce(marked, F.lit(False))


def strict_server(event: Column, path: Column, argv: Column) -> Column:
    """Label of a server start by the strict name rule, else NULL."""
    base = basename(program(argv, path), lower=True)
    script = basename(arg(argv, 1), lower=True)
    by_script = (
        base.isin(*WRAPPERS)
        & (F.size(argv) > 1)
        & script.contains("mcp")
        & (script.contains("server") | script.startswith("mcp-"))
    )
    return F.when(
        event == "execve", F.when(base.rlike(r"^mcp[-_]server[-_]"), base).when(by_script, script)
    )


def broad_server(event: Column, path: Column, argv: Column) -> Column:
    """Label of a server start by the broadened name rule, else NULL."""
    first = arg(argv, 0)
    base = basename(F.when(F.length(first) > 0, first).otherwise(path), lower=True)
    script = basename(arg(argv, 1), lower=True)
    named = F.when(base.rlike(BROAD), base).when(
        base.isin(*WRAPPERS) & (F.size(argv) > 1) & script.rlike(BROAD), script
    )
    return F.when((event == "execve") & (F.size(argv) > 0), named)


def contains_server(path: Column, argv: Column, *, wrappers: bool = True) -> Column:
    """The call study's filter: 'mcp-server' in the program name ('mcp_server' and
    wrapped scripts too when ``wrappers``)."""
    base = basename(program(argv, path), lower=True)
    hit = base.contains("mcp-server")
    if not wrappers:
        return hit
    script = basename(arg(argv, 1), lower=True)
    wrapped = base.isin(*WRAPPERS) & script.contains("mcp")
    return hit | base.contains("mcp_server") | wrapped


def registration(argv: Column) -> Column:
    """``agent mcp add NAME ... -- [env K=V ...] BIN ARGS`` as (name, bin, arg1), else NULL."""
    def place(word):
        return F.array_position(argv, word) - 1

    tail = F.slice(argv, F.array_position(argv, "--").cast("int") + 1, F.greatest(F.size(argv), F.lit(1)))
    # Leading env words and K=V settings are skipped; the first other word is the program.
    start = F.aggregate(
        F.transform(tail, lambda w, i: F.struct(i.alias("i"), ((w == "env") | w.contains("=")).alias("skip"))),
        F.lit(-1),
        lambda acc, x: F.when((acc < 0) & ~x.skip, x.i).otherwise(acc),
    )
    shaped = (
        (basename(arg(argv, 0)) == AGENT)
        & place("mcp").between(0, 3)
        & place("add").between(0, 4)
        & (place("--") >= 0)
        & (start >= 0)
    )
    name = F.coalesce(F.get(argv, (place("add") + 1).cast("int")), F.lit(""))
    return F.when(
        shaped,
        F.struct(
            name.alias("name"),
            basename(F.get(tail, start), lower=True).alias("bin"),
            F.get(tail, start + 1).alias("arg1"),
        ),
    )


def layered_servers(
    execs: DataFrame, *, registry: bool = True, large: bool | None = None
) -> DataFrame:
    """Execs (trace_id, seq, ts_ns, path, argv) plus ``server_label, server_layer``.

    Registered programs first - by (program, first argument), by program, by wrapped
    script - each as of the exec; then the broadened name rule.  The tuple key keeps the
    first argument as registered while lookups use its lower-cased basename, as the
    stored results expect.  ``registry=False`` is the ablation without registrations.
    """
    argv, path = F.col("argv"), F.col("path")
    broad = broad_server(F.lit("execve"), path, argv)
    if not registry:
        return execs.withColumn("server_label", broad).withColumn(
            "server_layer", F.when(broad.isNotNull(), "broadened").otherwise("")
        )
    first = arg(argv, 0)
    base = basename(F.when(F.length(first) > 0, first).otherwise(path), lower=True)
    script = F.when(F.size(argv) > 1, basename(arg(argv, 1), lower=True)).otherwise("")
    keyed = execs.withColumn("__base", base).withColumn("__script", script)
    # The words first: they cost less than the whole shape, and few commands have them.
    known = settle(
        execs.filter(F.array_contains(argv, "--") & F.array_contains(argv, "mcp") & F.array_contains(argv, "add"))
        .withColumn("__reg", registration(argv))
        .filter("__reg IS NOT NULL")
        .select(
            "trace_id",
            F.col("ts_ns").alias("__at"),
            F.col("seq").alias("__seq"),
            F.col("__reg.name").alias("__name"),
            F.col("__reg.bin").alias("__bin"),
            F.col("__reg.arg1").alias("__arg1"),
        )
    )

    # Three lookups as one: every exec asks under up to three keys, every registration
    # answers under up to three keys, and one as-of scan serves them all.
    asks = keyed.select(
        "trace_id", "ts_ns", "seq",
        F.explode(
            F.array(
                F.struct(F.lit("pair").alias("how"), F.col("__base").alias("key"), F.col("__script").alias("more")),
                F.struct(F.lit("name").alias("how"), F.col("__base").alias("key"), F.lit("").alias("more")),
                F.struct(F.lit("script").alias("how"), F.col("__script").alias("key"), F.lit("").alias("more")),
            )
        ).alias("q"),
    ).select("trace_id", "ts_ns", "seq", "q.*")
    answers = known.select(
        "trace_id", "__at", "__seq", "__name",
        F.explode(
            F.array(
                F.struct(F.lit("pair").alias("how"), F.col("__bin").alias("key"), F.col("__arg1").alias("more")),
                F.struct(F.lit("name").alias("how"), F.col("__bin").alias("key"), F.lit("").alias("more")),
                F.struct(F.lit("script").alias("how"), F.col("__bin").alias("key"), F.lit("").alias("more")),
            )
        ).alias("q"),
    ).select("trace_id", "__at", "__seq", "__name", "q.*").filter("more IS NOT NULL")
    by = ["trace_id", "how", "key", "more"]
    # A key that nothing was registered under finds nothing, and most have none.
    asks = settle(asks.join(answers.select(*by).distinct(), by, "left_semi"))
    found = asof(
        asks, answers, by, "ts_ns", "__at", ["__name"],
        ties=["seq"], right_ties=["__seq"], large=large,
    ).filter("__name IS NOT NULL")
    wide = found.groupBy("trace_id", "seq").agg(
        *[F.max(F.when(F.col("how") == how, F.col("__name"))).alias(out)
          for how, out in (("pair", "__by_pair"), ("name", "__by_bin"), ("script", "__by_script"))]
    )
    got = keyed.join(wide, ["trace_id", "seq"], "left")
    by_script = F.when(F.col("__base").isin(*WRAPPERS), F.col("__by_script"))
    registered = F.when(F.size(argv) > 0, F.coalesce("__by_pair", "__by_bin", by_script))
    return got.withColumn("__registered", registered).select(
        *execs.columns,
        F.coalesce("__registered", broad).alias("server_label"),
        F.when(F.col("__registered").isNotNull(), "registered")
        .when(broad.isNotNull(), "broadened")
        .otherwise("")
        .alias("server_layer"),
    )
