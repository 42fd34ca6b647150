"""Identifiers, keys, clocks and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Neighbour servers for relocated sentinels, and the relocation targets.
NEIGHBOURS = (
    "reddit", "slack", "postgres", "sqlite", "git", "puppeteer", "arxiv", "aws-doc", "linear",
    "memory", "chroma", "dbhub", "spec-workflow", "excel", "fetch",
)
PLAUSIBLE_CRED = "/home/ubuntu/.aws/credentials"
PLAUSIBLE_HOST = "raw.githubusercontent.com"
PLAUSIBLE_IP = "185.199.108.133"


def builtin_tool(name: Column) -> Column:
    return ~F.coalesce(name, F.lit("")).startswith("mcp__")


def server_of_tool(name: Column) -> Column:
    """``mcp__server__tool`` -> ``server``; '' for built-in tools."""
    return F.when(builtin_tool(name), F.lit("")).otherwise(
        F.coalesce(F.get(F.split(name, "__", 3), F.lit(1)), F.lit(""))
    )


def server_id(session: Column, name: Column) -> Column:
    return F.when(builtin_tool(name), F.lit("")).otherwise(
        F.concat(F.lit("mcp/"), session, F.lit("/"), server_of_tool(name))
    )


def iso_to_ns(text: Column) -> Column:
    """ISO time to integer nanoseconds; NULL when missing or broken."""
    return F.unix_micros(F.try_to_timestamp(text)) * 1000


def seconds_to_ns(ts: Column) -> Column:
    """Float seconds, rounded to the microsecond the sensor had, as nanoseconds."""
    return F.round(ts * 1_000_000).cast("bigint") * 1000


def socket_key(family: Column, daddr: Column, dport: Column) -> Column:
    return F.concat_ws(
        ":", family.cast("string"), daddr, F.coalesce(dport, F.lit(0)).cast("string")
    )


def fd_or_missing(fd: Column, *, zero_is_missing: bool = False) -> Column:
    value = F.coalesce(fd, F.lit(-1))
    return F.when(value == 0, F.lit(-1)).otherwise(value) if zero_is_missing else value


def envelope_file(mcp: Column, slug: Column) -> Column:
    return F.concat(F.replace(mcp, F.lit("/"), F.lit("__")), F.lit("__"), slug, F.lit(".json"))


def attack_slug(variant: Column) -> Column:
    return F.get(F.split(variant, ":", 2), F.lit(1))


def neighbour(token: Column, own_server: Column) -> Column:
    """A scratch name other than the session's own server, fixed by the token's letters."""
    tok = F.when(F.coalesce(F.length(token), F.lit(0)) == 0, F.lit("x")).otherwise(token)
    letters = F.filter(F.split(tok, ""), lambda c: F.length(c) > 0)
    start = F.aggregate(letters, F.lit(0), lambda acc, c: acc + F.ascii(c)) % len(NEIGHBOURS)
    pool = F.array(*[F.lit(n) for n in NEIGHBOURS + NEIGHBOURS])
    turn = F.slice(pool, start + 1, F.lit(len(NEIGHBOURS)))
    own = F.lower(F.coalesce(own_server, F.lit("")))
    fit = F.filter(turn, lambda n: ~F.contains(own, n))
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(NEIGHBOURS[0]))


def policy_json(text: Column) -> Column:
    """The JSON object in a model's answer; NULL when none parses.

    Drops everything up to the last closed reasoning block and a surrounding code fence,
    then takes the whole rest or, failing that, the span between its outer braces.
    """
    plain = F.trim(F.regexp_replace(text, r"(?s)\A.*</think>", ""))
    bare = F.regexp_replace(F.regexp_replace(plain, r"\A```[^\n]*\n", ""), r"\n\s*```\s*\z", "")
    body = F.when(plain.startswith("```"), bare).otherwise(plain)
    span = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    whole_ok = F.try_parse_json(body).isNotNull() & (F.length(body) > 0)
    span_ok = F.try_parse_json(span).isNotNull() & (F.length(span) > 0)
    return F.when(whole_ok, body).when(span_ok, span)
