"""Glob patterns compiled to one regular expression per pattern list.

Patterns live on small policy rows, so compilation runs once per policy; event rows
then carry one finished expression per list, and rows of the same policy reuse the
regex compiled last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A pattern's parts: runs of stars, closed sets (a bracket right after the opening one, or after
# its exclamation mark, is a member), single characters.
_PARTS = r"(?s)\*+|\[!?\]?[^\]]*\]|."
# A set's parts: ranges, then single characters.
_MEMBERS = r"(?s).-.|."


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", r"\\$0")


def _member(part: Column) -> Column:
    """One part of a set; a range that runs backwards holds nothing."""
    first, last = F.substring(part, 1, 1), F.substring(part, 3, 1)
    ranged = F.char_length(part) == 3
    return F.when(ranged & (F.ascii(first) > F.ascii(last)), "").when(ranged, F.concat(_plain(first), F.lit("-"), _plain(last))).otherwise(_plain(part))


def _set(part: Column) -> Column:
    negated = part.startswith("[!")
    body = F.regexp_replace(part, r"(?s)^\[!?(.*)\]$", "$1")
    members = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_MEMBERS), F.lit(0)), _member), "")
    empty = F.when(negated, F.lit(".")).otherwise(F.lit("(?!)"))
    return F.when(members == "", empty).otherwise(F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), members, F.lit("]")))


def shell_glob(pattern: Column) -> Column:
    """``*`` crosses slashes, ``**`` equals ``*``, ``?`` and ``[set]`` work; sets may have any length."""
    def one(part: Column) -> Column:
        return (
            F.when(part.startswith("*"), F.lit(".*"))
            .when(part == "?", F.lit("."))
            .when(part.startswith("[") & (F.char_length(part) > 1), _set(part))
            .otherwise(_plain(part))
        )

    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_PARTS), F.lit(0)), one), "")


def supervisor_glob(pattern: Column) -> Column:
    """The inline supervisor's dialect: ``**`` crosses slashes, ``?`` does not, no sets.

    A ``*`` in the middle may cross slashes; a single ``*`` at the end may not, and the
    text before it is matched at its first possible place without reconsidering
    (hence the atomic group).
    """
    tail_star = pattern.rlike(r"(^|[^*])\*$")
    core = F.when(tail_star, F.regexp_replace(pattern, r"\*$", "")).otherwise(pattern)
    core = F.regexp_replace(core, r"[\\.^$+|(){}\[\]&~#-]", r"\\$0")
    core = F.replace(core, F.lit("?"), F.lit("[^/]"))
    core = F.regexp_replace(core, r"\*+$", "\u0002")
    core = F.regexp_replace(core, r"\*+", ".*?")
    core = F.replace(core, F.lit("\u0002"), F.lit(".*"))
    return F.when(tail_star, F.concat(F.lit("(?>"), core, F.lit(")[^/]*"))).otherwise(core)


DIALECTS = {"shell": shell_glob, "supervisor": supervisor_glob}


def compile_list(patterns: Column, dialect: str = "shell") -> Column:
    """One anchored expression for a whole list; NULL when the list is empty."""
    to_regex = DIALECTS[dialect]
    present = F.filter(patterns, lambda p: p.isNotNull())
    body = F.array_join(F.transform(present, lambda p: F.concat(F.lit("(?:"), to_regex(p), F.lit(")"))), "|")
    return F.when(
        F.size(present) > 0, F.concat(F.lit(r"(?s)\A(?:"), body, F.lit(r")\z"))
    )


def matches(text: Column, compiled: Column) -> Column:
    """False for missing or empty text and for an empty list."""
    return F.coalesce((F.length(text) > 0) & F.rlike(text, compiled), F.lit(False))


def host_covered(host: Column, compiled: Column, patterns: Column) -> Column:
    return matches(host, compiled) | F.coalesce(F.array_contains(patterns, host), F.lit(False))


def binary_listed(path: Column, binaries: Column) -> Column:
    """Full path or its basename is listed literally."""
    p = F.coalesce(path, F.lit(""))
    return F.coalesce(
        F.array_contains(binaries, p) | F.array_contains(binaries, F.substring_index(p, "/", -1)),
        F.lit(False),
    )


def binary_matched(path: Column, compiled: Column, binaries: Column) -> Column:
    """Supervisor rule: globs count too, on the full path and on the basename."""
    base = F.substring_index(F.coalesce(path, F.lit("")), "/", -1)
    return binary_listed(path, binaries) | matches(path, compiled) | matches(base, compiled)
