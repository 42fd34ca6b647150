"""Paths and hosts named inside an execve argv."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL, address and host shapes, shell indicators and command words.
URL_HOST = r"(?iU)\b(?:https?|ftps?|wss?|sftp)://([\w.\-:]+)"
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|0?\d?\d|00\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|0?\d?\d|00\d)$"
HOSTNAME = r"^[a-zA-Z0-9]((?U)[\w.\-]{0,251}[\w])?$"
SHELL_SIGNS = r"[|;><`]|&&|\$\(|\\n"
SHELL_WORDS = (
    "ls", "cat", "cp", "mv", "rm", "touch", "echo", "find", "grep", "awk", "sed", "curl", "wget", "nc", r"python\d?",
    "bash", "sh", "chmod", "chown", "mkdir", "rmdir", "tar", "gzip", "kubectl", "docker", "git",
)
SHELL_START = r"^(?:" + "|".join(SHELL_WORDS) + r")\s"


def like_path(token: Column) -> Column:
    anchored = token.rlike(r"^(?:/|\.\.?/|~/)")
    relative = (
        token.contains("/") & ~token.contains("@") & token.rlike(r"(?U)^(?:[\w.\-]*/)*[\w.\-]*$")
    )
    return (
        (F.length(token) > 0)
        & ~token.contains(" ")
        & ~token.contains("://")
        & (anchored | relative)
    )


def like_ipv4(token: Column) -> Column:
    return token.rlike(IPV4)


def like_hostname(token: Column) -> Column:
    return (
        token.contains(".")
        & ~token.contains("/")
        & ~token.contains(" ")
        & token.rlike(r"\p{L}")
        & token.rlike(HOSTNAME)
    )


def like_shell(token: Column) -> Column:
    return (
        (F.length(token) >= 4)
        & token.contains(" ")
        & (token.rlike(SHELL_SIGNS) | token.rlike(SHELL_START))
    )


def url_hosts(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(URL_HOST), F.lit(1))
    return F.transform(found, lambda h: F.substring_index(h, ":", 1))


# Shell words: runs of plain characters, escapes and quoted parts.
_PART = r"""[^\s"'\\]+|\\.|"(?:[^"\\]|\\.)*"|'[^']*'"""
_WORD = f"(?s)(?:{_PART})+"
_CLOSED = r"""(?s)\A(?:[^"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')*\z"""


def _unquote(part: Column) -> Column:
    """One part of a shell word without its quoting."""
    inner = F.substring(part, F.lit(2), F.length(part) - 2)
    return (
        F.when(part.startswith("'"), inner)
        .when(part.startswith('"'), F.regexp_replace(inner, r"""(?s)\\(["\\])""", "$1"))
        .when(part.startswith("\\"), F.substring(part, F.lit(2), F.lit(1)))
        .otherwise(part)
    )


def shell_words(text: Column) -> Column:
    """Words under shell quoting; text with an open quote is split at whitespace."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    parts = lambda w: F.regexp_extract_all(w, F.lit("(?s)" + _PART), F.lit(0))
    quoted = F.transform(words, lambda w: F.array_join(F.transform(parts(w), _unquote), ""))
    return F.when(text.rlike(_CLOSED), quoted).otherwise(F.split(F.trim(text), r"\s+"))


def _unfold_once(tokens: Column, split) -> Column:
    """Every command not yet opened becomes itself followed by its words."""
    def one(x):
        opened = F.array(F.struct(x.tok.alias("tok"), F.lit(True).alias("seen")))
        fresh = F.transform(
            F.filter(split(x.tok), lambda w: (F.length(w) > 0) & (w != x.tok)),
            lambda w: F.struct(w.alias("tok"), F.lit(False).alias("seen")),
        )
        return F.when(~x.seen & like_shell(x.tok), F.concat(opened, fresh)).otherwise(opened)

    return F.flatten(F.transform(tokens, one))


def leaves(argv: Column, quoting: str = "shell") -> Column:
    """All tokens of an argv, elements that are shell commands unfolded in place.

    ``shell`` honours quoting and opens commands inside commands: every level uses up at
    least one quoting character, so their number bounds the levels.  ``spaces`` is the
    supervisor's rule: quotes and whitespace separate words, one level.
    """
    present = F.filter(F.coalesce(argv, F.array().cast("array<string>")), lambda t: F.length(t) > 0)
    start = F.transform(present, lambda t: F.struct(t.alias("tok"), F.lit(False).alias("seen")))
    if quoting == "spaces":
        opened = _unfold_once(start, lambda t: F.split(t, r"[\s\"']+"))
    else:
        marks = F.length(F.regexp_replace(F.array_join(present, ""), r"""[^"'\\]""", ""))
        levels = F.sequence(F.lit(1), marks + 1)
        opened = F.aggregate(levels, start, lambda acc, _: _unfold_once(acc, shell_words))
    flat = F.transform(opened, lambda x: x.tok)
    return F.when(F.exists(present, like_shell), flat).otherwise(present)


def path_tokens(leaf: Column) -> Column:
    return F.array_distinct(F.filter(leaf, like_path))


def host_tokens(leaf: Column) -> Column:
    """URL hosts and bare hosts, in order of appearance, without repeats."""
    def of(tok):
        bare = F.regexp_replace(tok, r"[,;]+$", "")
        own = F.when(
            ~like_path(tok) & (like_ipv4(bare) | like_hostname(bare)), F.array(bare)
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(url_hosts(tok), own)

    return F.array_distinct(F.flatten(F.transform(leaf, of)))
