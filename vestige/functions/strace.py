"""Fields of strace argument text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r'"((?:[^"\\]|\\.)*)"'

# System calls whose first quoted argument is a path.
PATH_CALLS = (
    "openat", "open", "unlinkat", "unlink", "execve", "creat", "chdir", "mkdir", "rmdir",
    "rename", "readlinkat", "readlink", "stat", "newfstatat", "lstat", "access", "faccessat",
    "faccessat2",
)
# Socket families.
FAMILIES = {"AF_UNIX": 1, "AF_LOCAL": 1, "AF_INET": 2, "AF_INET6": 10, "AF_NETLINK": 16}


# Letters after a backslash and what they stand for.
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", '"': '"', "'": "'", "\\": "\\"}


def _one_piece(piece: Column) -> Column:
    """A run of plain text, or one escape as the character it stands for."""
    octal = F.char(F.conv(F.substring(piece, 2, 3), 8, 10).cast("int"))
    hexa = F.char(F.conv(F.substring(piece, 3, 2), 16, 10).cast("int"))
    table = F.create_map(*[F.lit(x) for k, v in _LETTERS.items() for x in ("\\" + k, v)])
    return (
        F.when(~piece.startswith("\\"), piece)
        .when(piece.rlike(r"\A\\[0-7]"), octal)
        .when(piece.rlike(r"\A\\x[0-9a-fA-F]"), hexa)
        .otherwise(F.coalesce(F.try_element_at(table, piece), piece))
    )


def unescape(text: Column) -> Column:
    """Backslash escapes resolved to single characters, as the tracer wrote them."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\[0-7]{1,3}|\\x[0-9a-fA-F]{2}|\\.|[^\\]+"), F.lit(0))
    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, _one_piece), "")).otherwise(text)


def first_quoted(args: Column) -> Column:
    """NULL when nothing is quoted."""
    return F.when(args.rlike(_QUOTED), unescape(F.regexp_extract(args, _QUOTED, 1)))


def argv_list(args: Column) -> Column:
    """The bracketed word list of an execve; brackets inside quotes are text."""
    quoted = r'"(?:[^"\\]++|\\.)*+"'
    inside = F.regexp_extract(args, rf'^(?:{quoted}|[^"\[]++)*+\[((?:{quoted}|[^"\]]++)*+)\]', 1)
    words = F.regexp_extract_all(inside, F.lit(_QUOTED), F.lit(1))
    return F.when(inside.contains("\\"), F.transform(words, unescape)).otherwise(words)


def exec_image(args: Column) -> Column:
    """Program path of an oracle execve line, '' when the shape is unknown."""
    return F.regexp_extract(args, r'^"([^"]*)"\s*,\s*\[', 1)


def exec_words(args: Column) -> Column:
    """argv of an oracle execve line (kept as written, escapes included)."""
    inside = F.regexp_extract(args, r'(?s)^"[^"]*"\s*,\s*\[(.*?)\]', 1)
    return F.regexp_extract_all(inside, F.lit(_QUOTED), F.lit(1))


def family_number(args: Column) -> Column:
    name = F.regexp_extract(args, r"sa_family=(AF_[A-Z0-9_]+)", 1)
    table = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.try_element_at(table, name)


def return_code(ret: Column) -> Column:
    return F.trim(ret).try_cast("bigint")
