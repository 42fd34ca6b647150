"""Path predicates and helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reads under these prefixes always pass.
NOISE_PREFIXES = (
    "/etc/", "/usr/", "/lib/", "/lib64/", "/proc/", "/sys/", "/dev/", "/System/", "/opt/",
    "/root/", "/var/lib/", "/run/", "/tmp/", "/dev/null", "/dev/urandom",
)
# The shorter list of the inline supervisor.
SUPERVISOR_NOISE_PREFIXES = (
    "/etc/", "/usr/", "/lib/", "/lib64/", "/proc/", "/sys/", "/dev/", "/System/", "/opt/",
    "/root/", "/var/lib/", "/run/", "/tmp/",
)
# Scratch folders of the dotfile rule.
SCRATCH_PREFIXES = ("/tmp/", "/var/tmp/", "/dev/shm/")


def starts_with_any(value: Column, prefixes) -> Column:
    """One anchored regular expression instead of a chain of comparisons."""
    return F.coalesce(value, F.lit("")).rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


def basename(path: Column, lower: bool = False) -> Column:
    base = F.substring_index(F.coalesce(path, F.lit("")), "/", -1)
    return F.lower(base) if lower else base


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/[^/]*$", "")


def write_by_accmode(flags: Column) -> Column:
    """Access mode 1 or 2 means writing; missing flags mean reading."""
    return F.coalesce(flags.bitwiseAND(F.lit(3)).isin(1, 2), F.lit(False))


def edge_by_accmode(flags: Column) -> Column:
    """Graph rule: mode 0 (or no flags) is a read, every other mode a write."""
    mode = F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(3))
    return F.when(mode == 0, F.lit("read")).otherwise(F.lit("write"))


def write_by_words(args: Column) -> Column:
    """strace rule: any writing flag word anywhere in the arguments."""
    return F.coalesce(args, F.lit("")).rlike("O_WRONLY|O_RDWR|O_CREAT|O_APPEND|O_TRUNC")


def noise_read(
    event: Column,
    path: Column,
    write_intent: Column,
    *,
    opens=("openat",),
    prefixes=NOISE_PREFIXES,
) -> Column:
    return (
        event.isin(*opens)
        & ~F.coalesce(write_intent, F.lit(False))
        & starts_with_any(path, prefixes)
    )


def scratch_dotfile(path: Column) -> Column:
    base = basename(path)
    return (
        starts_with_any(path, SCRATCH_PREFIXES) & base.startswith(".") & ~base.isin(".", "..")
    )
