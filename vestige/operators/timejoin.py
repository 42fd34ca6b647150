"""As-of and interval joins without inequality joins and without pair explosion."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.operators import segments
from vestige.operators.segments import ordinal, scan_last, scan_max, scan_next, scan_sums
from vestige.session import settle

OPEN_END = 1 << 62
#: Octal digits of a rank that are looked up after one shuffle, in groups of 8 ** JOINT_DIGITS events.
JOINT_DIGITS = 5


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    clock: str,
    right_clock: str,
    take: Sequence[str],
    *,
    ties: Sequence[str] = (),
    right_ties: Sequence[str] = (),
    same_instant: bool = True,
    forward: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """Each left row with the ``take`` columns of the latest right row at or before it
    (earliest at or after it when ``forward``).

    Both inputs are unioned and scanned once per (key, time segment).  ``ties`` and
    ``right_ties`` order rows that share a clock value; with both given, a right row
    counts only if (clock, ties) is strictly smaller than the left row's, unless
    ``same_instant`` also admits equality.
    """
    payload = "__payload"
    # A null key equals nothing: without right rows of null keys, such left rows stay unmatched.
    right = right.dropna(subset=list(by)) if by else right
    shared = len(right_ties) == len(ties) and len(ties) > 0
    # A right row sorts before an equal left row exactly when it should be visible to it.
    right_first = same_instant != forward
    r = right.select(
        *by,
        F.col(right_clock).cast("bigint").alias("__clock"),
        *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(right_ties)],
        F.lit(0 if right_first else 1).alias("__side"),
        F.struct(*take).alias(payload),
    )
    l = left.select(
        *[F.col(c) for c in left.columns],
        F.col(clock).cast("bigint").alias("__clock"),
        *([F.col(c).alias(f"__tie{i}") for i, c in enumerate(ties)] if shared else []),
        F.lit(1 if right_first else 0).alias("__side"),
        F.lit(True).alias("__is_left"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    tie_names = [f"__tie{i}" for i in range(len(right_ties))]
    order = ["__clock", *tie_names, "__side"] if shared else ["__clock", "__side", *tie_names]
    scan = scan_next if forward else scan_last
    done = scan(both, by, order, F.col(payload), "__found", large=large)
    return done.filter("__is_left").select(
        *left.columns, *[F.col(f"__found.{c}").alias(c) for c in take]
    )


def first_wins(
    windows: DataFrame, by: Sequence[str], lo: str, hi: str, ident: str, *, large: bool | None = None
) -> DataFrame:
    """Trim overlapping closed windows to disjoint ones, earlier-opened windows first.

    A window loses the instants covered by any window that sorts before it on
    (lo, ident); the cover of all earlier windows up to an instant at or after its own
    opening is a prefix, so its end is the running maximum of their closings.
    """
    w = windows.withColumn(
        "__hi", F.when(F.coalesce(F.col(hi), F.lit(0)) <= 0, F.lit(OPEN_END)).otherwise(F.col(hi))
    )
    w = scan_max(w, by, [lo, ident], "__hi", "__covered", large=large)
    start = F.greatest(F.col(lo), F.coalesce(F.col("__covered") + 1, F.col(lo)))
    return w.withColumn("__lo", start).filter("__lo <= __hi").drop("__covered")


def in_window(
    events: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    clock: str,
    lo: str,
    hi: str,
    ident: str,
    take: Sequence[str] = (),
    *,
    large: bool | None = None,
) -> DataFrame:
    """Each event with the first window (by opening time, then id) that contains it.

    ``hi`` NULL or <= 0 means still open.  Windows are made disjoint first, which
    turns the interval join into one as-of lookup plus an end check.
    """
    cut = first_wins(windows, by, lo, hi, ident, large=large).select(
        *by, "__lo", "__hi", ident, *[c for c in take if c != ident]
    )
    cols = ["__hi", ident, *[c for c in take if c != ident]]
    found = asof(events, cut, by, clock, "__lo", cols, large=large)
    inside = F.col(clock) <= F.col("__hi")
    return found.select(
        *events.columns, *[F.when(inside, F.col(c)).alias(c) for c in cols if c != "__hi"]
    )


def window_totals(
    events: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    clock: str,
    lo: str,
    hi: str,
    ident: Sequence[str],
    measures: dict,
    *,
    large: bool | None = None,
) -> DataFrame:
    """Sum ``measures`` (name -> Column over events) inside each closed window.

    Windows may overlap and may be long: a window's total is the running total at its
    end minus the running total just before its start, so no event is ever paired
    with a window and the cost is events + 2 x windows.
    """
    hi_end = F.when(F.coalesce(F.col(hi), F.lit(0)) <= 0, F.lit(OPEN_END)).otherwise(F.col(hi))
    names = list(measures)
    points = events.select(
        *by,
        F.col(clock).cast("bigint").alias("__clock"),
        F.lit(0).alias("__side"),
        *[F.coalesce(m.cast("bigint"), F.lit(0)).alias(n) for n, m in measures.items()],
    )
    edges = windows.withColumn(
        "__edge",
        F.explode(
            F.array(
                F.struct(F.col(lo).cast("bigint").alias("at"), F.lit(-1).alias("side")),
                F.struct(hi_end.cast("bigint").alias("at"), F.lit(1).alias("side")),
            )
        ),
    ).select(*by, *ident, F.col("__edge.at").alias("__clock"), F.col("__edge.side").alias("__side"))
    both = points.unionByName(edges, allowMissingColumns=True)
    run = scan_sums(
        both,
        by,
        ["__clock", "__side"],
        {f"__run_{n}": F.coalesce(F.col(n), F.lit(0)) for n in names},
        large=large,
    )
    per_window = (
        run.filter("__side <> 0")
        .groupBy(*by, *[c for c in ident if c not in by])
        .agg(*[F.sum(F.col("__side") * F.col(f"__run_{n}")).alias(n) for n in names])
    )
    return per_window


def islands(events: DataFrame, by: Sequence[str], clock: str, gap: int) -> DataFrame:
    """Bursts of activity: (by.., start, end, n); an event more than ``gap`` after the last one starts a new burst.

    ``end`` is the last event's time plus ``gap``, as a session window of a stream has it.
    """
    timed = events.select(*by, F.col(clock).cast("bigint").alias("__t"))
    seen = settle(scan_last(timed, by, ["__t"], F.col("__t"), "__before"))
    opens = F.when(F.col("__before").isNull() | (F.col("__t") - F.col("__before") > gap), 1).otherwise(0)
    # Of events of one instant the one that opens a burst comes first.
    numbered = scan_sums(seen.withColumn("__follows", 1 - opens), by, ["__t", "__follows"], {"__island": opens})
    return numbered.groupBy(*by, "__island").agg(
        F.min("__t").alias("start"), (F.max("__t") + gap).alias("end"), F.count(F.lit(1)).alias("n")
    ).drop("__island")


def distinct_inside(
    events: DataFrame, windows: DataFrame, by: Sequence[str], clock: str, lo: str, hi: str, ident: str, key: str, out: str
) -> DataFrame:
    """(by.., ident, out): the number of different ``key`` values inside each closed window.

    A key counts by its first occurrence in the window: an event at or before the window's end
    whose key was last seen before the window's start.  Events before the start all fulfil the
    latter, so the count is (events with rank up to the end and link before the start) - (events
    before the start).  The first term is counted without pairs: ranks are read as octal numbers;
    on each digit, events and windows that agree on the digits before it meet in one group,
    ordered by link and start, and a window reads the running totals of the lower digits.  Each
    event and window takes part once a digit, that is (events + windows) * log8(events) rows; it
    is shuffled once for the last JOINT_DIGITS digits together and once for each digit before.
    """
    points = events.filter(F.col(key).isNotNull()).select(*by, F.col(clock).cast("bigint").alias("__t"), F.col(key).alias("__key")).distinct()
    linked = settle(scan_last(points, [*by, "__key"], ["__t"], F.col("__t"), "__before"))
    edges = windows.filter(F.col(hi) >= F.col(lo)).select(
        *by, ident, F.col(lo).cast("bigint").alias("__lo"),
        F.explode(F.array(F.struct(F.col(lo).cast("bigint").alias("at"), F.lit(-1).alias("side")), F.struct(F.col(hi).cast("bigint").alias("at"), F.lit(1).alias("side")))).alias("__e"),
    ).select(*by, ident, "__lo", F.col("__e.at").alias("__t"), F.col("__e.side").alias("__side"))
    both = linked.withColumn("__side", F.lit(0)).unionByName(edges, allowMissingColumns=True)
    ranked = settle(scan_sums(both, by, ["__t", "__side", "__key"], {"__rank": F.when(F.col("__side") == 0, 1).otherwise(0)}))
    top = ranked.agg(F.max("__rank")).first()[0] or 0
    digits = max(1, -(-int(top).bit_length() // 3))
    # An event's own rank counts from 0; a window's is the number of events up to its end.
    place = F.when(F.col("__side") == 0, F.col("__rank") - 1).otherwise(F.col("__rank"))
    # A window sorts before events of its own start: their link is not before it.
    asked = ranked.filter("__side >= 0").select(
        *by, ident, (1 - F.col("__side")).alias("__order"), place.alias("__place"),
        F.when(F.col("__side") == 0, F.coalesce("__before", F.lit(-(1 << 62)))).otherwise(F.col("__lo")).alias("__link"))
    lower = {f"__d{d}": F.when((F.col("__order") == 1) & (F.col("__digit") < d), 1).otherwise(0) for d in range(1, 8)}
    few = asked.count() <= segments.SPLIT_ROWS

    def run(levels: range) -> DataFrame:
        """The windows' lookups on some digits: rows are dealt by the digits before these, and take their levels after that."""
        part = asked.withColumn("__whole", F.expr(f"shiftright(__place, {3 * levels.stop})"))
        large = not few and segments.has_large(part, [*by, "__whole"])
        if not large:
            part = part.repartition(*by, "__whole")
        cut = part.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]))).select(
            *by, ident, "__order", "__link", "__whole", "__level",
            F.expr("shiftright(__place, 3 * (__level + 1))").alias("__node"), F.expr("shiftright(__place, 3 * __level) & 7").alias("__digit"))
        # Nothing lies below a window's 0, and no window counts an event's 7.
        cut = cut.filter("(__order = 0 AND __digit > 0) OR (__order = 1 AND __digit < 7)")
        return scan_sums(cut, [*by, "__whole", "__level", "__node"], ["__link", "__order"], lower, large=large).filter("__order = 0")

    together = min(digits, JOINT_DIGITS)
    runs = [run(levels) for levels in (range(together), *(range(k, k + 1) for k in range(together, digits)))]
    picked = F.element_at(F.array(*[F.col(f"__d{d}") for d in range(1, 8)]), F.col("__digit").cast("int"))
    got = [r.select(*by, ident, picked.alias("__reached")) for r in runs]
    reached = functools.reduce(DataFrame.unionByName, got).groupBy(*by, ident).agg(F.sum("__reached").alias("__reached"))
    starts = ranked.filter("__side = -1").groupBy(*by, ident).agg(F.max("__rank").alias("__started"))
    # A window without a lookup has nothing before its end.
    return starts.join(reached, [*by, ident], "left").select(*by, ident, (F.coalesce("__reached", F.lit(0)) - F.col("__started")).alias(out))


def overlap_pairs(
    windows: DataFrame, by: Sequence[str], lo: str, hi: str, ident: str, *, large: bool | None = None
) -> DataFrame:
    """Per group: number of window pairs and of overlapping pairs, counted not listed.

    Sorted by opening, window i overlaps every later window that opens by i's end:
    (openings up to hi_i) - (position of i).
    """
    ranked = settle(ordinal(windows.select(*by, lo, hi, ident), by, [lo, ident], "__pos", large=large))
    tagged = ranked.withColumn("__opens", F.lit(1))
    opened = window_totals(
        tagged, ranked.withColumn("__start", F.lit(-(1 << 62)).cast("bigint")),
        by, lo, "__start", hi, [ident, "__pos"], {"__upto": F.col("__opens")}, large=large,
    )
    n = F.count(F.lit(1))
    return opened.groupBy(*by).agg(
        n.alias("n_windows"),
        (n * (n - 1) / 2).cast("bigint").alias("pairs"),
        F.sum(F.col("__upto") - F.col("__pos")).cast("bigint").alias("overlapping_pairs"),
    )
