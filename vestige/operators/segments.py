"""Ordered scans over groups of any size.

A window over ``partitionBy(key)`` puts a whole group into one task, which fails when one trace or
pid holds a third of the data.  So a scan first counts the rows of its groups.  If none has more
than SPLIT_ROWS, one window per group does.  Otherwise the rows are dealt out by range over
(key, order): Spark samples them and cuts where row counts are even, whatever the clock looks
like, dense, sparse or line numbers.  Rows are then scanned per (key, segment), and one summary
row per segment is carried on; a key has at most as many segments as there are ranges.

A scan reads its input twice (key columns, then rows).  Callers that chain scans settle the
intermediate table, so reads do not multiply; callers that scan one table over and over ask
``has_large`` once and pass the answer on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestige.session import settle

#: Rows of one group that a single task scans at most.
SPLIT_ROWS = 1_000_000

MINUTE_NS = 60 * 1_000_000_000

_SEG = "__segment"


def has_large(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether some group has more than SPLIT_ROWS rows."""
    if df.count() <= SPLIT_ROWS:  # no shuffle, and no group is larger than the table
        return False
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"))
    return not counts.filter(F.col("__rows") > SPLIT_ROWS).isEmpty()


def _with_segment(rows: DataFrame, by: Sequence[str], order: Sequence[str], large: bool | None) -> DataFrame:
    """``rows`` with the segment of each; none where every group may be scanned whole."""
    if not (has_large(rows, by) if large is None else large):
        return rows
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SPLIT_ROWS))
    # Written once: the borders are sampled, and every later step must see the same ones.
    return settle(rows.repartitionByRange(ranges, *by, *order).withColumn(_SEG, F.spark_partition_id()))


def _keys(by: Sequence[str], rows: DataFrame) -> list[str]:
    return [*by, _SEG] if _SEG in rows.columns else [*by]


def _attach(rows: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    """``carry`` joined on; keys may be null, and segments are then joined with skew in mind."""
    named = carry.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*by, _SEG])], *[c for c in carry.columns if c not in (*by, _SEG)])
    on = F.lit(True)
    for i, k in enumerate([*by, _SEG]):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(named, on, "left").drop(*[f"__k{i}" for i in range(len(by) + 1)])


def _edge_values(rows: DataFrame, by: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    """One row per (key, segment) that occurs, with its first or last value if it has one."""
    edge = F.when(F.col("__value").isNotNull(), F.struct(*order))
    return rows.groupBy(*by, _SEG).agg(pick(F.col("__value"), edge).alias("__edge"))


def scan_last(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    *,
    inclusive: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` before each row of its group."""
    rows = _with_segment(df.withColumn("__value", value), by, order, large)
    frame = (
        Window.partitionBy(*_keys(by, rows))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    scanned = rows.withColumn("__local", F.last("__value", ignorenulls=True).over(frame))
    return _carried(scanned, rows, by, order, F.max_by, F.last, Window.unboundedPreceding, -1, out)


def scan_next(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    *,
    inclusive: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """Add ``out``: the earliest non-null ``value`` after each row of its group."""
    rows = _with_segment(df.withColumn("__value", value), by, order, large)
    # Backwards: Spark evaluates a frame that ends with its group anew for every row.
    frame = (
        Window.partitionBy(*_keys(by, rows))
        .orderBy(*[F.col(c).desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    scanned = rows.withColumn("__local", F.last("__value", ignorenulls=True).over(frame))
    return _carried(scanned, rows, by, order, F.min_by, F.first, 1, Window.unboundedFollowing, out)


def scan_first(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str, *, large: bool | None = None) -> DataFrame:
    """Add ``out``: the first non-null ``value`` of the group up to and including each row."""
    rows = _with_segment(df.withColumn("__value", value), by, order, large)
    frame = Window.partitionBy(*_keys(by, rows)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumn("__local", F.first("__value", ignorenulls=True).over(frame))
    if _SEG not in rows.columns:
        return scanned.withColumn(out, F.col("__local")).drop("__value", "__local")
    before = Window.partitionBy(*by).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = _edge_values(rows, by, order, F.min_by).select(*by, _SEG, F.first("__edge", ignorenulls=True).over(before).alias("__carry"))
    return _attach(scanned, carry, by).withColumn(out, F.coalesce("__carry", "__local")).drop(_SEG, "__value", "__local", "__carry")


def _carried(scanned, rows, by, order, pick, take, low, high, out: str) -> DataFrame:
    """The value found in the row's own segment, else the nearest one beyond it."""
    if _SEG not in rows.columns:
        return scanned.withColumn(out, F.col("__local")).drop("__value", "__local")
    beyond = Window.partitionBy(*by).orderBy(_SEG).rowsBetween(low, high)
    edges = _edge_values(rows, by, order, pick)
    carry = edges.select(*by, _SEG, take("__edge", ignorenulls=True).over(beyond).alias("__carry"))
    joined = _attach(scanned, carry, by).withColumn(out, F.coalesce("__local", "__carry"))
    return joined.drop(_SEG, "__value", "__local", "__carry")


def scan_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    *,
    inclusive: bool = True,
    large: bool | None = None,
) -> DataFrame:
    """Add one running total per entry of ``values`` (name -> summand)."""
    for name, summand in values.items():
        df = df.withColumn(f"__v_{name}", summand.cast("bigint"))
    rows = _with_segment(df, by, order, large)
    frame = (
        Window.partitionBy(*_keys(by, rows))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    zero = F.lit(0).cast("bigint")
    scanned = rows.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(frame) for n in values})
    if _SEG not in rows.columns:
        done = scanned.withColumns({n: F.coalesce(F.col(f"__l_{n}"), zero) for n in values})
        return done.drop(*[f"__{p}_{n}" for n in values for p in ("v", "l")])
    totals = rows.groupBy(*by, _SEG).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, _SEG, *[F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in values])
    # Written first: a small one is then broadcast, and the rows are not shuffled once more.
    joined = _attach(scanned, settle(carry), by)
    joined = joined.withColumns({n: F.coalesce(F.col(f"__l_{n}"), zero) + F.coalesce(F.col(f"__c_{n}"), zero) for n in values})
    return joined.drop(_SEG, *[f"__{p}_{n}" for n in values for p in ("v", "l", "c")])


def scan_max(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    *,
    large: bool | None = None,
) -> DataFrame:
    """Add ``out``: the maximum of ``value`` over all earlier rows of the group."""
    rows = _with_segment(df, by, order, large)
    frame = Window.partitionBy(*_keys(by, rows)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.withColumn("__local", F.max(value).over(frame))
    if _SEG not in rows.columns:
        return scanned.withColumn(out, F.col("__local")).drop("__local")
    tops = rows.groupBy(*by, _SEG).agg(F.max(value).alias("__top"))
    before = Window.partitionBy(*by).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*by, _SEG, F.max("__top").over(before).alias("__carry"))
    joined = _attach(scanned, carry, by).withColumn(out, F.greatest("__local", "__carry"))
    return joined.drop(_SEG, "__local", "__carry")


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, *, large: bool | None = None) -> DataFrame:
    """1-based position of each row in its group, as ``row_number`` would give."""
    return scan_sums(df, by, order, {out: F.lit(1)}, large=large)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per group.  Spark trims each map task to ``n`` rows per
    group before the shuffle (window group limit), so a hot group stays small."""
    rank = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(rank)).filter(F.col("__rank") <= n).drop("__rank")
