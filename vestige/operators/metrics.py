"""Clustering scores, exact ranks, and grouped rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestige.operators.matching import greedy_pairs
from vestige.session import settle


def contingency(df: DataFrame, by: list[str], true: str, pred: str, order: str | None = None) -> DataFrame:
    """Co-counts of (true, pred); everything below works on this small table."""
    first = F.min(order) if order else F.lit(0)
    t, p = F.coalesce(F.col(true), F.lit("")), F.coalesce(F.col(pred), F.lit(""))
    return df.groupBy(*by, t.cast("string").alias("t"), p.cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), first.alias("first")
    )


def class_map(table: DataFrame, by: list[str], mode: str = "strict") -> DataFrame:
    """Greedy 1:1 map of predicted to true classes, largest co-count first.

    ``compat`` lets the empty class take part on both sides, as the stored scores did;
    ``strict`` maps named classes only.
    """
    usable = table.filter("t <> '' AND p <> ''" if mode == "strict" else "t <> '' OR p <> ''")
    order = [F.col("n").desc(), F.col("first"), F.col("p"), F.col("t")]
    return greedy_pairs(usable, by, "p", "t", order).select(*by, "p", F.col("t").alias("mapped"))


def _choose2(n: Column) -> Column:
    n = n.cast("decimal(38,0)")
    return (n * (n - 1) / 2).cast("decimal(38,0)")


def rand_index(table: DataFrame, by: list[str], mode: str = "strict") -> DataFrame:
    """Adjusted Rand index per group from a contingency table; '' is a class of its own.

    Where the index has no room to vary ``strict`` gives NULL and ``compat`` 1.0.
    """
    ones = by or ["__all"]
    base = table if by else table.withColumn("__all", F.lit(1))
    cells = base.groupBy(*ones).agg(F.sum(_choose2(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    rows = base.groupBy(*ones, "t").agg(F.sum("n").alias("n")).groupBy(*ones).agg(F.sum(_choose2(F.col("n"))).alias("a"))
    cols = base.groupBy(*ones, "p").agg(F.sum("n").alias("n")).groupBy(*ones).agg(F.sum(_choose2(F.col("n"))).alias("b"))
    j = cells.join(rows, ones).join(cols, ones)
    a, b, c = (F.col(x).cast("double") for x in "abc")
    expected = F.when(F.col("n") >= 2, a * b / _choose2(F.col("n")).cast("double")).otherwise(F.lit(0.0))
    top = (a + b) / 2
    flat = F.lit(None).cast("double") if mode == "strict" else F.lit(1.0)
    ari = F.when(top == expected, flat).otherwise((c - expected) / (top - expected))
    return j.select(*by, ari.alias("ari"), F.col("n").alias("n_events"))


def cluster_scores(df: DataFrame, by: list[str], true: str, pred: str, *, mode: str = "strict", order: str | None = None) -> DataFrame:
    """Precision, recall, F1, counts and ARI per group."""
    if not by:
        whole = cluster_scores(df.withColumn("__all", F.lit(1)), ["__all"], true, pred, mode=mode, order=order)
        return whole.drop("__all")
    table = settle(contingency(df, by, true, pred, order))
    return scores_of(table, by, mode)


def scores_of(table: DataFrame, by: list[str], mode: str = "strict") -> DataFrame:
    mapping = class_map(table, by, mode)
    joined = table.join(mapping, [*by, "p"], "left")
    t, p, n = F.col("t"), F.col("p"), F.col("n")
    mapped = F.coalesce("mapped", F.lit(""))
    hit = (t != "") & (mapped == t)
    zero = F.lit(0).cast("bigint")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, n)), zero)

    counts = joined.groupBy(*by).agg(
        total(hit).alias("tp"),
        total(~hit & (p != "") & (mapped != t)).alias("fp"),
        total((t != "") & ((p == "") | (mapped != t))).alias("fn"),
        total(t != "").alias("n_scored"),
        F.count_distinct(F.when(t != "", t)).alias("n_classes_true"),
        F.count_distinct(F.when(p != "", p)).alias("n_classes_pred"),
    )

    def ratio(x, y):
        return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))

    prec = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = counts.withColumn("precision", prec).withColumn("recall", rec)
    scored = scored.withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    ari = rand_index(table, by, mode)
    return scored.join(ari, by)


def trial_summary(trials: DataFrame, by: list[str]) -> DataFrame:
    """Mean, min, max of F1 and means of the other scores; NULLs are skipped."""
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg("f1").alias("f1_mean"),
        F.min("f1").alias("f1_min"),
        F.max("f1").alias("f1_max"),
        F.avg("precision").alias("precision_mean"),
        F.avg("recall").alias("recall_mean"),
        F.avg("ari").alias("ari_mean"),
    )


def exact_ranks(df: DataFrame, by: list[str], value: str, picks: dict[str, Column], slots: int = 128) -> DataFrame:
    """Values at exact 0-based positions of each sorted group.

    ``picks`` maps an output name to a position computed from ``n``.  Equal values are
    counted first; approximate quantiles of the distinct values cut a group into slots of
    similar size, and running counts per slot plus a carry give exact positions, so no
    group is sorted in one task.
    """
    whole = by or ["__all"]
    base = df.filter(F.col(value).isNotNull())
    base = base if by else base.withColumn("__all", F.lit(1))
    counted = base.groupBy(*whole, value).agg(F.count(F.lit(1)).alias("__c"))
    cuts = F.array(*[F.lit((i + 1) / slots) for i in range(slots - 1)])
    span = counted.groupBy(*whole).agg(
        F.sum("__c").alias("n"), F.percentile_approx(value, cuts, F.lit(2000)).alias("__cuts")
    )
    placed = counted.join(span, whole).withColumn("__slot", F.size(F.filter("__cuts", lambda c: c <= F.col(value))))
    frame = Window.partitionBy(*whole, "__slot").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*whole, "__slot").agg(F.sum("__c").alias("__s"))
    before = Window.partitionBy(*whole).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*whole, "__slot", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    run = placed.withColumn("__upto", F.sum("__c").over(frame)).join(sums, [*whole, "__slot"])
    upto = F.col("__upto") + F.col("__b")
    chosen = [
        F.max(F.when((pos >= upto - F.col("__c")) & (pos < upto), F.col(value))).alias(name)
        for name, pos in picks.items()
    ]
    out = run.groupBy(*whole).agg(F.max("n").alias("n"), *chosen)
    return out if by else out.drop("__all")


def percentile_floor(p: float) -> Column:
    """Position int(p * (n - 1))."""
    return F.floor(F.lit(p) * (F.col("n") - 1))


def percentile_of_count(p: float) -> Column:
    """Position int(p * n), and n // 2 for the median."""
    return F.floor(F.lit(p) * F.col("n"))


def histogram(events: DataFrame, by: list[str], event: str = "event") -> DataFrame:
    return events.groupBy(*by, event).agg(F.count(F.lit(1)).alias("n"))


def compare_counts(left: DataFrame, right: DataFrame, keys: list[str], left_n: str = "n", right_n: str = "n", names=("left_n", "right_n")) -> DataFrame:
    """Union of the keys of two count tables: both counts, delta and ratio."""
    a, b = names
    l = left.select(*keys, F.col(left_n).alias(a))
    r = right.select(*keys, F.col(right_n).alias(b))
    j = l.join(r, keys, "full_outer")
    zero = F.lit(0).cast("bigint")
    return j.select(
        *keys, F.coalesce(a, zero).alias(a), F.coalesce(b, zero).alias(b)
    ).withColumn("delta", F.col(b) - F.col(a)).withColumn("ratio", F.try_divide(F.col(b).cast("double"), F.col(a)))


def agreement(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per column: equal, different, only-left, only-right ('' counts as absent)."""
    l = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in cols])
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in cols])
    j = l.join(r, keys, "full_outer")
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("level"), F.coalesce(F.col(f"l_{c}").cast("string"), F.lit("")).alias("l"),
                           F.coalesce(F.col(f"r_{c}").cast("string"), F.lit("")).alias("r")) for c in cols])
    )
    x = j.select(cells.alias("x")).select("x.*")
    l_, r_ = F.col("l"), F.col("r")
    return x.groupBy("level").agg(
        F.count_if(l_ == r_).alias("match"),
        F.count_if((l_ != "") & (r_ != "") & (l_ != r_)).alias("mismatch"),
        F.count_if((l_ != "") & (r_ == "")).alias("left_only"),
        F.count_if((l_ == "") & (r_ != "")).alias("right_only"),
    )


def top_counts(df: DataFrame, key: str, k: int, by: list[str] | None = None) -> DataFrame:
    """The k most frequent keys (per group), ties by key."""
    counted = df.groupBy(*(by or []), key).agg(F.count(F.lit(1)).alias("n"))
    if by:
        w = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col(key))
        return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return counted.orderBy(F.col("n").desc(), F.col(key)).limit(k)
