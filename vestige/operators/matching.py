"""One-to-one matching: by co-count, and by nearness in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from vestige.operators.segments import first_rows, scan_last, scan_sums
from vestige.operators.timejoin import asof
from vestige.session import settle


#: Rows of a cluster that is walked in order.
FOLD_ROWS = 40
#: Rows within one tolerance of a cluster that is walked by one task with sorted lists.
WALK_ROWS = 100_000
#: Marks read between two clearances of those that are taken or out of reach.
HELD_ROWS = 20_000
#: Rows that are walked by one task, all its clusters together, where there are tasks enough.
TASK_ROWS = 20_000


def greedy_pairs(pairs: DataFrame, by: list[str], left: str, right: str, order: list) -> DataFrame:
    """The greedy 1:1 choice over ``pairs`` sorted by ``order`` (a total order per group).

    In each round every pair that is the best for both of its ends is taken and all pairs
    of taken ends are dropped.  A pair that is best for both ends cannot be beaten by any
    later choice, so the union of the rounds equals the sequential greedy result.
    """
    todo = settle(pairs)
    taken = None
    while not todo.isEmpty():
        best_l = first_rows(todo, [*by, left], order)
        best = settle(
            best_l.join(first_rows(todo, [*by, right], order).select(*by, left, right), [*by, left, right])
        )
        taken = best if taken is None else taken.unionByName(best)
        todo = settle(
            todo.join(best.select(*by, left), [*by, left], "left_anti").join(
                best.select(*by, right), [*by, right], "left_anti"
            )
        )
    return pairs.limit(0) if taken is None else taken


def _fold(cluster: DataFrame, by: list[str], host_id: str, mark_id: str, tol_ns: int) -> DataFrame:
    """The sequential choice inside each (by.., __cluster), over its sorted hosts and its marks."""
    made = cluster.groupBy(*by, "__cluster").agg(
        F.array_sort(F.collect_list(F.when(F.col("__is_host"), F.struct("ts", "seq", F.col(host_id).alias("id"), "keys")))).alias("hosts"),
        F.array_sort(F.collect_list(F.when(~F.col("__is_host"), F.struct("ts", "seq", F.col(mark_id).alias("id"), "keys")))).alias("marks"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in cluster.schema.fields}
    out = f"array<struct<host:{kinds[host_id]},mark:{kinds[mark_id]},gap:bigint,ts_ns:bigint,m_ts:bigint>>"
    state = f"struct<free:{made.schema['marks'].dataType.simpleString()},taken:{out}>"
    fits = lambda h, m: (F.abs(m.ts - h.ts) <= tol_ns) & F.coalesce(F.arrays_overlap(h["keys"], m["keys"]), F.lit(False))

    def choose(acc, h):
        near = F.array_min(F.transform(F.filter(acc.free, lambda m: fits(h, m)), lambda m: F.struct(F.abs(m.ts - h.ts).alias("gap"), m.ts.alias("ts"), m.seq.alias("seq"), m.id.alias("id"))))
        pair = F.struct(h.id.alias("host"), near.id.alias("mark"), near.gap.alias("gap"), h.ts.alias("ts_ns"), near.ts.alias("m_ts"))
        after = F.struct(F.filter(acc.free, lambda m: m.id != near.id).alias("free"), F.concat(acc.taken, F.array(pair)).alias("taken"))
        return F.when(near.isNull(), acc).otherwise(after.cast(state))

    none = F.struct(F.col("marks").alias("free"), F.array().cast(out).alias("taken")).cast(state)
    chosen = made.select(*by, F.explode(F.aggregate("hosts", none, choose, lambda acc: acc.taken)).alias("x"))
    return chosen.select(*by, F.col("x.host").alias(host_id), F.col("x.mark").alias(mark_id), "x.gap", "x.ts_ns", "x.m_ts")


def _walk(cluster: DataFrame, by: list[str], host_id: str, mark_id: str, tol_ns: int) -> DataFrame:
    """As ``_fold``, for clusters of any size: rows are read in time order, and a host chooses as soon as all marks
    in its reach were read.  Each key's marks are a sorted list that skips the taken ones; only marks that hosts
    to come may still reach are held."""
    group = [*by, "__cluster"]
    ident = Window.partitionBy(*group, "__is_host", F.struct(host_id, mark_id))
    place = Window.partitionBy(*group).orderBy("__is_host", "ts", "seq", host_id, mark_id)
    rows = settle(cluster.filter("ts IS NOT NULL").withColumn("__at", F.row_number().over(place)).withColumns(
        {"__same": F.min("__at").over(ident), "__twice": F.count(F.lit(1)).over(ident) > 1}))
    held = HELD_ROWS

    def walked(rows):
        import bisect
        from collections import deque

        marks, lists, same, spent = {}, {}, {}, set()
        waiting, out = deque(), []
        limit = held

        def put(at, alike, twice, ts, keys):
            # Ahead and back, place i + 1 of a list is its mark i; the two ends stand for none.
            spots = []
            for key in keys or ():
                if key is not None:
                    times, ats, ahead, back = lists.setdefault(key, ([], [], [0, 1], [0, 1]))
                    spots.append((key, len(times)))
                    times.append(ts)
                    ats.append(at)
                    ahead.append(len(times) + 1)
                    back.append(len(times) + 1)
            marks[at] = (spots, alike, twice, ts, keys)
            same.setdefault(alike, []).append(at)

        def skip(steps, i):
            end = i
            while steps[end] != end:
                end = steps[end]
            while steps[i] != end:
                steps[i], i = end, steps[i]
            return end

        def choose(at, ts, keys):
            best = None
            for key in keys or ():
                if key not in lists:
                    continue
                times, ats, ahead, back = lists[key]
                here = bisect.bisect_left(times, ts) + 1
                later = skip(ahead, here)
                before = skip(back, here - 1)
                if before > 0:  # of the marks of that moment the first
                    before = skip(ahead, bisect.bisect_left(times, times[before - 1]) + 1)
                for spot in (before, later):
                    if 0 < spot <= len(times) and abs(times[spot - 1] - ts) <= tol_ns:
                        near = (abs(times[spot - 1] - ts), ats[spot - 1])
                        best = near if best is None or near < best else best
            if best is not None:
                out.append((at, best[1]))
                _, alike, twice, _, _ = marks[best[1]]
                if twice:
                    spent.add(alike)
                for gone in same.pop(alike):
                    for key, i in marks.pop(gone)[0]:
                        _, _, ahead, back = lists[key]
                        ahead[i + 1], back[i + 1] = i + 2, i

        for is_host, at, alike, twice, ts, keys in rows:
            while waiting and waiting[0][1] + tol_ns < ts:
                choose(*waiting.popleft())
            if is_host:
                waiting.append((at, ts, keys))
            elif alike not in spent:
                put(at, alike, twice, ts, keys)
                limit -= 1
            if limit <= 0:
                low = (waiting[0][1] if waiting else ts) - tol_ns
                kept = [(at, *m[1:]) for at, m in marks.items() if m[3] >= low]
                for old in (marks, lists, same):
                    old.clear()
                for mark in kept:
                    put(*mark)
                limit = max(held, len(kept))
            if len(out) >= 10_000:
                yield out
                out = []
        while waiting:
            choose(*waiting.popleft())
        if out:
            yield out

    slim = rows.select(*group, "__is_host", "__at", "__same", "__twice", "ts", "keys")
    shape = StructType([*[slim.schema[c] for c in group], StructField("host_at", LongType()), StructField("mark_at", LongType())])
    made = to_arrow_schema(shape)

    def walk(batches):
        from itertools import groupby

        import pyarrow as pa

        width = len(group)
        listed = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for key, part in groupby(listed, lambda row: row[:width]):
            for pairs in walked(row[width:] for row in part):
                columns = [*[[k] * len(pairs) for k in key], *zip(*pairs, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, made.types, strict=True)], schema=made)

    # Dealt by a given number: few bytes would else be put into one task, however long they take to walk.
    parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    pairs = settle(slim.repartition(max(1, parts), *group).sortWithinPartitions(*group, "ts", "__is_host", "__at").mapInArrow(walk, shape))
    h = rows.filter("__is_host").select(*group, F.col("__at").alias("host_at"), host_id, F.col("ts").alias("ts_ns"))
    m = rows.filter("NOT __is_host").select(*group, F.col("__at").alias("mark_at"), mark_id, F.col("ts").alias("m_ts"))
    met = pairs.join(h, [*group, "host_at"]).join(m, [*group, "mark_at"])
    return met.select(*by, host_id, mark_id, F.abs(F.col("m_ts") - F.col("ts_ns")).alias("gap"), "ts_ns", "m_ts")


def nearest_one_to_one(
    hosts: DataFrame,
    marks: DataFrame,
    by: list[str],
    host_id: str,
    mark_id: str,
    tol_ns: int,
    *,
    host_keys: str | None = None,
    mark_keys: str | None = None,
    large: bool | None = None,
) -> DataFrame:
    """Match each host, in (ts_ns, seq) order, to the nearest free mark within ``tol_ns``.

    ``host_keys`` / ``mark_keys`` are array columns; ends must share a key.  Both sides
    have ``ts_ns`` and ``seq``.  Ties go to the earlier mark.

    Hosts and marks that a gap of more than ``tol_ns`` parts cannot meet, so both sides fall into
    independent clusters.  Clusters of up to FOLD_ROWS rows are walked in order, all at once, larger ones one
    by one in time order, each by one task that holds what lies within the tolerance.

    Where more than WALK_ROWS rows lie in one stretch of ``tol_ns``, each round every open host names its nearest free mark (two as-of lookups, no
    candidate pairs).  A naming is final if no earlier open host lies within reach of
    that mark, since then nobody ahead of the host can take it.  Hosts that name nothing
    are out for good, because marks only get scarcer.
    """
    one = F.array(F.lit(""))
    h_keys = F.array_distinct(F.col(host_keys)) if host_keys else one
    m_keys = F.array_distinct(F.col(mark_keys)) if mark_keys else one
    text = "array<string>"
    both = hosts.select(*by, F.lit(True).alias("__is_host"), F.col(host_id), F.col("ts_ns").cast("bigint").alias("ts"), F.col("seq").cast("bigint").alias("seq"), h_keys.cast(text).alias("keys")).unionByName(
        marks.select(*by, F.lit(False).alias("__is_host"), F.col(mark_id), F.col("ts_ns").cast("bigint").alias("ts"), F.col("seq").cast("bigint").alias("seq"), m_keys.cast(text).alias("keys")),
        allowMissingColumns=True)
    seen = settle(scan_last(both, by, ["ts", "seq"], F.col("ts"), "__before", large=large))
    opens = F.when(F.col("ts") - F.col("__before") > tol_ns, 1).otherwise(0)
    # Of rows of one instant the one that opens a cluster comes first.
    seen = seen.withColumn("__follows", 1 - opens)
    clustered = settle(scan_sums(seen, by, ["ts", "__follows"], {"__cluster": opens}, large=large).drop("__before", "__follows"))
    stretch = F.floor(F.col("ts") / F.lit(max(tol_ns, 1))).alias("__stretch")
    sizes = settle(clustered.groupBy(*by, "__cluster", stretch).agg(F.count(F.lit(1)).alias("__rows")).groupBy(*by, "__cluster").agg(
        F.sum("__rows").alias("__rows"), F.max("__rows").alias("__most")))
    big = settle(sizes.filter(F.col("__rows") > FOLD_ROWS).drop("__rows", "__most"))
    done = settle(_fold(clustered.join(big, [*by, "__cluster"], "left_anti"), by, host_id, mark_id, tol_ns))
    rest = clustered.join(big, [*by, "__cluster"], "left_semi")
    huge = settle(sizes.filter((F.col("__rows") > FOLD_ROWS) & (F.col("__most") > WALK_ROWS)).drop("__rows", "__most"))
    if not big.isEmpty():
        done = done.unionByName(settle(_walk(rest.join(huge, [*by, "__cluster"], "left_anti"), by, host_id, mark_id, tol_ns)))
    if huge.isEmpty():
        return done
    rest = settle(clustered.join(huge, [*by, "__cluster"], "left_semi"))
    open_hosts = settle(rest.filter("__is_host").select(*by, host_id, F.col("ts").alias("ts_ns"), "seq", F.col("keys").alias("__keys")))
    free = settle(rest.filter("NOT __is_host").select(*by, mark_id, F.col("ts").alias("m_ts"), F.col("seq").alias("m_seq"), F.col("keys").alias("__keys")))
    while True:
        h = open_hosts.withColumn("__key", F.explode("__keys"))
        m = free.withColumn("__key", F.explode("__keys")).withColumn("__back", -F.col("m_seq"))
        m = m.withColumn("m_at", F.struct("m_ts", "m_seq", mark_id))
        key = [*by, "__key"]
        near = asof(h, m.select(*key, "m_ts", "__back", F.col("m_at").alias("c")), key, "ts_ns", "m_ts",
                    ["c"], right_ties=["__back"], large=large).unionByName(
               asof(h, m.select(*key, "m_ts", "m_seq", F.col("m_at").alias("c")), key, "ts_ns", "m_ts",
                    ["c"], right_ties=["m_seq"], forward=True, large=large))
        gap = F.abs(F.col("c.m_ts") - F.col("ts_ns"))
        named = near.filter(F.col("c").isNotNull() & (gap <= tol_ns)).withColumn("gap", gap)
        named = named.groupBy(*by, host_id, "ts_ns", "seq").agg(F.min(F.struct("gap", "c")).alias("best"))
        named = settle(
            named.select(
                *by, host_id, "ts_ns", "seq", "best.gap",
                F.col(f"best.c.{mark_id}").alias(mark_id), F.col("best.c.m_ts").alias("m_ts"),
            )
        )
        if named.isEmpty():
            break
        still = open_hosts.join(named.select(*by, host_id), [*by, host_id], "left_semi")
        # The earliest open host within reach of each named mark, over all of its keys.
        wanted = free.join(named.select(*by, mark_id).distinct(), [*by, mark_id], "left_semi")
        reach = wanted.withColumn("__key", F.explode("__keys")).withColumn("reach_from", F.col("m_ts") - tol_ns)
        ahead = still.withColumn("__key", F.explode("__keys")).select(
            *key, "ts_ns", "seq", F.struct("ts_ns", "seq", host_id).alias("front")
        )
        front = asof(reach, ahead, key, "reach_from", "ts_ns", ["front"], right_ties=["seq"], forward=True, large=large)
        front = front.groupBy(*by, mark_id).agg(F.min("front").alias("front"))
        final = settle(
            named.join(front, [*by, mark_id])
            .filter(F.col(f"front.{host_id}") == F.col(host_id))
            .select(*by, host_id, mark_id, "gap", "ts_ns", "m_ts")
        )
        done = done.unionByName(final)
        open_hosts = settle(still.join(final.select(*by, host_id), [*by, host_id], "left_anti"))
        free = settle(free.join(final.select(*by, mark_id), [*by, mark_id], "left_anti"))
    return done
