"""Binding, matching, scans and closures against plain walks on random small inputs."""

import random

import model
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vestige.operators import binding, callwindows, graph, matching, metrics, segments, timejoin
from vestige.schema import CANONICAL

DDL = ", ".join(f"{n} {k}" for n, k in CANONICAL.items())


def frame(spark, events):
    return spark.createDataFrame([tuple(e.get(n) for n in CANONICAL) for e in events], DDL)


@pytest.mark.parametrize("seed", [1, 2])
def test_binding_equals_ordered_walk(spark, seed):
    rng = random.Random(seed)
    traces = {f"t{i}": model.random_trace(rng, 70, trace=f"t{i}") for i in range(2)}
    df = frame(spark, [e for t in traces.values() for e in t])
    states = binding.bind(df, detector="strict")
    got = binding.attribute(df.select("trace_id", "seq", "ts_ns", "pid"), states).collect()
    want = {(t, s): v for t, evs in traces.items() for s, v in model.walk_states(evs).items()}
    assert {(r.trace_id, r.seq): (r.session, r.server) for r in got} == want


def test_binding_is_free_of_row_order_and_of_clock_shift(spark):
    rng = random.Random(9)
    events = model.random_trace(rng, 70)
    base = {(r.seq): (r.session, r.server) for r in binding.attribute(frame(spark, events), binding.bind(frame(spark, events), detector="strict")).collect()}
    moved = [dict(e, ts_ns=e["ts_ns"] + 10**15) for e in events]
    rng.shuffle(moved)
    other = frame(spark, moved + model.random_trace(rng, 40, trace="foreign"))
    got = binding.attribute(other, binding.bind(other, detector="strict")).filter("trace_id = 't'").collect()
    assert {r.seq: (r.session, r.server) for r in got} == base


def test_tool_calls_open_and_close(spark):
    rows = [
        dict(seq=0, ts_ns=10, pid=1, event="execve", path="/c/claude", argv=["claude", "-p", "x"]),
        dict(seq=1, ts_ns=20, pid=1, event="sched_fork", parent_pid=1, child_pid=2),
        dict(seq=2, ts_ns=30, pid=2, event="execve", path="/m", argv=["mcp-server-a"]),
    ]
    call, reply = '{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"go"}}', '{"jsonrpc":"2.0","id":1,"result":1}'
    import base64

    enc = lambda s: base64.b64encode(s.encode()).decode()
    rows += [
        dict(seq=3, ts_ns=40, pid=1, event="sendto", buf=enc(call)),
        dict(seq=4, ts_ns=50, pid=2, event="openat", path="/x", flags=0),
        dict(seq=5, ts_ns=60, pid=2, event="sendto", buf=enc(reply)),
        dict(seq=6, ts_ns=70, pid=2, event="openat", path="/y", flags=0),
        dict(seq=7, ts_ns=80, pid=1, event="sendto", buf=enc(call)),
        dict(seq=8, ts_ns=90, pid=1, event="sendto", buf="%%%"),
    ]
    df = frame(spark, [dict(r, trace_id="t", tid=r["pid"]) for r in rows])
    p = {r.seq: (r.session, r.mcp, r.tool_call) for r in binding.predictions(df, detector="layered", loose_reply=False).collect()}
    server = "mcp_0_mcp-server-a"
    assert p[4] == ("sess_0", server, "tc_0") and p[6] == ("sess_0", server, "")
    assert p[3] == ("sess_0", "", "") and p[2] == ("sess_0", server, "")


@pytest.mark.parametrize("seed,fold", [(1, 200), (2, 200), (1, 3), (2, 0)])
def test_nearest_matching_equals_sequential_greedy(spark, monkeypatch, seed, fold):
    monkeypatch.setattr(matching, "FOLD_ROWS", fold)
    rng = random.Random(seed)
    names = [["a"], ["b"], ["a", "b"], ["c"]]
    hosts = [(i, rng.randrange(0, 900), i, rng.choice(names)) for i in range(30)]
    marks = [(100 + i, rng.randrange(0, 900), i, rng.choice(names)) for i in range(30)]
    h = spark.createDataFrame([("t", *x) for x in hosts], "g string, h int, ts_ns bigint, seq int, k array<string>")
    m = spark.createDataFrame([("t", *x) for x in marks], "g string, m int, ts_ns bigint, seq int, k array<string>")
    got = matching.nearest_one_to_one(h, m, ["g"], "h", "m", 60, host_keys="k", mark_keys="k").collect()
    assert {r.h: r.m for r in got} == model.nearest_greedy(hosts, marks, 60)


def test_greedy_map_and_scores_equal_sequential(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["", "a", "b", "c", "d"]), rng.choice(["", "x", "y", "z"])) for _ in range(200)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "i int, t string, p string")
    table = metrics.contingency(df, [], "t", "p", "i").withColumn("g", F.lit(1))
    got = {r.p: r.mapped for r in metrics.class_map(table, ["g"], "compat").collect()}
    want = model.greedy_map(rows)
    assert got == want
    s = metrics.cluster_scores(df, [], "t", "p", mode="compat", order="i").first()
    tp = sum(1 for t, p in rows if t and want.get(p, "") == t)
    fn = sum(1 for t, p in rows if t and (not p or want.get(p, "") != t))
    assert (s.tp, s.fn) == (tp, fn)


def test_strict_scores_do_not_reward_empty_predictions(spark):
    df = spark.createDataFrame([("a", "")] * 5 + [("", "")], "t string, p string")
    strict = metrics.cluster_scores(df, [], "t", "p").first()
    compat = metrics.cluster_scores(df, [], "t", "p", mode="compat").first()
    assert (strict.tp, strict.fn, strict.f1) == (0, 5, 0.0)
    assert compat.tp == 5 and compat.fn == 5
    none = spark.createDataFrame([("", "")] * 4, "t string, p string")
    assert metrics.cluster_scores(none, [], "t", "p").first().ari is None
    assert metrics.cluster_scores(none, [], "t", "p", mode="compat").first().ari == 1.0


def test_scans_agree_however_groups_are_split(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(0, 50), i, rng.choice([None, rng.randrange(9)])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, ts bigint, i int, v int")
    results = []
    for most in (4, 25, 1000):
        monkeypatch.setattr(segments, "SPLIT_ROWS", most)
        a = segments.scan_last(df, ["g"], ["ts", "i"], F.col("v"), "prev")
        a = segments.scan_next(a, ["g"], ["ts", "i"], F.col("v"), "nxt")
        a = segments.ordinal(a, ["g"], ["ts", "i"], "n")
        a = segments.scan_max(a, ["g"], ["ts", "i"], "v", "top")
        results.append(sorted((r.i, r.prev, r.nxt, r.n, r.top) for r in a.collect()))
    assert results[0] == results[1] == results[2]
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    for i, prev, nxt, n, top in results[0]:
        me = next(r for r in rows if r[2] == i)
        group = [r for r in order if r[0] == me[0]]
        at = group.index(me)
        seen = [r[3] for r in group[:at] if r[3] is not None]
        later = [r[3] for r in group[at + 1:] if r[3] is not None]
        assert (prev, nxt, n, top) == (seen[-1] if seen else None, later[0] if later else None, at + 1, max(seen) if seen else None)


def test_interval_first_match_with_nested_windows(spark):
    rng = random.Random(6)
    wins = [(i, rng.randrange(0, 80), rng.choice([-1, 5, 20, 60])) for i in range(15)]
    wins = [(i, lo, lo + d if d > 0 else -1) for i, lo, d in wins]
    w = spark.createDataFrame([("g", *x) for x in wins], "g string, id int, lo bigint, hi bigint")
    e = spark.range(0, 120).selectExpr("'g' AS g", "id AS ts")
    got = {r.ts: r.id for r in timejoin.in_window(e, w, ["g"], "ts", "lo", "hi", "id").collect()}
    for ts in range(120):
        fit = sorted((lo, i) for i, lo, hi in wins if lo <= ts and (hi <= 0 or ts <= hi))
        assert got[ts] == (fit[0][1] if fit else None)


def test_forest_lookup_survives_depth_cycles_and_hot_parents(spark):
    chain = [("t", i, i - 1) for i in range(1, 400)]
    star = [("t", 1000 + i, 399) for i in range(300)]
    loop = [("t", 5001, 5002), ("t", 5002, 5001)]
    parents = spark.createDataFrame(chain + star + loop, "trace_id string, child bigint, parent bigint")
    roots = spark.createDataFrame([("t", 0), ("t", 200)], "trace_id string, node bigint")
    old, graph.HOT_ROWS = graph.HOT_ROWS, 50
    graph.lookup.__defaults__ = ("left", 50)
    try:
        got = {r.node: (r.root, r.depth) for r in graph.descendants(parents, roots).collect()}
    finally:
        graph.HOT_ROWS = old
        graph.lookup.__defaults__ = ("left", old)
    assert got[199] == (0, 199) and got[200] == (200, 0) and got[399] == (200, 199) and got[1005] == (200, 200)
    assert 5001 not in got and len(got) == 700


def test_agent_partition(spark):
    rows = [
        (0, 1, "openat", None), (1, 2, "execve", ["claude", "-p"]), (2, 2, "clone", None), (3, 3, "openat", None),
        (4, 1, "openat", None), (5, 4, "clone", None), (6, 5, "openat", None), (7, 3, "execve", ["claude", "-p"]), (8, 3, "openat", None),
    ]
    df = frame(spark, [dict(trace_id="t", seq=i, ts_ns=i * 10**9, pid=p, event=e, argv=a) for i, p, e, a in rows])
    got = {r.seq: r.session for r in binding.partition_by_agent(df).collect()}
    assert got == {0: "preroot", 1: "session_0", 2: "session_0", 3: "session_0", 4: "preroot", 5: "preroot", 6: "preroot", 7: "session_1", 8: "session_1"}


def test_exact_ranks_on_skewed_values(spark):
    values = [1.0] * 50 + [float(i) for i in range(40)] + [1e9]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    row = metrics.exact_ranks(df, [], "v", {"p50": metrics.percentile_floor(0.5), "p95": metrics.percentile_of_count(0.95)}).first()
    s = sorted(values)
    assert (row.n, row.p50, row.p95) == (len(s), s[int(0.5 * (len(s) - 1))], s[int(0.95 * len(s))])


def test_a_hot_key_is_cut_by_rows_whatever_its_clock(spark, monkeypatch):
    monkeypatch.setattr(segments, "SPLIT_ROWS", 500)
    clocks = {"dense": "id % 3", "sparse": "id * 86400000000000", "lines": "id", "bursts": "floor(id / 1000) * 1000000000 + id % 1000"}
    for name, clock in clocks.items():
        df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'cold' || id % 200 ELSE 'hot' END AS g", f"CAST({clock} AS BIGINT) AS ts", "id AS i", "CASE WHEN id % 7 = 0 THEN id END AS v")
        cut = segments._with_segment(df, ["g"], ["ts", "i"], None)
        sizes = [r["count"] for r in cut.groupBy("g", segments._SEG).count().collect()]
        assert max(sizes) <= 4 * 500, (name, max(sizes))
        got = segments.ordinal(segments.scan_last(df, ["g"], ["ts", "i"], F.col("v"), "prev"), ["g"], ["ts", "i"], "n")
        w = Window.partitionBy("g").orderBy("ts", "i")
        want = df.withColumn("prev", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.row_number().over(w).cast("bigint"))
        cols = ["g", "ts", "i", "prev", "n"]
        assert got.select(*cols).exceptAll(want.select(*cols)).isEmpty() and want.select(*cols).exceptAll(got.select(*cols)).isEmpty()


def test_an_asof_of_null_keys_and_large_groups(spark, monkeypatch):
    left = spark.createDataFrame([(k, t) for k in ("a", "b", None) for t in range(0, 60, 3)], "k string, t bigint")
    right = spark.createDataFrame([(k, t, t * 10) for k in ("a", None) for t in range(0, 60, 7)], "k string, rt bigint, x bigint")
    results = []
    for most in (5, 1000):
        monkeypatch.setattr(segments, "SPLIT_ROWS", most)
        results.append(sorted(((r.k or "~", r.t, r.x) for r in timejoin.asof(left, right, ["k"], "t", "rt", ["x"]).collect()), key=str))
    assert results[0] == results[1] == sorted(((k, t, t // 7 * 70 if k == "a" else None) for k in ("a", "b", "~") for t in range(0, 60, 3)), key=str)


def odd_windows(seed):
    rng = random.Random(seed)
    wins = []
    for g in "ab":
        for i in range(25):
            lo = rng.randrange(0, 200)
            wins.append((g, i, lo, lo + rng.choice([-3, 0, 1, 4, 15, 60])))
    wins += [("a", 90, 50, 50), ("a", 91, 50, 70), ("a", 92, 50, 70), ("only", 1, 0, 9)]
    events = [(rng.choice("ab"), rng.randrange(0, 260), rng.choice([None, 1, 2, 3, 4, 5, 6])) for _ in range(300)]
    return wins, events


def test_distinct_keys_inside_windows(spark, monkeypatch):
    for seed, most in ((1, 1000), (2, 20)):
        monkeypatch.setattr(segments, "SPLIT_ROWS", most)
        wins, events = odd_windows(seed)
        w = spark.createDataFrame(wins, "g string, id int, lo bigint, hi bigint")
        e = spark.createDataFrame(events, "g string, ts bigint, key int")
        got = {(r.g, r.id): r.n for r in timejoin.distinct_inside(e, w, ["g"], "ts", "lo", "hi", "id", "key", "n").collect()}
        want = {(g, i): len({k for eg, t, k in events if eg == g and k is not None and lo <= t <= hi}) for g, i, lo, hi in wins if hi >= lo}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_consecutive_windows_without_a_shared_key(spark, monkeypatch):
    for seed, most in ((3, 1000), (4, 1000), (5, 20)):
        monkeypatch.setattr(segments, "SPLIT_ROWS", most)
        wins, events = odd_windows(seed)
        w = spark.createDataFrame(wins, "g string, use_id int, lo bigint, hi bigint")
        e = spark.createDataFrame(events, "g string, ts_ns bigint, tid int")
        got = {r.g: (r.pairs, r.disjoint) for r in callwindows.consecutive_overlap(e, w, ["g"]).collect()}
        want = {}
        for g in {x[0] for x in wins}:
            ranked = sorted((lo, hi, i) for eg, i, lo, hi in wins if eg == g)
            used = [{k for eg, t, k in events if eg == g and k is not None and lo <= t <= hi} if hi > lo else set() for lo, hi, _ in ranked]
            both = [(a, b) for a, b in zip(used, used[1:]) if a and b]
            if both:
                want[g] = (len(both), sum(not a & b for a, b in both))
        assert got == want


def test_reachable_over_chains_and_shared_children(spark):
    rng = random.Random(11)
    edges = {("t", i, i + 1) for i in range(3000)} | {("t", 3000 + rng.randrange(60), 3000 + rng.randrange(60)) for _ in range(90)} | {("t", 500, 3010), ("t", 3010, 20), ("u", 1, 2), ("u", 2, 1), ("u", 5, 5)}
    roots = {("t", 3), ("t", 3005), ("u", 2), ("u", 5)}
    want, frontier, depth = {r: 0 for r in roots}, set(roots), 0
    down = {}
    for g, a, b in edges:
        down.setdefault((g, a), set()).add((g, b))
    while frontier:
        depth += 1
        frontier = {n for f in frontier for n in down.get(f, ())} - set(want)
        want.update({n: depth for n in frontier})
    e = spark.createDataFrame(sorted(edges), "trace_id string, parent int, child int")
    r = spark.createDataFrame(sorted(roots), "trace_id string, node int")
    assert {(x.trace_id, x.node): x.depth for x in graph.reachable(e, r).collect()} == want
