"""Host and oracle traces so dense that no gap parts their execs, and forests of long traces."""

import random

import model
import pytest

from vestige.operators import graph, matching

HOSTS, MARKS = "g string, h int, ts_ns bigint, seq int, k array<string>", "g string, m int, ts_ns bigint, seq int, k array<string>"


@pytest.mark.parametrize("seed,held", [(1, 20_000), (2, 1), (3, 7)])
def test_a_long_dense_cluster_takes_no_rounds(spark, monkeypatch, seed, held):
    """The cluster has more rows than WALK_ROWS; no stretch of the tolerance has."""
    monkeypatch.setattr(matching, "FOLD_ROWS", 3)
    monkeypatch.setattr(matching, "WALK_ROWS", 60)
    monkeypatch.setattr(matching, "HELD_ROWS", held, raising=False)
    monkeypatch.setattr(matching, "asof", None)  # the rounds look marks up with it
    rng = random.Random(seed)
    names = [["a"], ["b"], ["a", "b"], ["c"], [], ["a", "a"]]
    hosts = [(i, rng.randrange(0, 400) * 5, i, rng.choice(names)) for i in range(300)]
    marks = [(1000 + i, rng.randrange(0, 400) * 5, i, rng.choice(names)) for i in range(300)]
    h = spark.createDataFrame([("t", *x) for x in hosts], HOSTS)
    m = spark.createDataFrame([("t", *x) for x in marks], MARKS)
    got = matching.nearest_one_to_one(h, m, ["g"], "h", "m", 40, host_keys="k", mark_keys="k").collect()
    assert {r.h: r.m for r in got} == model.nearest_greedy(hosts, marks, 40)
    assert all(r.gap == abs(r.m_ts - r.ts_ns) <= 40 for r in got)


def test_a_mark_that_comes_twice_is_taken_once(spark, monkeypatch):
    """Also where its rows lie farther apart than the tolerance, and the first is cleared away in between."""
    monkeypatch.setattr(matching, "FOLD_ROWS", 3)
    monkeypatch.setattr(matching, "HELD_ROWS", 1, raising=False)
    h = spark.createDataFrame([("t", i, i * 10, i, ["a"]) for i in range(40)], HOSTS)
    twice = [(100, 0), (100, 300), (101, 301)]
    m = spark.createDataFrame([("t", i, ts, i, ["a"]) for i, ts in twice], MARKS)
    got = matching.nearest_one_to_one(h, m, ["g"], "h", "m", 15, host_keys="k", mark_keys="k").collect()
    assert sorted((r.h, r.m, r.m_ts) for r in got) == [(0, 100, 0), (29, 101, 301)]


def test_forest_orders_first_sightings_and_clones_only(spark, monkeypatch):
    rows = []
    plain = graph.scan_last
    monkeypatch.setattr(graph, "scan_last", lambda df, *a, **kw: rows.append(df.count()) or plain(df, *a, **kw))
    rng = random.Random(5)
    calls = [(rng.randrange(0, 300), i, rng.randrange(1, 40), rng.choice(["openat"] * 6 + ["clone", "clone3", "execve"])) for i in range(600)]
    calls.sort(key=lambda x: x[:2])
    e = spark.createDataFrame([("t", *x, None) for x in calls], "trace_id string, ts_ns bigint, seq bigint, pid bigint, event string, cgroup_id bigint")
    got = {r.pid: r.parent for r in graph.inferred_forest(e, 12).collect()}
    want, last = {}, None
    for ts, _, pid, event in calls:
        want.setdefault(pid, last[1] if last and ts - last[0] <= 12 else None)
        if event.startswith("clone"):
            last = (ts, pid)
    assert got == want
    assert rows == [len(want) + sum(x[3].startswith("clone") for x in calls)]
