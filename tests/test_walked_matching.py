"""Matching in time: clusters too large for the fold are walked, whatever their number of rounds."""

import random

import model
import pytest

from vestige.operators import matching


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walked_clusters_equal_the_sequential_choice(spark, monkeypatch, seed):
    monkeypatch.setattr(matching, "FOLD_ROWS", 3)
    rng = random.Random(seed)
    names = [["a"], ["b"], ["a", "b"], ["c"], [], ["a", "a"]]
    hosts = [(i, rng.randrange(0, 60) * 10, i, rng.choice(names)) for i in range(50)]
    marks = [(100 + i, rng.randrange(0, 60) * 10, i, rng.choice(names)) for i in range(50)]
    h = spark.createDataFrame([("t", *x) for x in hosts], "g string, h int, ts_ns bigint, seq int, k array<string>")
    m = spark.createDataFrame([("t", *x) for x in marks], "g string, m int, ts_ns bigint, seq int, k array<string>")
    got = matching.nearest_one_to_one(h, m, ["g"], "h", "m", 40, host_keys="k", mark_keys="k").collect()
    assert {r.h: r.m for r in got} == model.nearest_greedy(hosts, marks, 40)


def test_a_crowd_of_one_moment_takes_no_rounds(spark, monkeypatch):
    """Each round of the old loop settled one host of a crowd."""
    monkeypatch.setattr(matching, "asof", None)  # the rounds look marks up with it
    h = spark.range(300).selectExpr("'t' AS g", "id AS h", "1000 AS ts_ns", "id AS seq")
    m = spark.range(300).selectExpr("'t' AS g", "id + 1000 AS m", "1000 + id % 7 AS ts_ns", "id AS seq")
    got = {r.h: r.m for r in matching.nearest_one_to_one(h, m, ["g"], "h", "m", 50).collect()}
    want = sorted(range(300), key=lambda i: (i % 7, i))
    assert got == {i: 1000 + x for i, x in enumerate(want)}
