"""Binding over long chains of forks: few rounds, and the same states whichever way they are found."""

import logging
import random

import model
import pytest
from test_core import frame

from vestige.operators import binding


def test_a_long_chain_takes_few_rounds(spark, caplog):
    rows = [dict(seq=0, ts_ns=0, pid=1, event="execve", path=model.AGENT, argv=[model.AGENT, "-p", "x"])]
    rows += [dict(seq=i, ts_ns=10**9, pid=i, event="sched_fork", parent_pid=i, child_pid=i + 1) for i in range(1, 60)]
    df = frame(spark, [dict(r, trace_id="t", tid=r["pid"]) for r in rows])
    with caplog.at_level(logging.INFO, logger="vestige.operators.binding"):
        states = binding.bind(df, detector="strict")
    assert sorted((r.pid, r.session) for r in states.collect()) == [(i, "sess_0") for i in range(1, 61)]
    assert len([r for r in caplog.records if "binding round" in r.getMessage()]) <= binding.PLAIN_ROUNDS + 3


@pytest.mark.parametrize("slab", [7, 1000])
def test_walked_stretches_equal_ordered_walk(spark, monkeypatch, slab):
    monkeypatch.setattr(binding, "PLAIN_ROUNDS", 0)
    monkeypatch.setattr(binding, "SLAB_ROWS", slab)
    rng = random.Random(slab)
    traces = {f"t{i}": model.random_trace(rng, 70, trace=f"t{i}") for i in range(2)}
    df = frame(spark, [e for t in traces.values() for e in t])
    got = binding.attribute(df.select("trace_id", "seq", "ts_ns", "pid"), binding.bind(df, detector="strict")).collect()
    want = {(t, s): v for t, evs in traces.items() for s, v in model.walk_states(evs).items()}
    assert {(r.trace_id, r.seq): (r.session, r.server) for r in got} == want
