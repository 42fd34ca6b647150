"""Few edges are walked at once instead of a round per step of a chain."""

import logging

import model
from test_core import frame

from vestige.operators import binding


def test_few_edges_take_one_plain_round_and_one_walk(spark, caplog):
    rows = [dict(seq=0, ts_ns=0, pid=1, event="execve", path=model.AGENT, argv=[model.AGENT, "-p", "x"])]
    rows += [dict(seq=i, ts_ns=10**9 + i, pid=i, event="sched_fork", parent_pid=i, child_pid=i + 1) for i in range(1, 8)]
    df = frame(spark, [dict(r, trace_id="t", tid=r["pid"]) for r in rows])
    with caplog.at_level(logging.INFO, logger="vestige.operators.binding"):
        states = binding.bind(df, detector="strict")
    assert sorted((r.pid, r.session) for r in states.collect()) == [(i, "sess_0") for i in range(1, 9)]
    assert len([r for r in caplog.records if "binding round" in r.getMessage()]) == 2
