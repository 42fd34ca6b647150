"""Bursts of activity as a stream and as a batch; rounds of the binding fixpoint."""

import logging
import random

import model
from test_core import frame

from vestige.operators import binding, timejoin
from vestige.streaming import hooks

MINUTE = 60 * 10**9


def bursts(events, gap):
    out = []
    for key in {(t, p) for t, p, _ in events}:
        times = sorted(ts for t, p, ts in events if (t, p) == key)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > gap:
                out.append((*key, times[start], times[i - 1] + gap, i - start))
                start = i
    return sorted(out)


def test_stream_and_batch_find_the_same_bursts(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.choice("ab"), rng.randrange(3), rng.randrange(0, 200) * MINUTE // 2 + 10**15) for _ in range(150)]
    events += [("a", 7, 10**15), ("a", 7, 10**15 + 5 * MINUTE), ("a", 7, 10**15 + 10 * MINUTE - 1000)]
    schema = "trace_id string, pid bigint, ts_ns bigint"
    got = timejoin.islands(spark.createDataFrame(events, schema), ["trace_id", "pid"], "ts_ns", 5 * MINUTE)
    want = bursts(events, 5 * MINUTE)
    assert sorted(tuple(r[c] for c in ("trace_id", "pid", "start", "end", "n")) for r in got.collect()) == want
    rng.shuffle(events)
    for part in (events[:60], events[60:110], events[110:], [("z", 0, 10**15 + 900 * MINUTE)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = hooks.activity_bursts(stream, "5 minutes", "150 minutes")
    q = told.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(tuple(r) for r in spark.table("bursts").collect()) == want
    assert q.lastProgress.stateOperators[-1].numRowsTotal <= 1  # closed bursts leave the state


def test_rounds_ask_ever_fewer_operations(spark, caplog):
    """A chain of forks: a round tells one generation on, and nobody else is asked again."""
    rows = [dict(seq=0, ts_ns=0, pid=1, event="execve", path=model.AGENT, argv=[model.AGENT, "-p", "x"])]
    rows += [dict(seq=i, ts_ns=i * 10**9, pid=i, event="sched_fork", parent_pid=i, child_pid=i + 1) for i in range(1, 6)]
    rows += [dict(seq=100 + i, ts_ns=i, pid=500 + i, event="sched_fork", parent_pid=500 + i, child_pid=700 + i) for i in range(50)]
    df = frame(spark, [dict(r, trace_id="t", tid=r["pid"]) for r in rows])
    with caplog.at_level(logging.INFO, logger="vestige.operators.binding"):
        states = binding.bind(df, detector="strict")
    assert sorted(r.pid for r in states.collect()) == [1, 2, 3, 4, 5, 6]
    asked = [int(r.getMessage().split()[3]) for r in caplog.records if "binding round" in r.getMessage()]
    assert asked == [1, 1, 1, 1, 1, 0]
