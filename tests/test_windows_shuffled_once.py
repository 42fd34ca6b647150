"""Different keys inside windows: the last digits of a rank are looked up after one shuffle."""

import random

from vestige.operators import segments, timejoin


def small(spark):
    rng = random.Random(8)
    events = [(rng.choice("ab"), rng.randrange(300), rng.randrange(12)) for _ in range(400)] + [(None, 5, 1), ("a", 5, None)]
    windows = [("a" if k % 3 else "b", k, lo, lo + rng.randrange(-1, 90)) for k in range(60) for lo in [rng.randrange(-20, 320)]]
    want = {(g, k): len({key for t, ts, key in events if t == g and lo <= ts <= hi and key is not None}) for g, k, lo, hi in windows if lo <= hi}
    return spark.createDataFrame(events, "g string, ts bigint, key bigint"), spark.createDataFrame(windows, "g string, id bigint, lo bigint, hi bigint"), want


def counted(spark):
    e, w, want = small(spark)
    got = timejoin.distinct_inside(e, w, ["g"], "ts", "lo", "hi", "id", "key", "n").collect()
    assert {(r.g, r.id): r.n for r in got} == want


def test_digits_are_dealt_out_together(spark, monkeypatch):
    dealt, kept = [], timejoin.scan_sums

    def scan(df, by, order, values, **kw):
        if len(values) == 7:
            dealt.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, by, order, values, **kw)

    monkeypatch.setattr(timejoin, "scan_sums", scan)
    counted(spark)
    assert len(dealt) == 1  # 400 events have three digits
    assert 0 <= dealt[0].find("Generate explode") < dealt[0].find("RepartitionByExpression")  # levels are made after the shuffle


def test_any_number_of_digits_and_segments(spark, monkeypatch):
    for rows, joint in ((1_000_000, 1), (40, 1), (40, 5)):
        monkeypatch.setattr(segments, "SPLIT_ROWS", rows)
        monkeypatch.setattr(timejoin, "JOINT_DIGITS", joint)
        counted(spark)

