"""Cohesion reads its touches once; null targets are never shared."""

from vestige.operators import cohesion


def stored(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return spark.read.parquet(str(path))


def reads(df, path):
    return [f for f in df.inputFiles() if str(path) in f]


def test_cohesion_reads_its_touches_once_and_never_shares_null(spark, tmp_path):
    touches = stored(spark, tmp_path / "touches", [("t", 1, "a"), ("t", 1, "b"), ("t", 1, "b"), ("t", 1, None), ("t", 2, "a"), ("t", 2, None), ("t", 3, "c"), ("u", 1, "a")],
                     "trace_id string, pid long, target string")
    members = spark.createDataFrame([("t", "s", 1), ("t", "s", 1), ("t", "s", 2), ("t", "s", 3), ("t", "s", 4), ("t", "r", 1), ("u", "s", 1)], "trace_id string, session_id string, pid long")
    exempt = spark.createDataFrame([("t", "s", 2)], "trace_id string, session_id string, pid long")
    got = cohesion.cohesion(touches, members, exempt, ["trace_id"])
    assert not reads(got, tmp_path / "touches")
    assert {(r.trace_id, r.session_id, r.pid): (r.n_targets, r.n_shared, r.score, r.demoted) for r in got.collect()} == {
        ("t", "s", 1): (3, 1, 1 / 3, False), ("t", "s", 3): (1, 0, 0.0, True), ("t", "s", 4): (None, None, None, False),
        ("t", "r", 1): (3, 0, 0.0, True), ("u", "s", 1): (1, 0, 0.0, True)}
