"""The sets behind seeded pairs are read once."""

from vestige.plans import audit


def stored(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return spark.read.parquet(str(path))


def reads(df, path):
    return [f for f in df.inputFiles() if str(path) in f]


def test_neighbour_jaccard_reads_its_sets_once(spark, tmp_path):
    sets = stored(spark, tmp_path / "sets", [("g", 1, "a"), ("g", 1, "b"), ("g", 1, "b"), ("g", 2, "b"), ("g", 2, "c")], "g string, key long, item string")
    got = audit.neighbour_jaccard(sets, "key", "item", ["g"])
    assert not reads(got, tmp_path / "sets")
    assert [(r.n_both, r.jaccard) for r in got.collect()] == [(1, 1 / 3)]
