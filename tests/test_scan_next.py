"""The next value of a group, without a frame that Spark evaluates anew for every row."""

from pyspark.sql import functions as F

from vestige.operators import segments


def test_next_is_read_backwards(spark):
    rows = [("a", i, i if i % 3 == 0 else None) for i in range(10)] + [("b", 1, 7)]
    df = spark.createDataFrame(rows, "g string, t int, x int")
    got = segments.scan_next(df, ["g"], ["t"], F.col("x"), "n")
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    want = {("a", i): next((j for j in range(i + 1, 10) if j % 3 == 0), None) for i in range(10)} | {("b", 1): None}
    assert {(r.g, r.t): r.n for r in got.collect()} == want
