"""What the training-data operators share: landed tables, names that cannot clash, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.session import settle

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def land(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the folder of ``spark.checkpoint.dir`` and reads it back.

    The shuffle files of the plan that writes go when it is done; they would fill the disk until
    the driver happens to collect garbage.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return settle(df)
    finally:
        conf.set(key, before)


def text_batches(df: DataFrame) -> DataFrame:
    """Lets Python tasks of this session take at most 1000 rows at a time: texts are long, executors small."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= 1000:
        conf.set(key, "1000")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays.  Texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` and the columns ``made``, each computed once a row.

    A plain projection may be merged into later expressions and then run again for every element
    of an array; a generator of one row is not merged.
    """
    whole = F.struct(*[c.alias(n) for n, c in made.items()])
    return df.select("*", F.explode(F.array(whole)).alias("once_")).select(*df.columns, *[F.col(f"once_.{n}").alias(n) for n in made])


def with_columns(df: DataFrame, **new: Column) -> DataFrame:
    """``df`` and ``new`` columns; a column of ``df`` that has one of the names gives way."""
    taken = {n.lower() for n in new}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, *[c.alias(n) for n, c in new.items()])


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b; both long) reaches.

    Large-star / small-star rounds: every node hooks its larger neighbours, then itself and its
    smaller neighbours, onto the smallest one.  Rounds grow with the logarithm of the longest
    path; each round is two groupings of the edges, landed in the shared folder.  Only the count
    of changed edges comes to the driver.
    """
    now = land(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        now = land(small)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
