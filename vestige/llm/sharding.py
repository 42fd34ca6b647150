"""Proportional stratified interleaving into shards.

Rows of every source are shuffled by a seed, ranked, and given the fraction of their source that
lies before them.  Sorting all rows by that fraction interleaves the sources in proportion, so
that any run of the sorted rows holds the mixture; equal cuts of it are the shards.

No window holds a source, let alone the table: ranks come from a coarse bucket of the sort key
(rows counted per bucket, buckets added up) and a rank inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vestige.llm.common import land

# Fixed numbers of coarse buckets; the tables of bucket counts have this many rows per group at most.
SOURCE_BUCKETS = 4096
FRACTION_BUCKETS = 16384


def positions(rows: DataFrame, by: list[str], bucket: str, order: list[str]) -> DataFrame:
    """``rows`` with ``before`` (rows of the same ``by`` that sort earlier) and ``total``.

    ``bucket`` must not decrease along ``order``.
    """
    keys = [*by, bucket]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)],
                           F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("offset_"),
                           F.sum("n_").over(group).alias("total"))
    inside = rows.withColumn("inside_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    on = [inside[k] == counts[f"k{i}_"] for i, k in enumerate(keys)]
    return inside.join(counts, on).select(*rows.columns, (F.col("inside_") + F.col("offset_")).alias("before"), "total")


def interleave(rows: DataFrame, n_shards: int, source: Column, tie: list[Column], seed: int = 17) -> DataFrame:
    """Every row of ``rows`` with its ``shard`` (int) and its ``slot`` in the shard (long, gapless from 0).

    Shards differ by one row at most, and so do the rows of a source that two shards of equal
    length hold, up to rounding.  ``tie`` names what tells rows apart; rows equal in all of it
    are interchangeable.  A null source is a source of its own.  An empty table gives no rows.
    Columns of ``rows`` called shard or slot are replaced.
    """
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-")).alias("stratum"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(t.cast("string"), F.lit("~")) for t in tie])).alias("draw"))
    packed = packed.withColumn("draw_bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    packed = land(packed)
    ranked = positions(packed, ["stratum"], "draw_bucket", ["draw"])
    spread = ranked.select("row", "stratum", "draw", ((F.col("before") * 2 + 1) / (F.col("total") * 2)).alias("part"))
    spread = spread.withColumn("part_bucket", F.least(F.floor(F.col("part") * FRACTION_BUCKETS), F.lit(FRACTION_BUCKETS - 1)).cast("int"))
    placed = positions(spread, [], "part_bucket", ["part", "stratum", "draw"])
    shard = F.expr(f"cast((before * {n_shards}L) div total as int)")
    slot = F.expr(f"before - (shard * total + {n_shards - 1}L) div {n_shards}L").cast("long")
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c.lower() not in ("shard", "slot")]
    return placed.withColumn("shard", shard).select(*kept, "shard", slot.alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """The digest of ``op1``: sizes and checksums are taken at the scan, texts are not shuffled.

    Null text: size 16, checksum of the empty text.  Empty and very long texts are rows like
    others, since the law is about rows.  Repeated rows are dealt one by one.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.col("source").alias("stratum_of"))
    dealt = interleave(rows, n_shards, F.col("stratum_of"), [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("stratum_of")], seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), F.col("stratum_of").alias("source"))
