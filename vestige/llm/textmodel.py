"""Hashed terms of whole texts and bounded labelled samples, for the models that are fitted here."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


class Buckets(dict):
    """Term to bucket, remembered up to a fixed number of terms."""

    def __init__(self, bits: int, limit: int = 400_000):
        super().__init__()
        self.mask, self.limit = (1 << bits) - 1, limit

    def __missing__(self, term: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) & self.mask
        return found


def present(text: str | None, buckets: Buckets):
    """Sorted distinct buckets of the lower-cased words."""
    import numpy as np

    found = set(map(buckets.__getitem__, WORD.findall((text or "").lower())))
    return np.sort(np.fromiter(found, np.int32, len(found)))


def labelled_sample(labels: DataFrame, usable: Column, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of ``labels``: those of the lowest hash of the key among the usable ones.

    The hash first thins the table to little more than the bound, so no task sends more.
    """
    rows = labels.where(usable & F.col(key).isNotNull())
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30))
    rows = rows.withColumn("draw_", draw)
    if n > bound:
        rows = rows.where(F.col("draw_") < F.lit(int((1 << 30) * min(1.0, 1.3 * bound / n + 0.001))))
    return rows.orderBy("draw_", key).limit(bound).drop("draw_")


def joined_texts(docs: DataFrame, sample: DataFrame, key: str, text_col: str) -> DataFrame:
    """Texts of the sampled rows; the sample is bounded, which allows the broadcast."""
    texts = docs.select(F.col(key).alias("key_"), F.col(text_col).cast("string").alias("text_"))
    return texts.join(F.broadcast(sample), texts["key_"] == sample[key]).drop("key_")
