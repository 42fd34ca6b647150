"""Many search texts in many texts, exactly, without comparing each with each.

Every needle is filed under one gram of GRAM letters: the one that is rarest among the texts.  Texts
are cut into their grams once, one row a letter; only grams that some needle has are kept.  A text
meets a needle only where it holds the needle's gram, and the pair is then verified.  Needles
shorter than a gram are their own gram, and texts are also cut at the lengths that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.session import settle

GRAM = 4


def grams(text: Column, size: int) -> Column:
    """All runs of ``size`` letters of a text; the letters are listed once, so the cost is linear."""
    spots = lambda letters: F.sequence(F.lit(1), F.size(letters) - size + 1)
    cut = lambda letters: F.when(F.size(letters) >= size, F.transform(spots(letters), lambda i: F.array_join(F.slice(letters, i, size), "")))
    return F.get(F.transform(F.array(F.split(text, "")), cut), F.lit(0))


def find(texts: DataFrame, needles: DataFrame, by: list[str], ident: str, value: str, needle: str = "needle", size: int = GRAM) -> DataFrame:
    """(by.., ident, needle): the texts of each group that contain a needle of that group.

    ``ident`` names a text within its group.  Null and empty needles are in no text; null texts hold none.
    """
    wanted = settle(needles.filter(F.length(needle) > 0).select(*by, needle).distinct())
    lengths = sorted(r[0] for r in wanted.select(F.least(F.length(needle), F.lit(size))).distinct().collect())
    # At most ``size`` lengths; one row for each letter of a text and each length.
    cuts = F.flatten(F.filter(F.array(*[grams(F.col(value), n) for n in lengths]), lambda g: g.isNotNull())) if lengths else F.array().cast("array<string>")
    own = F.when(F.length(needle) < size, F.array(needle)).otherwise(grams(F.col(needle), size))
    filed = wanted.select(*by, needle, F.explode(F.array_distinct(own)).alias("gram"))
    posted = texts.filter(F.col(value).isNotNull()).select(*by, ident, F.explode(F.array_distinct(cuts)).alias("gram"))
    posted = settle(posted.join(filed.select(*by, "gram").distinct(), [*by, "gram"], "left_semi"))
    often = posted.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("n"))
    # A needle with a gram that no text has is in none.
    every = filed.join(often, [*by, "gram"], "left").groupBy(*by, needle).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    index = every.filter("least.n > 0").select(*by, needle, F.col("least.gram").alias("gram"))
    met = posted.join(index, [*by, "gram"]).select(*by, ident, needle)
    short = met.filter(F.length(needle) <= size)
    long = met.filter(F.length(needle) > size).join(texts.select(*by, ident, value), [*by, ident])
    return short.unionByName(long.filter(F.col(value).contains(F.col(needle))).select(*by, ident, needle))
