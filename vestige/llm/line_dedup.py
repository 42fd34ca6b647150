"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words.  Words are ordered by rarity; two lines whose Jaccard
similarity reaches the threshold share a word among the first n - ceil(t n) + 1 of each (prefix
filter), their lengths are within the threshold's ratio, and the words that the prefixes share
leave room in the rest for the overlap needed (positional filter).  Bitmaps bound the overlap
inside the join, so that few pairs are shuffled.  What passes is verified on the texts.  A line
goes if it equals, or is similar to, an earlier line: one with a smaller (document id, line number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import land, lower_ascii, once

BLANKS = r"[\x20\x09-\x0D]+"
THRESHOLD = 0.8
#: By default, lines of fewer different words are left alone, equal ones too: headings, single words.
#: op7 and the pipeline pass EVERY_LINE: all lines that have a word take part.
LEAST_WORDS, EVERY_LINE = 5, 1
#: Rarity is counted in 2 ** RARITY_BITS hashed buckets; any order that all lines share gives the same result.
RARITY_BITS = 20
#: Line hashes that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Earliest lines of a key that are tried with a line which the first one did not settle, at most.
LEAD_BUCKETS = 64


def ceil_share(threshold: float, n: Column) -> Column:
    """ceil(threshold * n) in whole numbers."""
    return F.floor((n * round(threshold * 1000) + 999) / 1000).cast("int")


def word_hashes(line: Column) -> Column:
    """The hashes of a line's different words."""
    return F.array_distinct(F.transform(F.array_remove(F.split(lower_ascii(line), BLANKS), ""), lambda w: F.xxhash64(w)))


def rarity(docs: DataFrame) -> Column:
    """log2 of the number of words in each hashed bucket, over all texts: one array, as a scalar subquery.

    A fixed number of buckets, landed as one row.  A literal would stand in every plan the driver keeps.
    """
    spark, size = docs.sparkSession, 1 << RARITY_BITS
    words = docs.select(F.explode(F.split(lower_ascii(F.col("text_")), BLANKS)).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(size - 1)).alias("bucket")).count()
    counts = counts.select("bucket", F.floor(F.log2("count")).cast("tinyint").alias("level")).unionByName(spark.range(size).select(F.col("id").alias("bucket"), F.lit(0).cast("tinyint").alias("level")))
    levels = counts.groupBy("bucket").agg(F.max("level").alias("level"))
    parts = levels.groupBy(F.shiftright("bucket", RARITY_BITS - 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("bucket", "level"))).alias("l"))
    whole = land(parts.select("part", F.transform("l", lambda x: x["level"]).alias("l"))).agg(F.array_sort(F.collect_list(F.struct("part", "l"))).alias("p"))
    return land(whole.select(F.flatten(F.transform("p", lambda x: x["l"])).alias("levels"))).scalar()


def similar(a: str, b: str, threshold: float) -> Column:
    """|A and B| >= t |A or B| for the key arrays of both."""
    both = F.size(F.array_intersect(f"{a}.keys", f"{b}.keys"))
    return both * 1000 >= (F.col(f"{a}.n") + F.col(f"{b}.n") - both) * round(threshold * 1000)


def bits(hashes: Column) -> Column:
    """64 bits, of which each hash sets one."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


def sketched(lines: DataFrame, rare: Column, threshold: float, least: int) -> DataFrame:
    """``lines`` without the text, with n (different words), map0 and map1 (a bitmap of 128 bits), prefix and leads.

    The prefix holds 31 bits of the hash of each of the first words in order of rarity; words
    that those bits confuse only bring pairs that fail later.
    """
    # Subqueries may not stand in a lambda, but a column that does may be one; it is used once, so it is merged in.
    sets = once(lines, set_=F.sort_array(word_hashes(F.col("line")))).where(F.size("set_") >= least).withColumn("levels_", rare)
    level = lambda h: F.get("levels_", h.bitwiseAND(F.lit((1 << RARITY_BITS) - 1)).cast("int")).cast("long")
    ordered = F.sort_array(F.transform("set_", lambda h: F.shiftleft(level(h), 48).bitwiseOR(F.shiftrightunsigned(h, 16))))
    first = F.slice(ordered, F.lit(1), F.size("set_") - ceil_share(threshold, F.size("set_")) + 1)
    return sets.select(*[c for c in lines.columns if c != "line"], F.size("set_").alias("n"), bits(F.filter("set_", lambda h: h < 0)).alias("map0"), bits(F.filter("set_", lambda h: h >= 0)).alias("map1"),
                       F.transform(first, lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("prefix"), lead_keys(F.col("set_")).alias("leads"))


def could_be(a: str, b: str, threshold: float) -> Column:
    """Lengths within the threshold's ratio, and room for the overlap needed.

    A bit that only one of two lines has stands for a word that the other lacks.
    """
    of = lambda side, c: F.col(f"{side}.{c}")
    lacks = lambda x, y: sum(F.bit_count(of(x, m).bitwiseAND(F.bitwise_not(of(y, m)))) for m in ("map0", "map1"))
    sizes = (of(a, "n") >= ceil_share(threshold, of(b, "n"))) & (of(b, "n") >= ceil_share(threshold, of(a, "n")))
    need = needed_overlap(of(a, "n"), of(b, "n"), threshold)
    return sizes & (of(a, "n") - lacks(a, b) >= need) & (of(b, "n") - lacks(b, a) >= need)


def needed_overlap(n_a: Column, n_b: Column, threshold: float) -> Column:
    t = round(threshold * 1000)
    return F.floor(((n_a + n_b) * t + 999 + t) / (1000 + t))


def lead_keys(ordered: Column) -> Column:
    """The keys by which a line looks for an earlier line that may settle it: pairs of its least and greatest word hashes.

    Near copies have most of these in common, wherever they differ; unrelated lines seldom have two.
    """
    two = lambda i, j: F.xxhash64(F.get(ordered, i), F.get(ordered, j)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    low, second, top, next_ = F.lit(0), F.lit(1), F.size(ordered) - 1, F.size(ordered) - 2
    return F.array_distinct(F.array(two(low, second), two(next_, top), two(low, top), two(second, next_)))


def positioned(pairs: DataFrame, threshold: float) -> DataFrame:
    """(pos, with) of ``pairs`` (pos, n, with, m; a row for each prefix word shared) whose positions leave room.

    Of two lines, the prefix that ends first meets the other line in its prefix only: the overlap
    is at most the prefix words shared and the longer rest.
    """
    counted = pairs.groupBy("pos", "n", "with", "m").agg(F.count(F.lit(1)).alias("shared"))
    rest = F.greatest(ceil_share(threshold, F.col("n")), ceil_share(threshold, F.col("m"))) - 1
    return counted.where(F.col("shared") + rest >= needed_overlap(F.col("n"), F.col("m"), threshold)).select("pos", "with")


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, line_no): the lines that go; th is the hash of the row's text.

    Lines of fewer than ``least`` different words stay; those without a word always do.

    Rows of one id are told apart by text; of rows that are equal throughout, the lines go in
    none or all.  A null id sorts first.  Null and empty texts have no lines.
    """
    where_ = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"), F.xxhash64(F.col(text_col)).alias("th"))
    lines = where_.select("doc_id", "th", F.posexplode(F.split("text_", "\n")).alias("line_no", "line"))
    rare = rarity(where_)
    found = sketched(lines.select(F.xxhash64("line").alias("id"), F.struct("doc_id", "line_no").alias("first"), "line"), rare, threshold, max(least, 1))
    content = F.struct("n", "map0", "map1", "prefix", "leads")
    grouped = found.groupBy("id").agg(F.min("first").alias("first"), F.first(content).alias("c"), F.count(F.lit(1)).alias("times")).select("id", "first", "times", "c.*")
    # Numbered in the order of their first places: of two numbers the smaller one is the earlier line's
    # (or one in the same place, where rows share an id; that is told apart when pairs are verified).
    distinct = land(grouped.orderBy("first").withColumn("pos", F.monotonically_increasing_id()))
    named = (F.col("x.pos").alias("pos"), F.col("x.n").alias("n"), F.col("y.pos").alias("with"), F.col("y.n").alias("m"))
    # Only an earlier line can take one out; a line is not paired with the later ones.
    fits = (F.col("y.pos") < F.col("x.pos")) & could_be("x", "y", threshold)

    def spread(rows: DataFrame, words: Column) -> DataFrame:
        return rows.select(F.explode(words).alias("key"), "pos", "n", "map0", "map1")

    # First each line against the earliest one of each of its lead keys; then those still without a
    # match against the earliest one of each of a key's buckets: of a large group of near copies few
    # are left.  Then the lines without a match against all earlier ones by whole prefixes.
    settled, left = None, distinct
    for buckets in (1, LEAD_BUCKETS):
        of_key = distinct.select(F.explode("leads").alias("key"), F.struct("pos", "n", "map0", "map1").alias("y")).groupBy("key", F.pmod(F.xxhash64("y.pos"), F.lit(buckets)).alias("bucket")).agg(F.min("y").alias("y"))
        tried = spread(left, F.col("leads")).alias("x").join(of_key.select("key", "y"), "key").where(fits)
        found_ = verified(tried.select("x.pos", F.col("y.pos").alias("with")).distinct(), lines, distinct, threshold)
        settled = found_ if settled is None else settled.unionByName(found_)
        left = land(left.join(found_, "pos", "left_anti"))
    open_ = spread(left, F.col("prefix"))
    shut = spread(distinct.join(settled, "pos", "left_semi"), F.col("prefix"))
    # One after the other: each join's shuffle files go before the next one writes its own.
    met = [land(positioned(open_.alias("x").join(others.alias("y"), (F.col("x.key") == F.col("y.key")) & fits).select(*named), threshold)) for others in (open_, shut)]
    more = verified(met[0].unionByName(met[1]), lines, distinct, threshold)
    gone = settled.unionByName(more).withColumn("gone", F.lit(True))
    fate = distinct.select("id", "pos", "first", "times").join(gone, "pos", "left").where("gone or times > 1").select("id", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    places = lines.select("doc_id", "th", "line_no", F.xxhash64("line").alias("id"))
    hit = places.join(fate, "id").where(F.col("gone") | ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    return hit.select("doc_id", "th", "line_no")


def verified(pairs: DataFrame, lines: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """(pos): the lines that are similar to an earlier one they are paired with (pos, with)."""
    pairs = land(pairs)
    ends = pairs.select("pos").unionByName(pairs.select(F.col("with").alias("pos"))).distinct()
    needed = land(distinct.select("pos", "id", "first").join(ends, "pos", "left_semi"))
    wanted = needed.select("id")
    wanted = F.broadcast(wanted) if needed.count() <= BROADCAST_IDS else wanted
    texts = lines.select(F.xxhash64("line").alias("id"), "line").join(wanted, "id", "left_semi").dropDuplicates(["id"]).join(needed, "id")
    sets = land(once(texts, keys=word_hashes(F.col("line"))).select("pos", "first", F.size("keys").alias("n"), "keys"))
    a, b = sets.alias("a"), sets.alias("b")
    both = pairs.join(a, pairs["pos"] == F.col("a.pos")).join(b, pairs["with"] == F.col("b.pos"))
    return land(both.where((F.col("b.first") < F.col("a.first")) & similar("a", "b", threshold)).select(pairs["pos"]).distinct())


def line_report(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed and the removed lines' numbers, comma-joined."""
    gone = removed_lines(docs, threshold, least=least).distinct().groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("line_no")).alias("lines"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    out = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["th"] == gone["th"]), "left")
    none = F.array().cast("array<int>")
    return out.select(rows["doc_id"], "n_lines", F.size(F.coalesce("lines", none)).cast("long").alias("n_removed"),
                      F.array_join(F.coalesce("lines", none).cast("array<string>"), ",").alias("removed_lines"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; a text of which nothing is left becomes empty."""
    gone = removed_lines(docs, threshold, id_col, text_col, least).distinct().groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("lines"))
    rows = docs.select(F.struct("*").alias("row_"), F.col(id_col).alias("k_"), F.col(text_col).alias("t_"), F.xxhash64(F.col(text_col)).alias("h_"))
    met = rows.join(gone, rows["k_"].eqNullSafe(gone["doc_id"]) & (rows["h_"] == gone["th"]), "left")
    kept = F.array_join(F.filter(F.split("t_", "\n"), lambda line, i: ~F.array_contains("lines", i)), "\n")
    text = F.when(F.col("lines").isNull(), F.col("t_")).otherwise(kept)
    return met.select(*[text.alias(c) if c == text_col else F.col(f"row_.`{c}`").alias(c) for c in docs.columns])
