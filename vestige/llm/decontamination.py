"""Benchmark decontamination over a distributed positional inverted index.

The texts are read once.  For every term that stands in a benchmark window the index keeps a
posting (term, document, position).  A window is looked up by its two rarest terms: their lists,
shifted by the terms' offsets in the window, are intersected; what is left is held against the
text.  Windows that share the two terms at the same distance share the lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import land, lower_ascii, once

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: The index marks each row of documents by a posting of this term after its last word.
END = ""


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def windows_of(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, win, term list): every window of ``size`` words, or the whole item if it has fewer; none without words."""
    cut = once(items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text_")), w_=words_of(F.col("text_"))).where(F.size("w_") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w_") - size, F.lit(0)))
    one = cut.select("item", "w_", F.explode(starts).alias("s_")).select("item", F.slice("w_", F.col("s_") + 1, size).alias("terms"))
    return one.select("item", F.concat_ws(" ", "terms").alias("win"), "terms").distinct()


@dataclass
class Index:
    """postings: term, doc_id, th (hash of the text, tells rows of one id apart), pos."""

    postings: DataFrame
    frequency: DataFrame  # term, n


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of the ``vocabulary`` (term) in ``docs``, landed.

    Whether the vocabulary is broadcast follows from the size of its landed table.
    """
    terms = land(vocabulary.select("term").unionByName(docs.sparkSession.createDataFrame([(END,)], "term string")).distinct())
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
                         F.posexplode(F.concat(words_of(F.col(text_col)), F.array(F.lit(END)))).alias("pos", "word"))
    postings = land(tokens.join(terms, tokens["word"] == terms["term"]).select("term", "doc_id", "th", "pos"))
    frequency = land(postings.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    return Index(postings, frequency)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def phrase_matches(docs: DataFrame, index: Index, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, hits: array of (start, win, size)): where the windows (win, terms) stand, word for word."""
    windows = windows.select("win", "terms").distinct()
    ranked = windows.select("win", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term")).join(index.frequency, "term", "left")
    rare = ranked.groupBy("win", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off"))).alias("r"))
    rare = rare.where("r[0].n > 0")  # a term that no text has: no occurrence
    rare = rare.select("win", "size", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["off"].alias("o1"),
                       F.get("r", F.lit(1))["term"].alias("t2"), (F.get("r", F.lit(1))["off"] - F.col("r")[0]["off"]).alias("gap"))
    anchors = land(rare.groupBy("t1", "t2", "gap").agg(F.collect_list(F.struct("win", "o1")).alias("wins")).withColumn("anchor", F.monotonically_increasing_id()))
    first = index.postings.join(anchors.select(F.col("t1").alias("term"), "anchor", F.col("t2").isNull().alias("alone")), "term")
    second = index.postings.join(anchors.where("t2 is not null").select(F.col("t2").alias("term"), "anchor", "gap"), "term")
    lists = first.select("doc_id", "th", "anchor", F.col("pos").alias("at"), F.lit(1).alias("one"), F.col("alone").cast("int").alias("two")).unionByName(
        second.select("doc_id", "th", "anchor", (F.col("pos") - F.col("gap")).alias("at"), F.lit(0).alias("one"), F.lit(1).alias("two")))
    both = lists.groupBy("doc_id", "th", "anchor", "at").agg(F.max("one").alias("one"), F.max("two").alias("two")).where("one = 1 and two = 1")
    starts = both.join(anchors.select("anchor", "wins"), "anchor").select("doc_id", "th", "at", F.explode("wins").alias("w"))
    starts = starts.select("doc_id", "th", (F.col("at") - F.col("w.o1")).alias("start"), F.col("w.win").alias("win")).where("start >= 0")
    found = starts.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "win")).alias("maybe"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"), F.xxhash64(F.col(text_col)).alias("th"))
    held = texts.join(found, same_row(texts, found)).select(texts["doc_id"], texts["th"], "text_", "maybe")
    held = once(held, w_=words_of(F.col("text_")))
    size = lambda c: F.size(F.split(c["win"], " "))
    right = F.filter("maybe", lambda c: F.concat_ws(" ", F.slice("w_", c["start"] + 1, size(c))) == c["win"])
    exact = once(held, right_=right).where(F.size("right_") > 0)
    hits = F.transform("right_", lambda c: F.struct(c["start"].alias("start"), c["win"].alias("win"), size(c).alias("size")))
    return exact.select("doc_id", "th", hits.alias("hits")).dropDuplicates(["doc_id", "th"])


def proximity_matches(index: Index, phrases: DataFrame, width: int) -> DataFrame:
    """(phrase, doc_id, th, at): places within ``width`` words of which stand all terms of a phrase (phrase, terms).

    Centres are the postings of the phrase's rarest term; the other terms' postings meet them
    by blocks of ``width`` positions of the same document, not by document.
    """
    terms = phrases.select("phrase", F.explode(F.array_distinct("terms")).alias("term"))
    need = terms.groupBy("phrase").agg(F.count(F.lit(1)).alias("need"))
    known = terms.join(index.frequency, "term")
    rarest = known.groupBy("phrase").agg(F.min_by("term", F.struct("n", "term")).alias("term"))
    centre = index.postings.join(rarest, "term").select("phrase", "doc_id", "th", F.col("pos").alias("at"))
    centre = centre.select("*", F.explode(F.array(*[F.floor(F.col("at") / width) + d for d in (-1, 0, 1)])).alias("block"))
    other = index.postings.join(terms, "term").select(F.col("phrase").alias("p_"), F.col("doc_id").alias("d_"), F.col("th").alias("h_"), "term", "pos", F.floor(F.col("pos") / width).alias("b_"))
    near = centre.join(other, (F.col("phrase") == F.col("p_")) & F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("h_")) & (F.col("block") == F.col("b_")) & (F.abs(F.col("pos") - F.col("at")) <= width))
    seen = near.groupBy("phrase", "doc_id", "th", "at").agg(F.count_distinct("term").alias("seen"))
    return seen.join(need, "phrase").where("seen = need").select("phrase", "doc_id", "th", "at")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a window; contaminated: hit at all, and a
    twentieth of the words or more.  Null and empty texts have no words and are clean; repeated
    rows get the same answer each; items without words have no window; an empty table of items
    leaves everything clean.  Columns that are not named are not read.
    """
    made = land(windows_of(items, item_col, item_text, size))
    index = build_index(docs, made.select(F.explode("terms").alias("term")).distinct(), id_col, text_col)
    hits = land(phrase_matches(docs, index, made, id_col, text_col))
    spans = F.sort_array(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["size"]).alias("b")))))
    covered = F.aggregate("spans_", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                          lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))
    counted = once(hits, spans_=spans).select("doc_id", "th", covered["n"].cast("long").alias("n_hit"))
    named = hits.select("doc_id", "th", F.explode(F.array_distinct(F.transform("hits", lambda h: h["win"]))).alias("win")).join(made.select("win", "item").distinct(), "win")
    per_item = named.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    base = index.postings.where(F.col("term") == END).select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))
    a = base.join(counted, same_row(base, counted), "left").select(base["doc_id"], base["th"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"))
    b = a.join(per_item, same_row(a, per_item), "left").select(a["doc_id"], a["th"], "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return b.select("doc_id", "th", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))
