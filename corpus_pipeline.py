"""The corpus pipeline: language, lines, near duplicates, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.llm import bpe, decontamination, langid, line_dedup, ngram_jaccard
from vestige.llm.common import land, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that could be told; those without a letter go.

    All stay where no document has a language to learn from.  Null texts have no letter; repeated
    rows and columns of any name stay as they are; texts are read whole.
    """
    known = langid.profiles(docs, ~langid.held_out(4, 2))
    if not known:
        return docs
    keep = [c for c in docs.columns if c != "doc_id"]
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"{c}_kept") for c in keep])
    found = langid.identify(plain, known, keep=[f"{c}_kept" for c in keep]).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"`{c}_kept`").alias(c) for c in docs.columns])


def by_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that were seen before go; a document that loses its last line goes with it."""
    worded = lambda c: F.coalesce(F.length(F.regexp_replace(c, r"[\x20\x09-\x0D]+", "")) > 0, F.lit(False))
    bare = docs.where(~worded(F.col("text")))
    return line_dedup.dedup_lines(docs.where(worded(F.col("text"))), least=line_dedup.EVERY_LINE).where(worded(F.col("text"))).unionByName(bare)


def by_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; see keep_one."""
    return ngram_jaccard.keep_one(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts, repeated rows and columns of any name stay."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("k_"), F.col("th").alias("t_")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["k_"]) & (F.xxhash64(docs["text"]) == found["t_"]), "left_anti")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of whole texts, with the documents' other columns; null texts have no tokens."""
    import public_tokenizers

    made = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    keep = [c for c in docs.columns if c not in ("doc_id", "text") and c.lower() not in made]
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=False, keep=keep)


STAGES = [("language ID", by_language), ("line dedup", by_line), ("n-gram Jaccard join", by_copy), ("benchmark decontamination", by_benchmark), ("byte-level BPE", to_tokens)]

#: The learned languages and the merges are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir))
    return docs
