"""Registered queries of the training-data operators: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.llm import bpe, decontamination, divergence, langid, licenses, line_dedup, lm_scoring, ngram_jaccard, quality_ordinal, quality_rules, sharding, toxicity, vector_codes
from vestige.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, decoded=False)


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(4, 2)
    found = langid.identify(docs, langid.profiles(docs, ~out))
    return found.select("doc_id", langid.held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels, ~langid.held_out(5, 0))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", langid.held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), least=line_dedup.EVERY_LINE)


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no file paths: a document lies at source / thousands of its id / id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return licenses.license_report(docs, path)


@query
def op8_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for quality 0, 1 for quality 1 but toxic, 2 for quality 1.  Folds as for toxicity."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    model = quality_ordinal.train(docs, labels, grade, 3, ~langid.held_out(5, 0))
    graded = quality_ordinal.grade(docs, model)
    return graded.select("doc_id", langid.held_out(5, 0).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("kept"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), langid.held_out(7, 2))


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op13_divergence"] = divergence.SQL


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


SQL["op12_vector_codes"] = vector_codes.sql()
