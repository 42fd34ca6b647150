"""The whole pipeline and all registered queries on small folders with odd rows."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from vestige.llm import ngram_jaccard, queries, sharding

BASE = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the wood today"
OTHER = "der schnelle braune fuchs springt über den faulen hund und läuft weit weg von allen anderen tieren im wald heute"
PASSAGE = "which of the following planets has the largest number of known moons in our solar system as of this year"


def texts():
    own = [f"{w} number {i} stands alone with its own words {' '.join(w + str(i * k) for k in range(9))}" for i, w in enumerate("alpha beta gamma delta".split())]
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    return [BASE, BASE, BASE + " again", None, "", " \n\t", "12 34 !!", OTHER, *own, f"{own[0]}\nbut a new line that nobody else has in this folder", f"own start {long} own end of it", f"note {PASSAGE}", own[1]]


def folder(spark, path, rows, extra=""):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + extra
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], i % 2, (i // 2) % 2) for i, r in enumerate(rows) if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [float(i % 5), 0.5] * 8, i % 3) for i in range(len(rows))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def odd_rows():
    return [(None if i in (3, 9) else i, t, "de" if t == OTHER else None if i == 10 else "en", None if i % 4 == 0 else f"s{i % 2}", 1) for i, t in enumerate(texts())]


def test_the_pipeline_keeps_what_it_should(spark, tmp_path):
    folder(spark, tmp_path, odd_rows())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256"} <= set(got[0].asDict())
    told = {r["doc_id"]: r for r in got}
    assert 0 in told and 1 not in told and 7 in told and 13 in told and 8 in told
    assert not {3, 4, 5, 6} & set(told)  # without a letter
    assert 14 not in told  # a benchmark passage
    assert told[7]["lang"] == "de" and told[13]["n_tokens"] == len(told[13]["ids"]) > 100


def test_the_pipeline_without_languages_or_rows(spark, tmp_path):
    folder(spark, tmp_path / "a", [(i, t, None, None, 1) for i, t in enumerate([BASE, OTHER])])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "a")).collect()) == [0, 1]
    folder(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES, key=lambda n: int(re.findall(r"\d+", n)[0])))
def test_every_query_takes_odd_rows_and_none(spark, tmp_path, name):
    folder(spark, tmp_path / "a", odd_rows())
    rows = queries.QUERIES[name](spark, str(tmp_path / "a")).collect()
    if not name.startswith("op13"):
        assert len(rows) == len(texts())
    folder(spark, tmp_path / "b", [])
    assert queries.QUERIES[name](spark, str(tmp_path / "b")).count() == 0


def test_columns_of_any_name_come_through(spark):
    names = ["h_", "k_", "t_", "c_", "row", "id_", "shard_", "slot_", "before", "total", "part", "stratum", "draw"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names)
    df = spark.createDataFrame([(i, BASE if i < 2 else f"own text {i}", *range(i, i + len(names))) for i in range(6)], schema)
    kept = ngram_jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r)[0] for r in kept.collect()) == [0, 2, 3, 4, 5]
    assert all(tuple(r)[2:] == tuple(range(r["doc_id"], r["doc_id"] + len(names))) for r in kept.collect())
    dealt = sharding.interleave(df, 2, F.lit("s"), [F.col("doc_id")])
    assert dealt.columns == [*df.columns, "shard", "slot"]
    assert all(tuple(r)[2:-2] == tuple(range(r["doc_id"], r["doc_id"] + len(names))) for r in dealt.collect())
