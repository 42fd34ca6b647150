"""The training-data operators against brute force, on small tables with odd rows."""

import base64
import hashlib
import zlib
from collections import Counter

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from vestige.llm import bpe, decontamination, langid, licenses, line_dedup, ngram_jaccard, quality_ordinal, quality_rules, sharding, toxicity

BASE = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the wood today"
LONG = " ".join(f"word{i}" for i in range(3000))
TEXTS = [
    BASE, BASE, BASE + " again", BASE.upper(), None, "", "   \n\t ", "one", "one", "two words",
    BASE + "\n" + LONG, LONG, LONG + " tail", "a" * 2000, "日本語 テキスト ñandú Été", "x1 " * 40,
    "Released under the MIT License.", "1234 !!! ***", BASE + "\n" + BASE + "\nnew line with seven different words here", "don't we'll    x y \x1c z",
]
SCHEMA = "doc_id long, text string, lang string, source string, `keys` string, `tile` string, `n` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 5 == 0 else f"src{i % 2}", "k", "t", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return list(enumerate(TEXTS))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_shards_are_even_and_hold_the_mixture(spark, docs, none):
    got = sharding.shard_documents(docs, 4).collect()
    data = {i: (t or "").encode() for i, t in pairs()}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(d) + 16, zlib.crc32(d)) for i, d in data.items())
    assert Counter(r["shard"] for r in got) == {k: len(TEXTS) // 4 for k in range(4)}
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(len(TEXTS) // 4))
    by_source = Counter((r["source"], r["shard"]) for r in got)
    for source in (None, "src0", "src1"):
        held = [by_source[source, k] for k in range(4)]
        assert max(held) - min(held) <= 1
    again = sharding.shard_documents(docs, 4).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)
    assert sharding.shard_documents(none).count() == 0


def test_tokens_are_tiktokens(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.tokenize(docs, path, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(TEXTS)
    for i, text in pairs():
        ids = own.encode_ordinary(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert bytes(got[i]["decoded"]) == (text or "").encode()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.tokenize(none, path, public_tokenizers.PATTERN).count() == 0


def test_languages(spark, docs, none):
    known = langid.profiles(docs, F.lit(True))
    found = {r["doc_id"]: r for r in langid.identify(docs, known).collect()}
    assert len(found) == len(TEXTS)
    for i in (4, 5, 6, 17):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert found[0]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.identify(docs, langid.profiles(none, F.lit(True))).collect()} == {"und"}
    assert langid.identify(none, known).count() == 0


def test_long_texts_are_bundled_in_pieces(monkeypatch):
    import numpy as np

    whole = langid.bundles([BASE * 30])
    monkeypatch.setattr(langid, "PIECE", 500)
    cut = langid.bundles([BASE * 30])
    assert (langid.units(whole) * langid.units(cut)).sum() > 0.999
    many = langid.bundles([BASE, None, "", BASE])
    assert np.array_equal(many[0], many[3]) and not many[1:3].any()


def test_contamination(spark, docs, none):
    items = [(1, " ".join(BASE.split()[3:18])), (2, "two WORDS"), (3, None), (4, ""), (5, " ".join(LONG.split()[100:140])), (6, "no such text"), (2, "two words"), (7, "x1 x1 x1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontamination.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(pairs(), items))
    clean = decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(TEXTS) and not any(r["contaminated"] for r in clean)
    assert decontamination.contamination(none, bench).count() == 0


def test_proximity(spark, docs):
    phrases = spark.createDataFrame([("p", ["brown", "lazy", "dog"]), ("q", ["quick", "today"])], "phrase string, terms array<string>")
    index = decontamination.build_index(docs, phrases.select(F.explode("terms").alias("term")))
    got = {(r["phrase"], r["doc_id"]) for r in decontamination.proximity_matches(index, phrases, 8).collect()}
    assert {d for p, d in got if p == "p"} == {0, 1, 2, 3, 10, 18} and {d for p, d in got if p == "q"} == {18}  # where one copy ends and the next begins


def test_statistics_and_rules(spark, docs, none):
    got = rows(quality_rules.statistics(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted((i, *brute.statistics(t)) for i, t in pairs())
    many = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" + ("***" if i % 4 == 0 else "") for j in range(40)), "en", "s", "", "", 0) for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, quality int")
    judged = quality_rules.judge(many, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in judged)
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judge(docs, labels.limit(0)).collect())
    assert quality_rules.judge(none, labels).count() == 0


def test_lines(docs, none):
    got = {(r["doc_id"], int(x)) for r in line_dedup.line_report(docs).collect() for x in r["removed_lines"].split(",") if x}
    assert got == brute.removed_lines(pairs())
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[0] == BASE and kept[1] == "" and kept[4] is None and kept[18] == "new line with seven different words here"
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.line_report(none).count() == 0


def test_near_duplicates(docs, none):
    got = rows(ngram_jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(pairs()))
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, c in brute.components(pairs()) if d == c}
    assert ngram_jaccard.near_duplicates(none).count() == 0


def test_blocks_and_bands_lose_no_link(spark, monkeypatch):
    base = [f"t{i}" for i in range(60)]
    made = []
    for k in range(80):
        words = list(base)
        for e in range(k % 9):
            words[(7 * k + 11 * e) % 60] = f"e{k}_{e}"
        made.append((k, " ".join(words[: 60 - k % 13])))
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ELEMENTS", 300)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 2.0)
    monkeypatch.setattr(ngram_jaccard, "GROUP_ROWS", 10)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert rows(ngram_jaccard.near_duplicates(df), "doc_id", "n_shingles", "component_id") == sorted(brute.components(made))


def test_toxicity(spark, docs, none):
    made = [(i, f"w{i % 17} w{i % 13} w{i % 7} " + ("insult them" if i % 5 == 0 else "hello them")) for i in range(400)]
    train = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    machine = toxicity.train(train, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(train, machine).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in got)
    odd = toxicity.score(docs, machine).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(train, labels.limit(0), F.lit(True))).collect()} == {0.5}
    assert toxicity.score(none, machine).count() == 0


def test_grades(spark, docs, none):
    made = [(i, " ".join(f"w{(i * 7 + j) % 50}" + ("", "!!", "***")[i % 3] for j in range(20))) for i in range(300)]
    train = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 2 - i % 3) for i in range(300)], "doc_id long, grade int")
    model = quality_ordinal.train(train, labels, F.col("grade"), 3, F.lit(True))
    got = {r["doc_id"]: r["expected_grade"] for r in quality_ordinal.grade(train, model).collect()}
    mean = [sum(got[i] for i in range(k, 300, 3)) / 100 for k in range(3)]
    assert mean[0] > mean[1] > mean[2] and (model.thresholds[1:] > model.thresholds[:-1]).all()
    assert len(quality_ordinal.grade(docs, model).collect()) == len(TEXTS)
    assert quality_ordinal.grade(none, model).count() == 0


def test_licences(spark, docs, none):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x", "code"), (3, "a/b/y", "code\nLicensed under the Apache License, Version 2.0.\n" + BASE), (4, "c/z", "code"), (5, None, None), (6, "a/b/c/LICENSE", "Licensed under CC BY-NC 4.0."), (7, "a/b/c/d/e", "")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.license_report(df, F.col("path")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "a"), 3: ("Apache-2.0", None), 4: (None, None), 5: (None, None), 6: ("CC-BY-NC-4.0", None), 7: ("CC-BY-NC-4.0", "a/b/c")}
    assert licenses.license_report(none, F.lit("p")).count() == 0
