"""Cases that an operator once left out, against brute force or plain reckoning."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from vestige.llm import line_dedup, ngram_jaccard, queries, toxicity


def test_every_line_with_a_word_takes_part(spark, tmp_path):
    cjk = "日本語の長い行には空白がないので一つの語になる" * 8
    made = [
        (1, f"All rights reserved.\none\n\n{cjk}\na b c d\nShare this page"), (2, f"all RIGHTS reserved.\none\n\n{cjk}\na b c d e\nshare that page"),
        (3, "x1 " * 40 + "\none two\n \t\nd c b a"), (4, "x1 x1\ntwo one one\n \t\nown"), (5, "All rights reserved."), (6, None), (7, ""),
    ]
    df = spark.createDataFrame(made, "doc_id long, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], int(x)) for r in queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect() for x in r["removed_lines"].split(",") if x}
    assert got == brute.removed_lines(made, least=1)
    assert got == {(2, 0), (2, 1), (2, 3), (2, 4), (3, 3), (4, 0), (4, 1), (5, 0)}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.by_line(spark, df, str(tmp_path)).collect()}
    assert kept[2] == "\nshare that page" and 5 not in kept and kept[6] is None and kept[4] == " \t\nown"


def test_short_lines_of_many_texts(spark):
    words = ["a", "b", "c", "d", "e", "f"]
    made = [(i, "\n".join(" ".join(words[(i * k + j * j) % 6] for j in range(1 + (i + k) % 7)) for k in range(6))) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], int(x)) for r in line_dedup.line_report(df, least=line_dedup.EVERY_LINE).collect() for x in r["removed_lines"].split(",") if x}
    assert got == brute.removed_lines(made, least=1)


def near_copies():
    base = [f"t{i}" for i in range(60)]
    return [" ".join(base + [f"end{k}"]) for k in range(4)]


def test_null_ids_link_like_others(spark):
    """A group of near copies for each place of the null id, so that it is the group's head in one of them."""
    made = [(None if i == k else 10 * k + i, f"g{k} " + t.replace("t", f"g{k}t")) for k in range(4) for i, t in enumerate(near_copies())]
    made += [(None, "alone " * 9), (None, "only null ids " + near_copies()[0]), (None, "only null ids " + near_copies()[1])]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = [(r["th"], r["doc_id"], r["component_id"]) for r in ngram_jaccard.near_duplicates(df).collect()]
    groups = {k: min(10 * k + i for i in range(4) if i != k) for k in range(4)}
    assert sorted(c for _, _, c in got if c is not None) == sorted(groups[k] for k in range(4) for _ in range(4))
    assert sum(c is None for _, _, c in got) == 3


def test_one_of_each_component_stays(spark):
    a, b, c, d = near_copies()
    other = "quite another text of many words that has nothing to do with the rest of them"
    made = [(1, a), (1, other), (2, b), (None, c), (None, "null and unlike " * 5), (None, "null and unlike " * 5), (None, "a second null with its own words only"), (3, "own " + other), (1, d)]
    kept = [(r["doc_id"], r["text"]) for r in ngram_jaccard.keep_one(spark.createDataFrame(made, "doc_id long, text string")).collect()]
    near = [x for x in kept if x[1] in near_copies()]
    assert len(near) == 1 and near[0][0] == 1
    assert sorted((str(i), t) for i, t in kept if (i, t) not in near) == sorted([("1", other), ("None", "null and unlike " * 5), ("None", "a second null with its own words only")])


def test_words_that_are_toxic_only_together(spark):
    """Each of the two is as often in toxic texts as any text is toxic."""
    made = []
    for i in range(1600):
        q, k = i % 4, i // 4
        toxic = k % 8 == 0 if q < 2 else k % 3 == 0
        told = (("alpha beta", "alpha beta", "insult", "insult") if toxic else ("alpha", "beta", "hello", "hello"))[q]
        made.append((i, f"w{k % 17} u{k % 13} v{k % 7} {told}", int(toxic)))
    train = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    machine = toxicity.train(train.drop("toxic"), train.select("doc_id", "toxic"), F.lit(True))
    asked = spark.createDataFrame([(0, "alpha"), (1, "beta"), (2, "alpha beta"), (3, "insult"), (4, "hello")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(asked, machine).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False}
