"""A large group of near copies, of which the earliest line does not settle all, makes few pairs."""

import random

import brute

from vestige.llm import line_dedup


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"word{i}" for i in range(60)]
    lines = [" ".join(f"new{k}x{i}" if i in out else w for i, w in enumerate(base)) for k in range(150) for out in [set(rng.sample(range(60), rng.choice((1, 2, 3, 4))))]]
    docs = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "doc_id bigint, text string")
    seen, kept = [], line_dedup.positioned

    def counted(pairs, threshold):
        seen.append(pairs.count())
        return kept(pairs, threshold)

    monkeypatch.setattr(line_dedup, "positioned", counted)
    gone = line_dedup.removed_lines(docs, least=1).select("doc_id", "line_no").collect()
    assert {(r.doc_id, r.line_no) for r in gone} == brute.removed_lines([(k, line) for k, line in enumerate(lines)], least=1)
    assert sum(seen) < 10 * len(lines), seen


def test_lines_in_one_place_do_not_take_each_other_out(spark):
    """Rows that share an id and differ in text by a word: neither line is earlier."""
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, words), (1, words + " more"), (2, words + " most")], "doc_id bigint, text string")
    assert [(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs, least=1).collect()] == [(2, 0)]
