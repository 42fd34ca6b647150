"""The recurrent language model: base columns by brute force, gradients, proper probabilities, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vestige.llm import lm_scoring, queries
from vestige.llm.recurrent import Net

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_base(rows, modulus=7, remainder=2):
    """(id, held out, tokens, known, all, base) of each row."""
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % modulus == remainder
    told = [(i, out(i), WORD.findall(lowered(t)) + [None]) for i, t in rows]
    counts = Counter(w for _, o, words in told if not o for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(i, o, len(words), sum(w in counts for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) for i, o, words in told]


TEXTS = [
    "the cat sat on the mat. The Cat SAT.", "the dog sat on the log", None, "", " \t\n ", "ÉTÉ été Ünï 日本語", "x" * 300 + " tail", "x" * 300, "a\x1cb c\x0bd",
    "the cat sat on the mat. The Cat SAT.", " ".join(f"w{i % 97}" for i in range(3000)), "the dog and the cat", "own0 own1 own2 the", "unseen words here",
]


@pytest.fixture(scope="module")
def made():
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None, 11, None, 13]
    return [(i, t) for k in range(3) for i, t in zip(ids, TEXTS)] + [(100 + k, f"the cat number {k % 5} sat on the mat") for k in range(40)]


def test_base_columns_are_the_counts(spark, made):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in made], "doc_id long, text string, slots int, id_ string").repartition(4)
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    got = [tuple(r) for r in lm_scoring.score_texts(df, out).collect()]
    key = lambda r: tuple(("" if x is None else str(round(x, 6) if isinstance(x, float) else x)) for x in r)
    assert sorted(key(r[:6]) for r in got) == sorted(key(r) for r in brute_base(made))
    assert any(r[1] for r in got) and any(r[3] < r[2] for r in got)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r[0], r[2], round(r[5], 6)), set()).add(round(r[6], 3))
    assert all(len(s) == 1 for s in by_text.values())


def test_the_registered_query(spark, made, tmp_path):
    spark.createDataFrame(made, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_lm_scoring"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted(str(r["doc_id"]) + str(r["n_tokens"]) for r in got.collect()) == sorted(str(i) + str(n) for i, _, n, *_ in brute_base(made))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = [tuple(r)[2:] for r in lm_scoring.score_texts(df, F.lit(True)).orderBy("doc_id").collect()]
    assert [r[:4] for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert [r[4] for r in got] == pytest.approx([3 * math.log10(0.5), math.log10(0.5)], abs=1e-5)
    assert lm_scoring.score_texts(df.limit(0), F.lit(False)).count() == 0


def test_it_learns_what_follows(spark):
    """Word order that counts cannot see: b always after a, d always after c."""
    draw = np.random.default_rng(3)
    made = [(i, " ".join(("a b", "c d")[k] for k in draw.integers(0, 2, 60))) for i in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    got = lm_scoring.score_texts(df, F.col("doc_id") % 5 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.75 * got[1]


def example(hidden=5):
    counts = [(b"", 30), *[(b"w%d" % i, 40 - i) for i in range(30)], *[(b"v%d" % i, 3 + i % 3) for i in range(9)]]
    was, most = lm_scoring.WIDTH, lm_scoring.WORDS
    lm_scoring.WIDTH, lm_scoring.WORDS = 8, 31
    try:
        own = lm_scoring.Lexicon(counts, 1000, 60)
    finally:
        lm_scoring.WIDTH, lm_scoring.WORDS = was, most
    net = Net.fresh(own.words, own.rare + 1, own.log_word, own.log_class, 8, hidden)
    draw = np.random.default_rng(1)
    net = Net({k: (a + draw.standard_normal(a.shape) * 0.3 * (k.endswith("out"))) for k, a in net.w.items()}, 8)
    return own, net


def test_probabilities_add_up_to_one():
    own, net = example()
    assert own.rare == own.words + 2 and own.rare_mass == 1000 + 60 + 1 - own.counts.sum() - 40
    assert np.exp(own.log_class).sum() == pytest.approx(1)
    for level in (own.words, own.words + 1):
        assert np.exp(own.inner[own.slots == level]).sum() == pytest.approx(1)
    start, every = np.array([own.words + 1, 1, 5, 2]), np.arange(own.rare + 1)
    ends = np.array([net.scores([np.append(start, s)])[0] for s in every])
    assert np.exp(ends - net.scores([start])[0]).sum() == pytest.approx(1, abs=1e-6)


def test_gradients():
    own, net = example()
    draw = np.random.default_rng(2)
    tokens = draw.integers(0, own.words, (7, 3))
    read, targets, state = tokens[:-1], tokens[1:], np.zeros((3, 5))
    net.w["class_out"] = net.w["class_out"].astype(np.float64)
    _, _, grads = net.window(read, targets, state)
    for name, g in grads.items():
        flat = net.w[name].ravel()
        for at in draw.choice(flat.size, 6):
            was, step = flat[at], 4e-3
            values = []
            for sign in (1, -1):
                changed = flat.copy()
                changed[at] = was + sign * step
                other = Net(net.w | {name: changed.reshape(net.w[name].shape)}, net.width)
                values.append(other.window(read, targets, state)[1])
            assert -(values[0] - values[1]) / (2 * step) == pytest.approx(g.ravel()[at], rel=0.02, abs=4e-3), name


def test_scores_do_not_depend_on_neighbours():
    own, net = example()
    draw = np.random.default_rng(4)
    documents = [np.append(draw.integers(1, own.words, n), 0).astype(np.int16) for n in (0, 1, 31, 32, 33, 500, 64)]
    together = net.scores(documents)
    assert together == pytest.approx([net.scores([d])[0] for d in documents], abs=1e-3)
