"""Words without a break, of any length, against tiktoken and within the engine's memory."""

import base64
import random
import resource

import public_tokenizers
import pytest
import tiktoken

from vestige.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return bpe.Engine(PATH), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, words):
    engine, own = both
    engine.learn(words)
    assert all(engine.ids[w] == own.encode_ordinary(w) for w in words)
    assert all(engine.said[w] == " ".join(map(str, engine.ids[w])) for w in words)


@pytest.mark.parametrize("letters", [LETTERS, "ACGT", LETTERS + LETTERS.upper()])
def test_random_letters(both, letters):
    rng = random.Random(3)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    same(both, ["".join(rng.choice(letters) for _ in range(25_000))])
    same(both, ["".join(rng.choice(letters) for _ in range(300)) for _ in range(1000)])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_a_very_long_word(both):
    rng = random.Random(4)
    same(both, ["".join(rng.choice(LETTERS) for _ in range(200_000))])


def test_repeats_and_words_about_the_border(both):
    rng = random.Random(5)
    same(both, ["a" * n for n in (63, 64, 65, 66, 2000, 30_001)] + ["ab" * 5000, "aab" * 4001, "the" * 3000, "日本" * 900, "ha" * 500 + "h", "abcabcab" * 300 + "ca", "Ã" * 777])
    parts = ["the", "a", "aa", "ing", "in", "g", "zz", "q", "é"]
    same(both, ["".join(rng.choice(parts) for _ in range(rng.randrange(10, 80))) for _ in range(400)])


def test_texts_with_long_words_come_back(spark):
    rng = random.Random(6)
    long = "".join(rng.choice(LETTERS) for _ in range(5000))
    texts = [None, "", long, f"one {long} two\n{long[:70]} {long[:64]}", "plain words " * 50, long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in bpe.tokenize(df, PATH, public_tokenizers.PATTERN).collect()}
    assert {i: bytes(r["decoded"]).decode() for i, r in got.items()} == {i: t or "" for i, t in enumerate(texts)}
