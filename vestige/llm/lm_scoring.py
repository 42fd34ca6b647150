"""Scores of whole texts by a gated recurrent language model, beside the add-one unigram score.

Every training token of the corpus is counted, and every training document is read once by the
network.  Words that make at least 1 / SHARE of all tokens, which are at most SHARE words, are held
by every task.  The most frequent of them are learned by the network one by one; the others belong
to classes of words whose counts have the same number of binary digits.  All other words, and the
one that was never counted, are one more class.  A word that is not learned has in its class the
share of its count plus one.  So the model's probabilities of all counted words and one unknown
word add up to one in every state.

The network needs no counts of the words that tasks do not hold; only sums over a document do, and
they come from a join of (document, word) rows.

Training is local descent in rounds: tasks start at the round's weights, read their documents of
the round in windows of truncated backpropagation, and the weights are averaged by tokens read.
Rounds hold 1/16, 1/16, 1/8, 1/4 and 1/2 of the training documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import land, text_batches
from vestige.llm.recurrent import Net

#: At most so many words are held by a task.
SHARE = 1_000_000
#: Learned words, the end among them; words of one class; size of the state.
WORDS, WIDTH, HIDDEN = 512, 32, 16
#: Distinct words that a task counts before it hands the counts on; tokens a task reads side by side.
HELD_WORDS, HELD_TOKENS = 300_000, 4_000_000
#: Words of more bytes are known by their digest; a word has no blank, so the two are never confused.
LONGEST = 64
#: Sixteenths of the documents by round.
ROUNDS = ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16))
#: The key of the end of a document; no word is empty.
END_KEY = b""


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the blanks 9 to 13 and 32."""
    return data.lower().split() if data else []


def key_of(word: bytes) -> bytes:
    import hashlib

    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key binary, c long): how often each word, and the end of a document, occurs."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])

        held: Counter = Counter()
        for batch in batches:
            for data in batch.column(0):
                words = words_of(data.as_py())
                if words and max(map(len, words)) > LONGEST:
                    words = list(map(key_of, words))
                held.update(words)
                held[END_KEY] += 1
                if len(held) > HELD_WORDS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    parts = text_batches(docs.select(F.col(f"`{text_col}`").cast("string").cast("binary"))).mapInArrow(run, "key binary, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("c"))


class Lexicon:
    """What every task knows: the words of at least 1 / SHARE of the tokens, and the classes' masses."""

    def __init__(self, frequent: list[tuple[bytes, int]], tokens: int, distinct: int):
        """frequent: (key, count); tokens, distinct: of all counted words."""
        ends = dict(frequent).get(END_KEY, 0)
        ranked = sorted((x for x in frequent if x[0] != END_KEY), key=lambda x: (-x[1], x[0]))
        every = [(END_KEY, ends), *ranked]
        self.tokens, self.distinct, self.words = tokens, distinct, min(len(every), WORDS)
        self.index = {key: i for i, (key, _) in enumerate(every)}
        self.counts = np.array([c for _, c in every], np.int64)
        shares = self.counts + 1.0
        digits = np.array([c.bit_length() for _, c in every[self.words :]], np.int64)
        levels = np.unique(digits)
        level_of = np.searchsorted(levels, digits)
        level_mass = np.bincount(level_of, weights=shares[self.words :], minlength=len(levels))
        self.rare = self.words + len(levels)
        # One for the word that was never counted; the end is a word also where it was not.
        counted = len(every) if ends else len(every) - 1
        self.rare_mass = float(tokens + distinct + 1 - int(self.counts.sum()) - counted)
        self.slots = np.concatenate([np.arange(self.words), self.words + level_of]).astype(np.int16)
        self.inner = np.zeros(len(every))
        self.inner[self.words :] = np.log(shares[self.words :]) - np.log(level_mass[level_of])
        classes = np.bincount(np.arange(self.words) // WIDTH, weights=shares[: self.words])
        self.log_word = np.log(shares[: self.words]) - np.log(classes[np.arange(self.words) // WIDTH])
        masses = np.concatenate([classes, level_mass, [self.rare_mass]])
        self.log_class = np.log(masses) - np.log(masses.sum())

    def fresh(self) -> Net:
        return Net.fresh(self.words, self.rare + 1, self.log_word, self.log_class, WIDTH, HIDDEN)


def lexicon(counts: DataFrame) -> Lexicon:
    """From the landed (key, c).  At most SHARE words come to the driver."""
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, distinct = int(total[0] or 0), int(total[1])
    often = (F.col("key") == F.lit(END_KEY)) | (F.col("c").cast("decimal(38,0)") * SHARE >= tokens)
    frequent = [(bytes(r["key"]), int(r["c"])) for r in counts.where(often).collect()]
    return Lexicon(frequent, tokens, distinct)


def encoded(docs: DataFrame, known, keep: list[str]) -> DataFrame:
    """Per row of ``docs`` (keep columns, text_): slots (16 bits each, packed), n_tokens, rare and times, n_known, inner, plus.

    rare, times: the words that tasks do not hold, and how often they occur.  Of the others come
    n_known, their number; inner, the sum of the log shares in their classes; and plus, the sum of
    ln(count + 1).  ``known`` is the broadcast Lexicon.
    """
    fields = "slots binary, n_tokens long, rare array<binary>, times array<int>, n_known long, inner double, plus double"

    def look_up(batches):
        from collections import Counter
        from itertools import compress, repeat

        import pyarrow as pa

        own = known.value
        index, plus = own.index, np.log(own.counts + 1.0)
        for batch in batches:
            made = []
            for data in batch.column(batch.num_columns - 1):
                words = words_of(data.as_py())
                words.append(END_KEY)
                found = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
                there = found >= 0
                rare = Counter(compress(words, (~there).tolist()))
                if rare and max(map(len, rare)) > LONGEST:
                    rare = {key_of(w): n for w, n in rare.items()}
                hit = found[there]
                slots = np.full(len(found), own.rare, np.int16)
                slots[there] = own.slots[hit]
                made.append((slots.tobytes(), len(found), list(rare), list(rare.values()), int((own.counts[hit] > 0).sum()), float(own.inner[hit].sum()), float(plus[hit].sum())))
            columns = zip(*made) if made else [()] * 7
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=[*batch.schema.names[:-1], "slots", "n_tokens", "rare", "times", "n_known", "inner", "plus"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return text_batches(docs.select(*keep, F.col("text_").cast("binary"))).mapInArrow(look_up, f"{kept}, {fields}")


def rare_sums(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """(row_id_, met, met_plus): of each row's rare words, how many were counted, and the sum of ln(count + 1)."""
    asked = coded.select("row_id_", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_id_", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    return asked.join(counts, "key").groupBy("row_id_").agg(F.sum("times").alias("met"), F.sum(F.col("times") * F.log(F.col("c") + 1)).alias("met_plus"))


def runs(batches, column: int):
    """Lists of (batch, row, slots) of about HELD_TOKENS tokens."""
    held, size = [], 0
    for batch in batches:
        for row, slots in enumerate(batch.column(column)):
            held.append((batch, row, np.frombuffer(slots.as_buffer(), np.int16)))
            size += len(held[-1][2])
            if size >= HELD_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def trained(rows: DataFrame, net: Net) -> Net:
    """The net after ROUNDS over ``rows`` (slots, draw 0 to 15), each row read once."""

    def run_from(start: Net):
        def run(batches):
            import pyarrow as pa

            own, read = start, 0
            for held in runs(batches, 0):
                tokens = np.concatenate([slots for _, _, slots in held])
                own, _ = own.learn(tokens)
                read += len(tokens)
            if read:
                yield pa.RecordBatch.from_arrays([pa.array([read], pa.int64()), pa.array([own.flat().tolist()], pa.list_(pa.float32()))], names=["read", "weights"])

        return run

    for low, high in ROUNDS:
        part = rows.where((F.col("draw") >= low) & (F.col("draw") < high)).select("slots")
        told = part.mapInArrow(run_from(net), "read long, weights array<float>").select("read", F.posexplode("weights").alias("at", "x"))
        # Whole numbers, so that the order in which tasks end does not show in the sums.
        whole = F.round(F.col("x").cast("double") * (1 << 24)).cast("decimal(19,0)") * F.col("read").cast("decimal(19,0)")
        sums = told.groupBy("at").agg((F.sum(whole) / F.sum("read")).cast("double").alias("x")).orderBy("at").collect()
        if sums:
            net = net.with_flat(np.array([r["x"] for r in sums]) / (1 << 24))
    return net


def scored(rows: DataFrame, net: Net, keep: list[str]) -> DataFrame:
    """``keep`` and ``net_score``, the natural log of the net's probability of the row's slots."""

    def run(batches):
        import pyarrow as pa

        for held in runs(batches, len(keep)):
            values = net.scores([slots for _, _, slots in held])
            out = []
            for (batch, row, _), value in zip(held, values):
                if not out or out[-1][0] is not batch:
                    out.append((batch, [], []))
                out[-1][1].append(row)
                out[-1][2].append(value)
            for batch, taken, found in out:
                columns = [c.take(pa.array(taken, pa.int32())) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=[*batch.schema.names[:-1], "net_score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.select(*keep, "slots").mapInArrow(run, f"{kept}, net_score double")


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` (a Column of ``docs``, never null) marks the rows that nothing is learned from.
    Scores are log10 probabilities of the whole text: base_score by counts with one added, score by
    the network.  Null and empty texts are one token, the end.  With no training text every word is
    unknown: base_score is 0, and to the network an end and an unknown word are equally likely.  Repeated rows count and are scored as often as they occur; null ids
    are kept.  Words of any length count; texts of any length are read to their end, in windows.
    Other columns are not read, whatever they are called.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id_"), held_out.alias("out_"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    counts = land(token_counts(rows.where(~F.col("out_")), "text_"))
    own = lexicon(counts)
    known = spark.sparkContext.broadcast(own)
    # Chosen by what is read, so that the rounds do not depend on how the table is dealt out.
    draw = F.pmod(F.xxhash64("id_", "n_tokens", "slots"), F.lit(16)).cast("int")
    coded = land(encoded(rows, known, ["id_", "out_"]).withColumns({"draw": draw, "row_id_": F.monotonically_increasing_id()}))
    met = land(rare_sums(coded, counts))
    net = trained(coded.where(~F.col("out_")).select("slots", "draw"), own.fresh())
    coded = coded.withColumn("n_rare", F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x))
    told = scored(coded, net, ["row_id_", "id_", "out_", "n_tokens", "n_known", "inner", "plus", "n_rare"])
    both = told.join(met, "row_id_", "left")
    ln10 = float(np.log(10))
    each, share = float(np.log(own.tokens + own.distinct + 1)), float(np.log(own.rare_mass))
    more = F.coalesce("met_plus", F.lit(0.0))
    base = (F.col("plus") + more - F.col("n_tokens") * each) / ln10
    score = (F.col("net_score") + F.col("inner") + more - F.col("n_rare") * share) / ln10
    return both.select(F.col("id_").alias(id_col), F.col("out_").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
                       F.lit(own.tokens).cast("long").alias("train_tokens"), F.round(base, 6).alias("base_score"), F.round(score, 6).alias("score"))
