"""Quality by ordinal cumulative-link regression.

P(grade <= k) = sigmoid(threshold_k - w.x), one weight vector for all grades and ordered
thresholds; x are hashed terms and word shapes of the whole text, scaled to length one.  The
model gives the expected grade and the probability of the top grades.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import text_batches
from vestige.llm.textmodel import Buckets, joined_texts, labelled_sample

BITS = 16
#: Labelled rows that the model is fitted on at most.
SAMPLE = 12_000
EPOCHS = 25
SEED = 5
RUNS = re.compile(r"(.)\1+")
SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})


class Terms(Buckets):
    """Word to its bucket and its shape's."""

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        shape = RUNS.sub(r"\1", "".join("a" if ord(c) > 127 and c.islower() else "A" if ord(c) > 127 and c.isupper() else c for c in word.translate(SHAPE)))
        hashed = Buckets(BITS)
        found = self[word] = (hashed["w:" + word.lower()], hashed["s:" + shape])
        return found


def features(text: str | None, terms: Terms):
    """Buckets (sorted) and their values: roots of counts and the share of words seen before, at length one."""
    import numpy as np

    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    pairs = np.array([terms[w] for w in words], np.int64)
    shape, times = np.unique(pairs[:, 1], return_counts=True)
    word, often = np.unique(pairs[:, 0], return_counts=True)
    idx = np.concatenate([word, shape, [terms.mask + 1]])
    val = np.concatenate([np.sqrt(often / len(words)) * 0.5, np.sqrt(times / len(words)), [1 - len(word) / len(words)]])
    order = np.argsort(idx, kind="stable")
    return idx[order].astype(np.int32), (val[order] / np.linalg.norm(val)).astype(np.float32)


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Ordinal:
    weights: object
    thresholds: object  # increasing, one fewer than grades

    def tails(self, margins):
        """(texts, thresholds): P(grade > k)."""
        return 1 - sigmoid(self.thresholds[None, :] - margins[:, None])


def margins(weights, idx, val, sizes):
    import numpy as np

    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights[idx] * val, len(sizes))


def fit(idx, val, sizes, grades, n_grades: int) -> Ordinal:
    """Adam on the negative log likelihood; thresholds stay ordered as a start and positive steps."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    w = np.zeros((1 << BITS) + 1)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades), 0.01, 0.99)
    first = np.log(share / (1 - share))
    raw = np.concatenate([[first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    params, m, v, step = [w, raw], [np.zeros_like(w), np.zeros_like(raw)], [np.zeros_like(w), np.zeros_like(raw)], 0
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(EPOCHS):
        order = rng.permutation(len(sizes))
        for batch in np.array_split(order, max(1, len(order) // 400)):
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch])
            size, y = sizes[batch], grades[batch]
            th = np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])
            z = margins(w, idx[at], val[at], size)
            edges = np.concatenate([np.full((len(z), 1), 0.0), sigmoid(th[None, :] - z[:, None]), np.full((len(z), 1), 1.0)], axis=1)
            slope = edges * (1 - edges)
            rows = np.arange(len(z))
            p = np.maximum(edges[rows, y + 1] - edges[rows, y], 1e-9)
            dz = (slope[rows, y + 1] - slope[rows, y]) / p / len(z)
            dth = np.zeros(len(th))
            for k in range(len(th)):
                dth[k] = -((slope[:, k + 1] * (y == k) - slope[:, k + 1] * (y == k + 1)) / p).mean()
            draw = np.concatenate([[dth.sum()], [dth[k + 1 :].sum() * np.exp(raw[k + 1]) for k in range(len(th) - 1)]])
            dw = np.bincount(idx[at], np.repeat(dz, size) * val[at], len(w)) + 1e-5 * w
            step += 1
            for q, g, a, b in zip(params, (dw, draw), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.03 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Ordinal(w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))]))


def train(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, usable: Column, key: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Ordinal:
    """Fits on at most ``bound`` rows with a grade (0 to n_grades - 1) where ``usable`` holds; their sparse rows come to the driver.

    Without a graded row all grades are equally likely.
    """
    import numpy as np

    sample = labelled_sample(labels.select(key, grade.cast("int").alias("grade_")).where("grade_ is not null"), usable, key, bound)

    def run(batches):
        import pyarrow as pa

        terms = Terms(BITS)
        for batch in batches:
            made = [features(t.as_py(), terms) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["key", "grade", "idx", "val"])

    got = joined_texts(docs, sample, key, text_col).select("text_", F.col(key).cast("long"), "grade_").mapInArrow(run, "key long, grade int, idx binary, val binary").collect()
    got = sorted(got, key=lambda r: (r["key"], bytes(r["idx"])))[:bound]
    if not got:
        return Ordinal(np.zeros((1 << BITS) + 1), np.log(np.arange(1, n_grades) / (n_grades - np.arange(1, n_grades))))
    idx = np.concatenate([np.frombuffer(r["idx"], np.int32) for r in got])
    val = np.concatenate([np.frombuffer(r["val"], np.float32) for r in got])
    return fit(idx, val, np.array([len(r["idx"]) // 4 for r in got]), np.array([r["grade"] for r in got]), n_grades)


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, expected_grade and tail (double): the probability of more than the lowest grade.  Null and empty texts have no features."""
    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^BITS weights
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    kind = rows.schema.fields[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        terms, own = Terms(BITS), sent.value
        for batch in batches:
            z = np.zeros(len(batch.column(1)))
            for i, text in enumerate(batch.column(1)):
                idx, val = features(text.as_py(), terms)
                z[i] = float(own.weights[idx] @ val)
            tails = own.tails(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(tails.sum(axis=1), 6)), pa.array(np.round(tails[:, 0], 6))], names=[id_col, "expected_grade", "tail"])

    return text_batches(rows).mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, tail double")
