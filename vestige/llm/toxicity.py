"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the terms present in a
text.  The pair term lets two words count together that are harmless apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import text_batches
from vestige.llm.textmodel import Buckets, joined_texts, labelled_sample, present

BITS = 18
FACTORS = 4
#: Labelled rows that the model is fitted on at most.
SAMPLE = 12_000
#: Buckets weigh nothing that are in fewer texts of the sample, or whose share of toxic texts is
#: within so many standard errors of the whole sample's, alone and in every pair (see telling_pairs).
LEAST_TEXTS = 3
LEAST_ERRORS = 3.0
EPOCHS = 30
SEED = 11


@dataclass
class Machine:
    bias: float
    weights: object  # (buckets,)
    factors: object  # (buckets, FACTORS)

    def margins(self, flat, sizes):
        """flat: the buckets of all texts in a row, sizes: how many each text has."""
        import numpy as np

        owner = np.repeat(np.arange(len(sizes)), sizes)
        linear = np.bincount(owner, self.weights[flat], len(sizes))
        v = self.factors[flat]
        pairs = np.zeros(len(sizes))
        for f in range(v.shape[1]):
            pairs += np.bincount(owner, v[:, f], len(sizes)) ** 2 - np.bincount(owner, v[:, f] ** 2, len(sizes))
        return self.bias + linear + pairs / 2


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling_pairs(flat, owner, labels, shares, alone):
    """Which terms tell in a pair though not ``alone``: the texts with both are toxic more or less often than those with either.

    The standard errors asked for grow with the number of pairs, so that chance alone keeps about none.
    flat: terms from 0, by text; shares: each term's share of toxic texts.
    """
    import numpy as np

    size = len(shares)
    tells = np.zeros(size, bool)
    errors = max(LEAST_ERRORS, np.sqrt(2 * np.log(max(size, 2) ** 2)))
    order = np.argsort(flat, kind="stable")
    texts_of = np.split(owner[order], np.cumsum(np.bincount(flat, minlength=size))[:-1])
    terms_of = np.split(flat, np.cumsum(np.bincount(owner, minlength=len(labels)))[:-1])
    p = np.clip(shares, 1e-3, 1 - 1e-3)
    for t in np.flatnonzero(~alone):
        met = texts_of[t]
        others = np.concatenate([terms_of[i] for i in met])
        both = np.bincount(others, minlength=size)
        toxic = np.bincount(others, np.repeat(labels[met], [len(terms_of[i]) for i in met]), size)
        some = np.flatnonzero(both >= LEAST_TEXTS)
        some = some[some != t]
        far = np.ones(len(some), bool)
        for q in (p[some], p[t]):
            far &= np.abs(toxic[some] - q * both[some]) >= errors * np.sqrt(q * (1 - q) * both[some])
        if far.any():
            tells[t] = True
            tells[some[far]] = True
    return tells


def fit(flat, sizes, labels) -> Machine:
    """Adam on the logistic loss over the buckets that tell toxic texts from others."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    size = 1 << BITS
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = np.clip(np.mean(labels), 1e-3, 1 - 1e-3)
    texts = np.bincount(flat, minlength=size)
    toxic = np.bincount(flat, labels[owner], size)
    often = texts >= LEAST_TEXTS
    alone = often & (np.abs(toxic - share * texts) >= LEAST_ERRORS * np.sqrt(share * (1 - share) * np.maximum(texts, 1)))
    if often.any():
        number = np.cumsum(often) - 1
        paired = telling_pairs(number[flat[often[flat]]], owner[often[flat]], labels, (toxic / np.maximum(texts, 1))[often], alone[often])
        alone[np.flatnonzero(often)[paired]] = True
    often = alone
    keep = often[flat]
    flat, owner = flat[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(sizes))
    used = np.flatnonzero(often)
    place = np.zeros(size, np.int64)
    place[used] = np.arange(len(used))
    flat = place[flat]
    params = [np.array([np.log(share / (1 - share))]), np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS))]
    decay = (0.0, 1e-4, 1e-4)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    step = 0
    for _ in range(EPOCHS if len(used) else 0):
        order = rng.permutation(len(sizes))
        for batch in np.array_split(order, min(len(order), max(20, len(order) // 500))):
            idx = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch]) if len(batch) else np.zeros(0, np.int64)
            f, own = flat[idx], np.repeat(np.arange(len(batch)), sizes[batch])
            bias, w, v = params
            rows = v[f]
            sums = np.stack([np.bincount(own, rows[:, k], len(batch)) for k in range(FACTORS)], axis=1)
            squares = np.bincount(own, (rows**2).sum(axis=1), len(batch))
            z = bias[0] + np.bincount(own, w[f], len(batch)) + ((sums**2).sum(axis=1) - squares) / 2
            err = (sigmoid(z) - labels[batch]) / len(batch)
            e = err[own]
            grads = [np.array([err.sum()]), np.bincount(f, e, len(used)),
                     np.stack([np.bincount(f, e * (sums[own, k] - rows[:, k]), len(used)) for k in range(FACTORS)], axis=1)]
            step += 1
            for p, g, a, b, d in zip(params, grads, first, second, decay):
                g = g + d * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    weights, factors = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    weights[used], factors[used] = params[1], params[2]
    return Machine(float(params[0][0]), weights, factors)


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text_col: str = "text", label: str = "toxic", bound: int = SAMPLE) -> Machine:
    """Fits on at most ``bound`` labelled rows where ``usable`` holds; their bucket lists come to the driver.

    Null labels are no labels.  Without a labelled row every score is one half.
    """
    import numpy as np

    sample = labelled_sample(labels.select(key, F.col(label).cast("double").alias("label_")).where("label_ is not null"), usable, key, bound)

    def run(batches):
        import pyarrow as pa

        buckets = Buckets(BITS)
        for batch in batches:
            rows = [present(t, buckets) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "label", "terms"])

    made = joined_texts(docs, sample, key, text_col).select("text_", F.col(key).cast("long"), "label_").mapInArrow(run, "key long, label double, terms binary")
    got = made.collect()
    got.sort(key=lambda r: (r["key"], bytes(r["terms"])))
    got = got[:bound]  # ids may recur in the texts
    rows = [np.frombuffer(r["terms"], np.int32) for r in got]
    if not rows:
        return Machine(0.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32))
    return fit(np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows]), np.array([r["label"] for r in got]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and score (0 to 1).  Null and empty texts get the score of no terms."""
    import numpy as np

    model = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: 2^BITS buckets
    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    fields = picked.schema.fields[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        buckets, own = Buckets(BITS), model.value
        for batch in batches:
            texts, out = batch.column(1), []
            for low in range(0, len(texts), 200):
                rows = [present(t.as_py(), buckets) for t in texts.slice(low, 200)]
                out.append(sigmoid(own.margins(np.concatenate(rows), np.array([len(r) for r in rows]))))
            scores = np.round(np.concatenate(out), 6) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return text_batches(picked).mapInArrow(run, f"`{id_col}` {fields}, score double")
