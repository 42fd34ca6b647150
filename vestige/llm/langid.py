"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A trigram is the
product of its letters' vectors, the first rolled by two places, the second by one.  A text is
the sum of its trigrams, a language the sum of its texts, each at length one.  A text gets the
language of the highest cosine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import land, text_batches

DIMENSIONS = 1024
#: Training takes at most about so many texts of a language.
PER_LANGUAGE = 4000
SEED = 20240
#: Longer texts are bundled in pieces of so many characters, and the pieces summed.
PIECE = 1_000_000
UNDETERMINED = "und"

_letters: dict[int, object] = {}
_is_letter: list = []


def letter(code: int):
    import numpy as np

    if code not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return _letters[code]


def spelled(text: str):
    """Code points of the lower-cased letters, every run of other characters one blank, blanks at both ends; none without a letter."""
    import numpy as np

    if not _is_letter:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _is_letter.append(table)
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter[0][codes], codes, 32)
    keep = codes != 32
    if not keep.any():
        return codes[:0]
    keep[1:] |= codes[:-1] != 32
    keep[0] = keep[1]
    return codes[keep] if keep[0] else np.concatenate([[32], codes[keep]]).astype(np.uint32)


def bundles(texts: list[str | None]):
    """(number of texts, DIMENSIONS): the sums of trigram vectors; zeros without a letter."""
    import numpy as np

    pieces, owners = [], []
    for i, text in enumerate(texts):
        for start in range(0, len(text or ""), PIECE):
            codes = spelled(text[start : start + PIECE])
            if len(codes):
                pieces.append(codes)
                owners.append(i)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not pieces:
        return out
    codes = np.concatenate(pieces)
    part = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    same = part[2:] == part[:-2]
    owner = np.asarray(owners)[part[:-2][same]]
    alphabet = np.flatnonzero(np.bincount(codes))
    place = np.zeros(int(alphabet[-1]) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    small, n = place[codes], len(alphabet)
    gram = ((small[:-2] * n + small[1:-1]) * n + small[2:])[same]
    if n**3 <= 1 << 23:
        seen = np.flatnonzero(np.bincount(gram, minlength=n**3))
        index = np.zeros(n**3, np.int64)
        index[seen] = np.arange(len(seen))
        gram = index[gram]
    else:
        seen, gram = np.unique(gram, return_inverse=True)
    base = np.stack([letter(int(c)) for c in alphabet])
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    order = None
    if len(seen) > 8192:  # keeps the count matrix and the trigram vectors small
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
    for low in range(0, len(seen), 8192):
        block = seen[low : low + 8192]
        if order is None:
            g, o = gram, owner
        else:
            a, b = np.searchsorted(gram, [low, low + len(block)])
            g, o = gram[a:b] - low, owner[a:b]
        counts = np.bincount(o * len(block) + g, minlength=len(texts) * len(block)).reshape(len(texts), len(block)).astype(np.float32)
        vectors = first[block // (n * n)] * second[block // n % n] * base[block % n]
        out += counts @ vectors.astype(np.float32)
    return out


def units(vectors):
    import numpy as np

    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def groups(texts: list[str | None]):
    """Slices of the texts with few texts and characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if i + 1 - first >= 256 or size >= 1_500_000 or i + 1 == len(texts):
            yield slice(first, i + 1)
            first, size = i + 1, 0


def profiles(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> dict[str, list[float]]:
    """Language to prototype, from the rows where ``learn`` holds and the language is not null.

    Languages with more rows than ``per_language`` give about that many, chosen by a hash of the
    key.  Partitions send one vector for each language; the sums come to the driver, one vector
    for each language.
    """
    import numpy as np

    rows = docs.where(learn & F.col(lang_col).isNotNull())
    # Landed, so that its size is known and the texts are not dealt out by language.
    counts = land(rows.groupBy(F.col(lang_col).alias("known")).agg(F.count(F.lit(1)).alias("n")))
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) / (1 << 20)
    chosen = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    chosen = chosen.join(counts, chosen["lang"] == counts["known"]).where(F.col("draw") * F.col("n") < per_language).select("lang", "text")

    def sums(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in groups(texts):
                for lang, vector in zip(langs[part], units(bundles(texts[part]))):
                    total[lang] = total.get(lang, 0) + vector.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "profile": [v.tolist() for v in total.values()]},
                                             schema=pa.schema([("lang", pa.string()), ("profile", pa.list_(pa.float64()))]))

    parts = chosen.mapInArrow(sums, "lang string, profile array<double>")
    summed = parts.select("lang", F.posexplode("profile").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p")).select("lang", "p.x").collect()
    return {r["lang"]: r["x"] for r in whole if any(r["x"])}


def identify(docs: DataFrame, known: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Per row of ``docs``: the id, lang_pred, score (cosine, 0 to 1), and the columns ``keep``.

    ``und`` with score 0 for null, empty and letterless texts, and for all if no language is
    known.  Ties go to the language that sorts first.  Whole texts are read, long ones piece by
    piece.  Repeated rows give repeated rows.  Columns of ``keep`` may not be called lang_pred or
    score.
    """
    import numpy as np

    names = sorted(known)
    table = units(np.array([known[n] for n in names], np.float64)).astype(np.float32) if names else None
    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text_"), *[F.col(f"`{k}`") for k in keep])
    fields = [f for f in picked.schema.fields if f.name != "text_"]
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for part in groups(texts):
                vectors = units(bundles(texts[part]))
                if not names:
                    langs += [UNDETERMINED] * len(vectors)
                    scores += [0.0] * len(vectors)
                    continue
                near = vectors @ table.T
                best = near.argmax(axis=1)
                for v, row, b in zip(vectors, near, best):
                    there = bool(v.any())
                    langs.append(names[b] if there else UNDETERMINED)
                    scores.append(round(min(1.0, max(0.0, float(row[b]))), 6) if there else 0.0)
            columns = [c for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*[n for i, n in enumerate(batch.schema.names) if i != 1], "lang_pred", "score"])

    return text_batches(picked).mapInArrow(run, schema)


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(modulus)) == remainder
