"""Vectors as short codes: each part of a vector names the nearest entry of that part's codebook.

The nearest entry is found by equal-average search.  A codebook's entries are sorted by the sum of
their components; a part starts at its own sum's place among them and looks outward, on either side
in turn by the nearer sum.  The squared gap of two sums over the number of components is never more
than the squared distance, so the search ends where that strictly exceeds the best distance
found; entries at an equal distance are thus all seen, and the lowest index wins.

Components are whole numbers, floor(4096 x), so sums, distances and codebooks are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import land, text_batches

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Below this, squared distances of thousands of components are exact in 64 bits.
LARGEST = 1 << 25


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance for each row of ``parts`` (rows, components)."""
    rows, size = parts.shape
    sums, entry_sums = parts.sum(axis=1), book.sum(axis=1)
    order = np.argsort(entry_sums, kind="stable")
    ranked = entry_sums[order]
    high = np.searchsorted(ranked, sums)
    low = high - 1
    best, found = np.full(rows, -1, parts.dtype), np.full(rows, len(book), np.int64)
    going = np.arange(rows)
    while len(going):
        lo, hi, own = low[going], high[going], sums[going]
        below = np.where(lo >= 0, own - ranked[np.maximum(lo, 0)], -1)
        above = np.where(hi < len(book), ranked[np.minimum(hi, len(book) - 1)] - own, -1)
        down = (below >= 0) & ((above < 0) | (below <= above))
        gap = np.where(down, below, above)
        # Nothing left on either side, or all that is left is farther than the best.
        more = (gap >= 0) & ((found[going] == len(book)) | (gap * gap <= best[going] * size))
        going, down = going[more], down[more]
        if not len(going):
            break
        entry = order[np.where(down, low[going], high[going])]
        far = ((parts[going] - book[entry]) ** 2).sum(axis=1)
        better = (found[going] == len(book)) | (far < best[going]) | ((far == best[going]) & (entry < found[going]))
        best[going[better]], found[going[better]] = far[better], entry[better]
        low[going[down]] -= 1
        high[going[~down]] += 1
    return found, best


def codes(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts): indexes, and squared distances."""
    size = vectors.shape[1] // len(books)
    told = [nearest(vectors[:, k * size : (k + 1) * size], book) for k, book in enumerate(books)]
    return np.stack([f for f, _ in told], axis=1), np.stack([d for _, d in told], axis=1)


def whole_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """``rows`` with ``packed``, the floors of SCALE x as 64-bit numbers in a row, without unusable vectors."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(F.col(f"`{vector_col}`").isNotNull()).where(fine)
    floors = F.transform(x, lambda v: F.when(F.abs(v) * SCALE < LARGEST, F.floor(v * SCALE)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")))
    return kept.withColumn("floors", floors)


def matrix(column, size: int) -> np.ndarray:
    """Packed vectors of an Arrow batch, all of ``size`` components."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), size)


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` (id_, label_, floors) with the floors as bytes: quick to read again in every round."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            floors = batch.column(2)
            data, ends = np.asarray(floors.flatten()).astype(np.int64).tobytes(), np.concatenate([[0], np.cumsum(np.asarray(floors.value_lengths()))]) * 8
            told = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.binary())], names=["id_", "label_", "packed"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return text_batches(rows).mapInArrow(run, f"id_ {kinds['id_']}, label_ {kinds['label_']}, packed binary")


def moved(rows: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks after one round: every used entry goes to the floored mean of its parts."""
    part = size // len(books)

    def run(batches):
        import pyarrow as pa

        counts, sums = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), len(books[0]), part), np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0), size)
            if not len(vectors):
                continue
            found, _ = codes(vectors, books)
            for k in range(len(books)):
                own = vectors[:, k * part : (k + 1) * part]
                order = np.argsort(found[:, k], kind="stable")
                there, first = np.unique(found[order, k], return_index=True)
                sums[k, there] += np.add.reduceat(own[order], first, axis=0)
                counts[k] += np.bincount(found[:, k], minlength=len(books[0]))
        ks, es = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(es, pa.int32()), pa.array(counts[ks, es], pa.int64()), pa.array(list(sums[ks, es]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    # One row for each used entry and component comes to the driver: as many numbers as the codebooks hold.
    told = rows.select("packed").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    wide = "decimal(38,0)"
    added = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("x").cast(wide)).alias("x"))
    out = [book.copy() for book in books]
    for r in added.collect():
        out[r["part"]][r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: the id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped.  The codebooks
    start as the parts of the ``entries`` smallest ids (nulls after all others, equal ids by their
    vectors; with fewer rows, fewer entries) and move ``rounds`` times.  error is the sum of squared
    distances, label_error its sum over rows of one label, null being a label of its own.  Repeated
    rows count as often as they occur; other columns are not read; an empty table gives no rows.

    Vectors whose length is not that of the first starting one get null for code and error and move
    nothing.  A length that cannot be cut into ``parts`` raises ValueError; a component
    of LARGEST or more after scaling fails the job, for its squares might not be exact.
    """
    plain = vectors.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{label_col}`").alias("label_"), F.col(f"`{vector_col}`").alias("vector_"))
    every = land(packed(whole_vectors(plain, "vector_").select("id_", "label_", "floors")))
    starts = [bytes(r["packed"]) for r in every.orderBy(F.asc_nulls_last("id_"), "packed").limit(entries).select("packed").collect()]
    length = len(starts[0]) if starts else 0
    size = length // 8
    if size % parts:
        raise ValueError(f"{size} components cannot be cut into {parts} equal parts")
    fits = F.octet_length("packed") == length
    first = np.stack([np.frombuffer(s, np.int64) for s in starts if len(s) == length]) if starts else np.zeros((0, 0), np.int64)
    part = size // parts
    books = [first[:, k * part : (k + 1) * part].copy() for k in range(parts)]
    if size:
        for _ in range(rounds):
            books = moved(every.where(fits), books, size)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = matrix(batch.column(2), size) if size else np.zeros((batch.num_rows, 0), np.int64)
            if not batch.num_rows:
                continue
            found, far = codes(own, books) if size else (np.zeros((batch.num_rows, parts), np.int64), np.zeros((batch.num_rows, parts), np.int64))
            said = ["".join(f"{x:02x}" for x in row) for row in found.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said), pa.array(far.sum(axis=1), pa.int64())], names=["id_", "label_", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in every.schema.fields}
    schema = f"id_ {kinds['id_']}, label_ {kinds['label_']}, code string, error long"
    coded = every.where(fits).mapInArrow(run, schema)
    odd = every.where(~fits).select("id_", "label_", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = land(coded.unionByName(odd))
    # Landed, so that its size is known: labels may be few or as many as rows.
    sums = land(coded.groupBy(F.col("label_").alias("of_")).agg(F.sum("error").alias("label_error")))
    both = coded.join(sums, coded["label_"].eqNullSafe(sums["of_"]))
    return both.select(F.col("id_").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB: every part against every entry, in as many steps as there are rounds."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT r, part, arg_min(entry, far * 100 + entry) AS entry, min(far) AS far FROM (
    SELECT c.r, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS far FROM cells c JOIN b{k} b ON b.part = c.part AND b.spot = c.spot GROUP BY c.r, c.part, b.entry
  ) GROUP BY r, part
)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS (
  SELECT b.part, b.entry, b.spot, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT a.part, a.entry, c.spot, CASE WHEN sum(c.x) >= 0 THEN sum(c.x) // count(*) ELSE -((-sum(c.x) + count(*) - 1) // count(*)) END AS x
    FROM a{k} a JOIN cells c ON c.r = a.r AND c.part = a.part GROUP BY a.part, a.entry, c.spot
  ) m ON m.part = b.part AND m.entry = b.entry AND m.spot = b.spot
)""")
    steps = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), spread AS (
  SELECT r, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i, len(v) // {parts} AS size FROM kept
), cells AS MATERIALIZED (
  SELECT r, i // size AS part, i % size AS spot, x FROM spread
), b0 AS (
  SELECT part, r - 1 AS entry, spot, x FROM cells WHERE r <= {entries}
), {steps}, told AS (
  SELECT r, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, spot)) AS d FROM b{rounds}
)
SELECT k.vec_id, t.code, t.error, sum(t.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.d AS codebooks_sha256
FROM kept k JOIN told t ON t.r = k.r, digest d
"""
