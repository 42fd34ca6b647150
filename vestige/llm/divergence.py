"""Source divergence audit: how far the sources of a language lie from one another, term by term.

Arrow does the counting inside the tasks: texts are lower-cased, split by a pattern, dictionary
encoded and grouped by hash, and only partial counts leave a task.  Spark adds them up.  The kept
terms of a language are then dealt into shards; a shard is a matrix of sources by terms, in which
the divergences of all pairs of sources are added up column by column, in whole numbers.

Of a pair of sources p and q a term counts floor((p - q)^2 / (p + q)), where p and q are its
smoothed shares in parts of a billion: 1 + floor(10^9 (count + 2) / (N + 2 V)).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestige.llm.common import land, text_batches

#: What is not a letter of a term: ASCII but for A-Z and a-z.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a term must be in; terms told for each group.
LEAST_DOCUMENTS, TOP = 10, 10
#: Distinct (group, term) rows that a task holds before it hands its counts on.
HELD_ROWS = 400_000
#: Cells (source, term) of a shard.
SHARD_CELLS = 200_000
UNIT = 1_000


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) by task from ``docs`` (lang, source, text): occurrences and documents.

    A row with a null term holds the number of documents of its group.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

        def added(tables):
            both = pa.concat_tables(tables)
            return both.group_by(names[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(names)

        def counted(batch):
            groups = pa.table({"lang": batch.column(0), "source": batch.column(1)}).group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
            own = pa.table([groups.column(0), groups.column(1), pa.nulls(groups.num_rows, pa.string()), groups.column(2), groups.column(2)], schema=schema)
            split = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), pattern=BREAKS)
            owner, terms = pc.list_parent_indices(split), pc.list_flatten(split)
            real = pc.not_equal(terms, "")
            coded = pc.filter(terms, real).dictionary_encode()
            by_document = pa.table({"owner": pc.filter(owner, real), "code": coded.indices}).group_by(["owner", "code"], use_threads=False).aggregate([([], "count_all")])
            lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
            cells = pa.table({"lang": lang.indices.take(by_document["owner"]), "source": source.indices.take(by_document["owner"]), "code": by_document["code"], "n": by_document["count_all"]})
            cells = cells.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
            said = pa.table([lang.dictionary.take(cells["lang"]), source.dictionary.take(cells["source"]), coded.dictionary.take(cells["code"]),
                             cells["n_sum"].cast(pa.int64()), cells["count_all"].cast(pa.int64())], schema=schema)
            return pa.concat_tables([own, said])

        held, rows, merged = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(counted(batch))
            rows += held[-1].num_rows
            # Merged when what came since has as many rows as what was merged before, so a row is merged few times.
            if rows > max(HELD_ROWS, 2 * merged):
                held = [added(held)]
                rows = merged = held[0].num_rows
                if rows > HELD_ROWS:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows, merged = [], 0, 0
        if held:
            yield from added(held).combine_chunks().to_batches()

    return text_batches(docs.select("lang", "source", "text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), by long division in steps of a thousand."""
    rest, out, whole = counts + 2, np.zeros_like(counts), total + 2 * terms
    for _ in range(3):
        rest = rest * UNIT
        out, rest = out * UNIT + rest // whole, rest % whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shard_divergences(rows):
    """One shard of one language: an Arrow table (lang, source, term, n, all_n, total, all_total, terms).

    Rows with a null term name the sources of the language and their totals; the others are the
    terms of the shard where they occur.  Gives the sums of pairs (each once) and the ten terms
    of each source that lie farthest above the language.
    """
    import pyarrow as pa

    data = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in ("n", "all_n", "total", "all_total", "terms")}
    lang, source, term = rows.column("lang"), rows.column("source"), rows.column("term")
    named = np.asarray(term.is_null())
    # Sorted, so that a pair has the same order in every shard.
    sources, totals = zip(*sorted(zip(source.filter(pa.array(named)).to_pylist(), data["total"][named])))
    place = {s: i for i, s in enumerate(sources)}
    real = ~named
    own = term.filter(pa.array(real)).combine_chunks().dictionary_encode()
    words, code = own.dictionary.to_pylist(), own.indices.to_numpy()
    at = np.fromiter((place[s] for s in source.filter(pa.array(real)).to_pylist()), np.int64, int(real.sum()))
    matrix = np.zeros((len(sources), len(words)), np.int64)
    matrix[at, code] = data["n"][real]
    whole = np.zeros(len(words), np.int64)
    whole[code] = data["all_n"][real]
    out = []
    if len(words):
        terms, all_total = int(data["terms"][0]), int(data["all_total"][0])
        p = np.stack([shares(matrix[i], int(totals[i]), terms) for i in range(len(sources))])
        q = shares(whole, all_total, terms)
        for i in range(len(sources)):
            above = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
            if len(above):
                f = apart(p[i, above], q[above])
                # Ties at the last place all stay; the ranks over all shards decide.
                last = np.sort(f)[-min(TOP, len(f))]
                keep = f >= last
                chosen = sorted(zip(-f[keep], (words[k].encode() for k in above[keep])))[:TOP]
                out += [("term", sources[i], w.decode(), int(-v)) for v, w in chosen]
    for i in range(len(sources)):
        sums = apart(p[i + 1 :], p[i]).sum(axis=1).tolist() if len(words) else [0] * (len(sources) - i - 1)
        out += [("pair", sources[i], other, value) for other, value in zip(sources[i + 1 :], sums)]
    first = lang[0].as_py()
    parts, ones, items, values = zip(*out) if out else ([], [], [], [])
    return pa.table({"lang": pa.array([first] * len(out), pa.string()), "part": pa.array(parts, pa.string()), "source": pa.array(ones, pa.string()),
                     "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): every source of a language against the others.

    Part ``pair``: every other source of the language with the divergence of the two over all kept
    terms (0 without any).  Part ``term``: the TOP terms whose share is above the language's.  Ranks
    run from 1 by falling value, then rising item.  Null texts, languages and sources count as
    empty ones.  A language of one source has no pairs; an empty table gives no rows.  Repeated
    rows count as often as they occur, texts of any length are counted whole, other columns are
    not read.
    """
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # Dealt by (lang, term): the sums by source and those of the language need no further shuffle.
    parts = partial_counts(plain).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = land(parts)
    groups = found.where("term IS NULL").select("lang", "source")
    kept = found.where("term IS NOT NULL").withColumn("lang_docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("lang_docs") >= LEAST_DOCUMENTS)
    kept = land(kept.withColumn("all_n", F.sum("n").over(Window.partitionBy("lang", "term"))).select("lang", "source", "term", "n", "all_n"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("all_total"))
    size = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    none = F.lit(0).cast("long")
    known = groups.join(of_source, ["lang", "source"], "left").join(size.join(of_lang, "lang", "left"), "lang")
    known = known.select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("terms", none).alias("terms"), F.coalesce("all_total", none).alias("all_total"),
                         # At least as many terms as sources to a shard: the sums of a shard are no more rows than its cells.
                         F.greatest(F.lit(1), F.floor(F.coalesce("terms", none) * F.col("sources") / F.greatest(F.lit(SHARD_CELLS), F.col("sources") * F.col("sources")))).cast("int").alias("shards"))
    known = land(known)
    cells = kept.join(known.select("lang", "source", "total", "terms", "all_total", "shards"), ["lang", "source"])
    cells = cells.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n", "all_n", "total", "all_total", "terms")
    heads = known.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", F.lit(None).cast("string").alias("term"),
                         none.alias("n"), none.alias("all_n"), "total", "all_total", "terms")
    told = cells.unionByName(heads).groupBy("lang", "shard").applyInArrow(shard_divergences, "lang string, part string, source string, item string, value long")
    sums = told.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    turned = sums.select("lang", "part", F.explode(F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
                                                   .otherwise(F.array(F.struct("source", "item")))).alias("x"), "value")
    every = turned.select("lang", "x.source", "part", "x.item", "value")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM d
), words AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}
), lang_size AS (
  SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang
), own AS (
  SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), own_size AS (
  SELECT lang, source, sum(c)::HUGEINT AS n FROM own GROUP BY lang, source
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN lang_size l ON l.lang = g.lang
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
  LEFT JOIN own_size s ON s.lang = g.lang AND s.source = g.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cells WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM told
) WHERE part = 'pair' OR rank <= {TOP}
"""
