"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

Every line of a text is compared with the templates as a sparse TF-IDF vector; the weights are
counted over all texts.  A file has the licence of its best line.  A short file that is little
else than a licence text licenses its directory; files without a licence of their own inherit
from the nearest directory above them that has one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import land, text_batches

#: Identifiers and the sentences that stand for them in headers and licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This program is free software licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
LEAST_COSINE = 0.7
#: A file is a licence file if its licensing lines hold at least this share of its words.
LICENCE_FILE_SHARE = 0.5


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


def term_weights(docs: DataFrame, text_col: str) -> dict[str, float]:
    """Inverse document frequency of the templates' terms over all texts; as many rows as they have terms."""
    import math

    wanted = sorted({t for _, s in TEMPLATES for t in terms(s)})

    def run(batches):
        import pyarrow as pa

        counts, n = dict.fromkeys(wanted, 0), 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                for t in counts.keys() & set(terms(text.as_py() or "")):
                    counts[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*counts, ""]), pa.array([*counts.values(), n], pa.int64())], names=["term", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return {t: math.log((found.get("", 0) + 1) / (found.get(t, 0) + 1)) + 1 for t in wanted}


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, path, own_license (or null), cosine (0 where no line comes near a template), is_license_file.

    Terms outside the templates weigh as much as the rarest term of them.  Ties go to the
    identifier that sorts first.  Null and empty texts have no licence.
    """
    import math

    weights = term_weights(docs, text_col)
    other = max(weights.values(), default=1.0)
    vectors = []
    for name, text in TEMPLATES:
        raw: dict[str, float] = {}
        for t in terms(text):
            raw[t] = raw.get(t, 0) + weights[t]
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append((name, {t: x / norm for t, x in raw.items()}))

    def best_of(line: str) -> tuple[float, str | None, int]:
        """Over the whole line, and over its sentences."""
        best: tuple[float, str | None, int] = (0.0, None, 0)
        for part in {line, *re.split(r"(?<=[a-z0-9])[.!?]\s+(?=[A-Z])", line)}:
            words = terms(part)
            if weights.keys().isdisjoint(words):
                continue
            raw: dict[str, float] = {}
            for t in words:
                raw[t] = raw.get(t, 0) + weights.get(t, other)
            norm = math.sqrt(sum(x * x for x in raw.values()))
            if math.sqrt(sum(x * x for t, x in raw.items() if t in weights)) < LEAST_COSINE * norm:
                continue  # no template can reach the cosine
            for name, vector in vectors:
                dot = sum(x * vector[t] for t, x in raw.items() if t in vector) / norm
                if (-dot, name) < (-best[0], best[1] or "~"):
                    best = (dot, name, len(words))
        return best

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, cosines, whole = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                best, licensed = (0.0, None, 0), 0
                for line in text.split("\n"):
                    found = best_of(line)
                    licensed += found[2] if found[0] >= LEAST_COSINE else 0
                    if (-found[0], found[1] or "~") < (-best[0], best[1] or "~"):
                        best = found
                good = best[0] >= LEAST_COSINE
                names.append(best[1] if good else None)
                cosines.append(round(min(best[0], 1.0), 6))
                whole.append(good and licensed >= LICENCE_FILE_SHARE * len(text.split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(cosines, pa.float64()), pa.array(whole, pa.bool_())],
                                             names=["doc_id", "path", "own_license", "cosine", "is_license_file"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text_"))
    return text_batches(rows).mapInArrow(run, "doc_id long, path string, own_license string, cosine double, is_license_file boolean")


def directory(path: Column) -> Column:
    """What stands before the last slash; the root is the empty path."""
    return F.regexp_replace(F.when(F.instr(path, "/") > 0, path).otherwise(F.lit("/")), "/[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """``files`` (doc_id, path, own_license, is_license_file, ...) with license and inherited_from (directory or null).

    Of several licence files of a directory the first path counts.  Ancestors are joined for
    distinct directories, not for files; a null path inherits nothing.
    """
    files = files.withColumn("dir", directory(F.col("path")))
    given = files.where("is_license_file and path is not null").groupBy("dir").agg(F.min_by("own_license", F.struct("path", "own_license")).alias("dir_license"))
    dirs = files.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))).alias("a")).select("dir", "a.depth", "a.up")
    chosen = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_license")).alias("near"))
    out = files.join(chosen, "dir", "left")
    heir = F.col("own_license").isNull() & F.col("near").isNotNull()
    return out.select(*[c for c in files.columns if c != "dir"], F.coalesce("own_license", "near.dir_license").alias("license"), F.when(heir, F.col("near.up")).alias("inherited_from"))


def license_report(docs: DataFrame, path: Column) -> DataFrame:
    return inherited(land(scan(docs, path)))
