"""The divergence audit against its SQL twin and a plain reckoning, with odd rows."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vestige.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, n long, rank int, docs string, term string"


def brute(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    in_docs, in_group, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        in_docs[lang].update(set(terms))
        in_group[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= 10]
        v = len(kept)
        whole = {t: sum(in_group[lang, s][t] for s in sources) for t in kept}
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * v) for t in kept}
        q, p = share(whole), {s: share(in_group[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if in_group[lang, s][t] > 0 and p[s][t] > q[t])[:10]
            for part, told in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(told)]
    return sorted(out)


def made():
    draw = np.random.default_rng(5)
    words = ["the", "The", "été", "ÉTÉ", "Été", "of", "cat", "日本", "x" * 5000, "dog's", "a1b", "\x00z"] + [f"w{chr(97 + i)}{chr(97 + i % 7)}" for i in range(40)]
    rows = []
    for i in range(400):
        lang, source = (("en", "fr", None, "")[i % 4], (None, "s0", "s1", "", "Z")[int(draw.integers(0, 5))])
        rows.append((None if i % 9 == 0 else i, " ".join(draw.choice(words, int(draw.integers(0, 60)))), lang, source))
    rows += [(1, None, "en", "s0"), (2, "", "en", "only empty"), (3, "12 34 !", "alone", "s0"), (4, "few words here", "few", "s0"), (5, "others there", "few", "s1"), (6, "few", "few", None)]
    return rows + rows[:50]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 7, 1, "d", "t") for r in made()], SCHEMA).repartition(5)


def told(df):
    return sorted(tuple(r[n] for n in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_against_a_plain_reckoning(table, monkeypatch):
    want = brute([r[1:4] for r in made()])
    assert told(divergence.audit(table)) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "few" and r[4] == 0 for r in want)


def test_against_its_sql(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(queries.SQL["op13_divergence"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(n)] for n in ("lang", "source", "part", "item", "value", "rank")) for r in cur.fetchall())
    got = queries.QUERIES["op13_divergence"](spark, str(tmp_path))
    assert told(got) == want and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_small_shards_and_early_counts_change_nothing(table, spark, monkeypatch):
    want = told(divergence.audit(table))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    one_shard = divergence.SHARD_CELLS
    divergence.SHARD_CELLS, divergence.HELD_ROWS = 30, 40
    try:
        assert told(divergence.audit(table)) == want
    finally:
        divergence.SHARD_CELLS, divergence.HELD_ROWS = one_shard, 400_000
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_an_empty_table(table):
    assert divergence.audit(table.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact():
    counts = np.array([0, 7, 10**12, 9 * 10**14])
    total, terms = int(counts.sum()), 4
    assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]
