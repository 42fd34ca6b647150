"""Vector codes against brute force and the SQL twin, with ties, odd rows and odd names."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from vestige.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id_ int, label_ string, packed int, of_ int, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    part = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * part : (k + 1) * part]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, k: min((far(cut(v, k), b), e) for e, b in enumerate(books[k]))
    for _ in range(rounds):
        held = {}
        for _, v, _ in kept:
            for k in range(parts):
                held.setdefault((k, best(v, k)[1]), []).append(cut(v, k))
        for (k, e), own in held.items():
            books[k][e] = [sum(c) // len(own) for c in zip(*own)]
    told = [(i, [best(v, k) for k in range(parts)], label) for i, v, label in kept]
    by_label = {}
    for _, b, label in told:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in b)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), by_label[label], digest) for i, b, label in told]


def made(n=150, size=16):
    draw = np.random.default_rng(8)
    rows = [(int(i) * 3, [float(x) for x in draw.choice([-0.5, -0.25, 0.0, 0.0001, 0.3, 1.7], size)], (None, 1, 2)[i % 3]) for i in range(n)]
    rows += [(1, None, 1), (2, [0.1] * (size - 1) + [float("nan")], 1), (4, [float("inf")] + [0.0] * (size - 1), 2), (5, [None] + [0.0] * (size - 1), 2), (None, [0.25] * size, None)]
    return rows + rows[40:60]


def shown(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1, "l", 2, 3, "c") for r in made()], SCHEMA).repartition(4)


def test_against_brute_force(table):
    got = vector_codes.compress(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert shown(got.collect()) == shown(brute(made()))


@pytest.mark.parametrize("n", [1, 5, 16])
def test_few_rows(spark, n):
    rows = made(n)[:n]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert shown(got.collect()) == shown(brute(rows))


def test_the_query_and_its_sql(spark, table, tmp_path):
    table.where("vec_id IS NOT NULL").dropDuplicates(["vec_id"]).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    cur = con.execute(queries.SQL["op12_vector_codes"])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES["op12_vector_codes"](spark, str(tmp_path)).select(*names)
    assert shown(got.collect()) == shown(cur.fetchall())


def test_nothing_and_other_lengths(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    rows = made(20)[:20] + [(1000, [0.5] * 8, 1), (1001, [], 9)]
    got = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 22 and got[1000]["code"] is None and got[1001]["error"] is None and got[1001]["label_error"] is None
    assert shown(r for i, r in got.items() if i < 1000) == shown(brute(rows[:20]))
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.1] * 12, 1)], schema))


def test_search_is_exact_and_lowest_index_wins():
    draw = np.random.default_rng(1)
    for size in (1, 3, 8):
        for _ in range(40):
            book, rows = draw.integers(-3, 4, (16, size)), draw.integers(-4, 5, (50, size))
            found, far = vector_codes.nearest(rows, book)
            every = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
            assert (found == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
