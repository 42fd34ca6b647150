"""Runs registered queries and their SQL twins and compares whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(x):
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, int):
        return str(x)
    try:
        return f"{float(x):.9g}" if type(x).__name__ == "Decimal" else str(x)
    except ValueError:
        return str(x)


def norm(x):
    s = cell(x)
    return s[:-2] if s.endswith(".0") else s


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return "rows-only", len(got), took, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return "ok", len(a), took, ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return "DIFF", len(a), took, f"{len(a)} vs {len(b)} spark-only {only_a} sql-only {only_b}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from vestige.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            status, n, took, note = compare(spark, con, sf_dir, name, fn, entry.oracle_sql().get(name))
        except Exception as exc:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0.0, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {name:34} {n:7} rows {took:6.1f}s {note}", flush=True)
    print("bad", bad)
