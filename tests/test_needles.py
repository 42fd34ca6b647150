"""Many-needle search, line predicates and leaks against plain search."""

import random

from vestige.operators import needles, selection
from vestige.plans import audit


def test_needles_are_found_as_plain_search_finds_them(spark):
    rng = random.Random(7)
    letters = "abé日 /"
    texts = [(g, i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for g in "xy" for i in range(60)] + [("x", 900, None), ("x", 901, "")]
    wanted = [(g, "".join(rng.choice(letters) for _ in range(n))) for g in "xyz" for n in (1, 2, 3, 4, 5, 9) for _ in range(6)] + [("x", ""), ("x", None), ("y", "not in any text")]
    wanted += [(g, t[3:14]) for g, _, t in texts[::7] if t]
    t = spark.createDataFrame(texts, "g string, id int, v string")
    n = spark.createDataFrame(wanted, "g string, needle string")
    got = sorted((r.g, r.id, r.needle) for r in needles.find(t, n, ["g"], "id", "v").collect())
    assert got == sorted({(g, i, w) for g, i, v in texts for h, w in wanted if g == h and w and v and w in v})
    assert needles.find(t, n.limit(0), ["g"], "id", "v").isEmpty()


def test_postings_are_linear_in_the_texts(spark, monkeypatch):
    """One text letter gives one row a length, however many needles there are."""
    seen = []
    monkeypatch.setattr(needles, "settle", lambda df: seen.append(df.cache()) or seen[-1])
    t = spark.createDataFrame([(i, "x" * 500 + str(i)) for i in range(20)], "id int, v string")
    n = spark.createDataFrame([("x" * k + "q",) for k in range(4, 90)] + [("xx",), ("x19",)], "needle string")
    got = {(r.id, r.needle) for r in needles.find(t, n, [], "id", "v").collect()}
    assert got == {(i, "xx") for i in range(20)} | {(19, "x19")}
    assert seen[1].count() <= 20 * 510 * 2


def test_lines_meet_their_predicates(spark):
    lines = spark.createDataFrame([("t", 1, "openat /data/f7"), ("t", 2, "read /data/f7"), ("t", 3, "execve /bin/x"), ("u", 4, "openat /data/f7"), ("u", 5, None)], "g string, seq int, value string")
    p = spark.createDataFrame([("t", "openat", "/data/f7", None), ("t", "execve", None, None), ("u", "connect", None, "/data"), ("u", "openat", None, "")],
                              "g string, syscall string, path_contains string, path_starts_with string")
    assert {r.g: r.n_hits for r in selection.raw_line_hits(lines, p, ["g"]).collect()} == {"t": 2, "u": 1}


def test_leaks(spark):
    p = spark.createDataFrame([(1, "/tmp/secret-a/**"), (2, "/tmp/secret-a/**"), (2, "/etc/x"), (3, "")], "key int, pattern string")
    n = spark.createDataFrame([("secret-a",), ("x",), ("none",), ("",)], "needle string")
    assert {(r.key, r.pattern, r.needle) for r in audit.leakage(p, n, "key").collect()} == {(1, "/tmp/secret-a/**", "secret-a"), (2, "/tmp/secret-a/**", "secret-a"), (2, "/etc/x", "x")}
