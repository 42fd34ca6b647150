"""Pattern dialects, argv words, decisions and whole evaluations."""

import fnmatch
import itertools
import random

from pyspark.sql import functions as F

from vestige.functions import globs, naming, tokens
from vestige.operators import policy
from vestige.plans import audit, evaluation
from vestige.sources.sessions import compile_envelopes, parse_envelopes


def walk_glob(pattern, text):
    """The supervisor's matcher, restated: leftmost segments, a final single star stops at
    a slash and is not reconsidered."""
    def at(p, t):
        if not p:
            return not t
        if p[0] == "*":
            rest = p.lstrip("*")
            single = not p.startswith("**")
            if not rest:
                return ("/" not in t) if single and t else True
            for i in range(len(t) + 1):
                r = at(rest, t[i:])
                if r is not False:
                    return r
                if seg(rest, t[i:]):
                    return False
            return False
        if not t:
            return False
        if p[0] == "?" and t[0] != "/":
            return at(p[1:], t[1:])
        return at(p[1:], t[1:]) if p[0] == t[0] else False

    def seg(p, t):
        """Does the literal head of ``p`` (up to its next star) fit here and end at a star?"""
        head = p.split("*", 1)[0]
        if "*" not in p or len(head) > len(t):
            return False
        return all(a == b or (a == "?" and b != "/") for a, b in zip(head, t))

    return at(pattern, text)


def test_shell_globs_equal_fnmatch(spark):
    pats = ["/tmp/*", "/tmp/**", "*.log", "a?c", "/x[abc]/*", "/x[!a]y", "[", "a[b", "/d/{x}+(1).$", "*.example.com", "[]a]", "/p/[0-9]*", "a[b[c]d", "x&y~#"]
    texts = ["/tmp/a/b", "/tmp/", "q.log", "abc", "/xa/1", "/xby", "/xay", "[", "a[b", "/d/{x}+(1).$", "m.example.com", "]", "a", "/p/7z", "abd", "a[d", "x&y~#", "line\nbreak.log"]
    df = spark.createDataFrame(list(itertools.product(pats, texts)), "p string, t string")
    got = df.select("p", "t", globs.matches(F.col("t"), globs.compile_list(F.array("p"))).alias("m")).collect()
    for r in got:
        assert r.m == fnmatch.fnmatchcase(r.t, r.p.replace("**", "*")), (r.p, r.t)


def test_supervisor_globs(spark):
    rng = random.Random(3)
    pats = ["/tmp/*", "/tmp/**", "/home/*/x", "/home/**/x*", "a?c", "/t/*x", "*", "**", "/a*b*"] + ["".join(rng.choice("ab/*?") for _ in range(5)) for _ in range(60)]
    texts = ["/tmp/a", "/tmp/a/b", "/home/u/x", "/home/u/v/x", "a/c", "abc", "/t/a/x", "/t/ax", "", "/tmp/", "/axb/c", "/axbc"] + ["".join(rng.choice("ab/") for _ in range(5)) for _ in range(60)]
    df = spark.createDataFrame(list(itertools.product(pats, texts)), "p string, t string")
    got = df.select("p", "t", F.rlike("t", globs.compile_list(F.array("p"), "supervisor")).alias("m")).collect()
    assert {(r.p, r.t) for r in got if r.m != walk_glob(r.p, r.t)} == set()


def test_argv_words(spark):
    argv = ["bash", "-c", "ls '/home/u/.aws/creds file' && curl https://a.example.com:8443/x b.example.org; cat ../n", "10.0.0.1,", "300.1.1.1", "foo/bar", "u@h/x", "v1.2"]
    df = spark.createDataFrame([(argv,), (["ls", "-la"],), (None,)], "argv array<string>")
    out = df.select(tokens.leaves(F.col("argv")).alias("w")).select(tokens.path_tokens(F.col("w")).alias("p"), tokens.host_tokens(F.col("w")).alias("h")).collect()
    assert out[0].p == ["../n", "foo/bar"]
    assert out[0].h == ["a.example.com", "b.example.org", "10.0.0.1", "v1.2"]
    assert out[1].p == [] and out[2].h == []


def envelopes(spark):
    docs = [
        ("k1", '{"envelope":{"file_ops":{"read_paths":["/home/**"],"write_paths":["/tmp/mcp-x-*","/tmp/.ok"]},"network":{"allow_hosts":["*.example.com"],"allow_egress":true},"process":{"allow_spawn":true,"allow_binaries":["ls","/bin/cat"]}}}'),
        ("k2", '{"file_ops":{"read_paths":[]}}'), ("k3", '{"_error":"timeout"}'), ("k4", "{}"),
    ]
    return parse_envelopes(spark.createDataFrame(docs, "k string, value string"))


def test_envelope_documents_and_decisions(spark):
    env = envelopes(spark)
    assert sorted(r.k for r in env.select("k").collect()) == ["k1", "k2"]
    ev = [
        (1, "openat", "/home/u/a", None, False), (2, "openat", "/tmp/mcp-x-1/a", None, True), (3, "openat", "/tmp/.hid", None, True),
        (4, "openat", "/tmp/.ok", None, True), (5, "execve", "/usr/bin/ls", ["ls", "/home/u"], None), (6, "execve", "/bin/cat", ["cat", "/etc/shadow"], None),
        (7, "execve", "/bin/cat", ["cat", "evil.org"], None), (8, "execve", "/bin/rm", ["rm"], None), (9, "connect", None, None, None), (10, "openat", "/etc/x", None, False), (11, "stat", "/a", None, None),
    ]
    e = spark.createDataFrame([("k1", "t", i, i, n, p, a, w) for i, n, p, a, w in ev], "k string, trace_id string, seq int, ts_ns bigint, event string, path string, argv array<string>, write_intent boolean").join(env, "k")
    def reasons(mode, **kw):
        return {r.seq: r.reason for r in policy.decide(e, mode, **kw).collect()}
    v1, v2, v6 = reasons("v1"), reasons("v2"), reasons("v6a", noise_floor=True)
    assert v1[1] == "read_ok" and v1[2] == "write_ok" and v1[3] == "write_out_of_envelope" and v1[8] == "execve_binary_not_allowed" and v1[11] == "unknown_event_stat_pass"
    assert v2[3] == "write_denied_dotfile_in_scratch" and v2[4] == "write_ok_explicit_dotfile"
    assert v6[5] == "execve_ok" and v6[6] == "execve_argv_path_out_of_envelope:/etc/shadow" and v6[7] == "execve_argv_host_out_of_envelope:evil.org" and v6[10] == "noise_floor_read"
    assert reasons("v3") == v1


def test_full_evaluation(spark):
    calls = [
        ("b", 1, 5, "execve", "/usr/local/bin/srv", ["srv"], None, None), ("b", 2, 5, "clone", None, None, None, 6), ("b", 3, 6, "openat", "/home/u", None, False, 3),
        ("b", 4, 9, "openat", "/out", None, True, 3), ("m", 1, 5, "execve", "/usr/local/bin/srv", ["srv"], None, None), ("m", 2, 5, "openat", "/tmp/evil-1", None, True, 3),
        ("m", 3, 5, "openat", "/tmp/mcp-x-evil", None, True, 3), ("m", 4, 8, "openat", "/tmp/evil-2", None, True, 3),
    ]
    c = spark.createDataFrame([(t, s, s * 10, p, e, path, argv, w, r) for t, s, p, e, path, argv, w, r in calls],
                              "trace_id string, seq bigint, ts_ns bigint, pid bigint, event string, path string, argv array<string>, write_intent boolean, ret bigint")
    pairs = spark.createDataFrame([("g", "k1", "b", "m", False), ("g", "none", "b", "m", False)], "mcp string, prompt string, benign_session_id string, malicious_session_id string, is_ace_bi boolean")
    env = envelopes(spark).withColumnRenamed("k", "prompt").withColumn("mcp", F.lit("g"))
    leaves = spark.createDataFrame([("m", [0], "openat", "evil", None, False)], "trace_id string, place array<int>, syscall string, path_contains string, path_starts_with string, negated boolean")
    out = {r.prompt: r for r in evaluation.evaluate(pairs, c, env, evaluation.signature_as_predicates(leaves, "trace_id"), mode="full").collect()}
    r = out["k1"]
    assert (r.total, r.inside) == (2, 1) and (r.n_sig_matches, r.n_rejected, r.first_hit_rejected) == (2, 1, True)
    assert out["none"].total is None and out["none"].n_sig_matches == 0


def test_sentinels_and_baselines(spark):
    s = spark.createDataFrame([("s1", "g/git", ("tk", None, "/w/x.txt", "/c/id_rsa", "h", None))],
                              "k string, mcp string, session_sentinels struct<token:string,url_token:string,write_path:string,cred_path:string,exfil_host:string,exfil_ip:string>")
    preds = policy.sentinel_predicates(s, "k").orderBy("place").collect()
    assert [p.role for p in preds] == ["write_path_open", "write_path_unlink", "write_path_in_argv", "cred_path_open", "cred_path_in_argv", "token_tmp_write", "token_tmp_exec_path", "token_tmp_in_argv"]
    moved = policy.reposition_sentinels(s).first().session_sentinels
    # 't' + 'k' = 223, 223 mod 15 = 13: excel.
    assert moved.write_path == "/tmp/mcp-excel-tk/x.txt" and moved.cred_path == naming.PLAUSIBLE_CRED and moved.exfil_ip is None
    keys = spark.createDataFrame([(f"k{i}",) for i in range(30)], "key string").withColumn("p", F.col("key"))
    mis = policy.misaligned(keys, "key").collect()
    assert len(mis) == 30 and all(r.key != r.donor and r.p == r.donor for r in mis) and len({r.donor for r in mis}) == 30
    null = compile_envelopes(policy.null_policies(keys.limit(1))).first()
    assert null.allow_spawn and "/tmp/mcp-*" in null.write_paths


def test_jaccard_and_leakage_against_brute_force(spark):
    rng = random.Random(2)
    sets = {f"k{i}": {f"i{rng.randrange(12)}" for _ in range(5)} for i in range(15)}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, v string")
    for r in audit.neighbour_jaccard(df, "k", "v").collect():
        a, b = sets[r.k], sets[r.other]
        assert abs(r.jaccard - len(a & b) / len(a | b)) < 1e-12
    pats = [("p1", "/tmp/.audit_77"), ("p2", "x"), ("p3", "/creds-abc/def")]
    needles = ["audit_7", "creds-abc/def", "x", "zzz", "def"]
    got = {(r.k, r.needle) for r in audit.leakage(spark.createDataFrame(pats, "k string, pattern string"), spark.createDataFrame([(n,) for n in needles], "needle string"), "k").collect()}
    assert got == {(k, n) for k, p in pats for n in needles if n in p}


def test_model_answers(spark):
    texts = ['{"a":1}', "<think>{no}</think>```json\n{\"a\":2}\n```", "so: {\"a\":{\"b\":3}} ok", "<think>{open", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.j for r in df.orderBy("i").select(naming.policy_json(F.col("t")).alias("j")).collect()]
    assert got == ['{"a":1}', '{"a":2}', '{"a":{"b":3}}', None, None]


def test_shell_words_equal_shlex(spark):
    import shlex

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab /'\"\\ ;") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += ["bash -c \"sh -c 'ls /x; cat /y'\"", "a 'b c' \"d\\\"e\" f\\ g"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tokens.shell_words(F.col("t")).alias("w")).collect():
        try:
            want = shlex.split(r.t, posix=True)
        except ValueError:
            want = r.t.split()
        assert [x for x in r.w if x] == [x for x in want if x], r.t
    nested = spark.createDataFrame([(["bash", "-c", "sh -c \"sh -c 'ls /x/1; cat /y/2'\" && true"],)], "a array<string>")
    got = nested.select(tokens.path_tokens(tokens.leaves(F.col("a"))).alias("p")).first().p
    assert got == ["/x/1;", "/y/2"]
