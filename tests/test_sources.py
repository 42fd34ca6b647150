"""Files in, rows out: every log format from hand-written fixtures."""

import gzip
import json

from pyspark.sql import functions as F

from vestige.sources import hostlog, lines, sessions, sinks, strace

HOST = [
    '{"event":"_calibration"}',
    '{"event":',
    "",
    '{"event":"execve","pid":5,"tid":5,"ts_ns":10,"comm":"sh","cgroup_id":1,"args":{"path":"/usr/bin/claude","argv":["/usr/bin/claude","-p","hi"]}}',
    '{"event":"openat","pid":5,"ts_ns":20,"path":"/tmp/flat","flags":66}',
    '{"event":"openat","pid":6,"ts_ns":30,"args":{"path":"/tmp/n","flags":3}}',
    '{"event":"exit_group","pid":6,"ts_ns":40}',
    '{"event":"openat","pid":7,"ts_ns":50,"comm":"runc:[2:INIT]","path":"/r"}',
    '{"event":"connect","pid":7,"ts_ns":60,"family":2,"fd":0}',
]

STRACE = """101 1700000000.000001 execve("/usr/bin/ls", ["ls", "-la"], 0x7f /* 3 vars */) = 0
101 1700000000.000002 openat(AT_FDCWD, "/tmp/a", O_RDWR|O_CREAT <unfinished ...>
102 1700000000.000003 clone(child_stack=NULL) = 103
101 1700000000.000004 <... openat resumed>) = 3
101 1700000000.000005 connect(4, {sa_family=AF_INET, sin_port=htons(80)}, 16) = -1 EINPROGRESS
101 1700000000.000006 --- SIGCHLD {si_signo=SIGCHLD} ---
101 1700000000.000007 +++ exited with 0 +++
104 1700000000.000008 read(3 <unfinished ...>
104 1700000000.000009 openat(AT_FDCWD, "/b\\"c\\303", O_RDONLY <unfinished ...>
104 1700000000.000010 <... read resumed>"", 1) = 0
104 1700000000.000011 <... openat resumed>) = 7
104 1700000000.000012 <... openat resumed>) = 8
105 1700000000.000013 <... close resumed>) = 0
"""


def capture(tmp_path):
    d = tmp_path / "cap" / "s1"
    d.mkdir(parents=True)
    (d / "l3.jsonl").write_text("\n".join(HOST) + "\n")
    (d / "l2ext.jsonl").write_text(HOST[3] + "\n")
    (d / "x.strace.log").write_text(STRACE)
    (d / "session.json").write_text(json.dumps({"session_id": "S1", "mcp": "g/git", "prompt": "do", "session_sentinels": {"token": "tk"}}, indent=1))
    (d / "stream.jsonl").write_text("\n".join([
        '{"type":"assistant","session_id":"late","message":{"content":"plain text"}}',
        '{"type":"system","subtype":"init","session_id":"A1","tools":["Bash","mcp__git__log"]}', "not json",
        '{"type":"assistant","timestamp":"2024-01-01T00:00:10Z","message":{"content":[{"type":"tool_use","id":"u1","name":"Bash","input":{"a":1}}]}}',
        '{"type":"user","timestamp":"2024-01-01T00:00:12.5Z","message":{"content":[{"type":"tool_result","tool_use_id":"u1","is_error":true}]}}',
    ]))
    return str(tmp_path / "cap")


def test_host_json_file(spark, tmp_path):
    got = hostlog.read_host_json(spark, capture(tmp_path) + "/s1/l3.jsonl").orderBy("ts_ns").collect()
    assert [r.event for r in got] == ["execve", "openat", "openat", "exit_group", "openat", "connect"]
    assert got[0].argv[1] == "-p" and got[0].trace_id == "s1"
    assert (got[1].path, got[1].flags, got[1].write_intent) == ("/tmp/flat", 66, True)
    assert (got[2].path, got[2].write_intent) == ("/tmp/n", False)
    kept = hostlog.policy_events(hostlog.read_host_json(spark, capture(tmp_path / "b") + "/s1/l3.jsonl")).collect()
    assert sorted(r.event for r in kept) == ["connect", "execve", "openat", "openat"]


def test_corpus_bundle(spark, tmp_path):
    c = sessions.Corpus(spark, capture(tmp_path))
    b = c.bundle()
    assert b["meta"].first().session_sentinels.token == "tk" and b["meta"].first().session_dir == "s1"
    assert b["l3"].count() == 6 and b["l2ext"].count() == 1
    orc = {r.syscall: r for r in b["oracle"].filter("pid <> 104").collect()}
    assert orc["openat"].ret == "?" and orc["clone"].ret == "103" and orc["execve"].ts_ns == 1700000000000001000
    assert set(c.bare_host()) == {"meta", "l3", "transcript"} and c.meta(limit=1).count() == 1
    t = b["transcript"]
    assert t.count() == 4
    assert sessions.agent_session_ids(t, ["session_dir"]).first().agent_session_id == "A1"


def test_strace_pairing(spark, tmp_path):
    raw = lines.read_lines(spark, capture(tmp_path), "*.strace.log").withColumn("trace_id", F.lit("t"))
    got = {(r.pid, r.event, r.seq): r for r in strace.parse_paired(raw, ["trace_id"]).collect()}
    by = {(p, e): r for (p, e, _), r in got.items()}
    assert len(got) == 5
    opened = by[101, "openat"]
    assert (opened.path, opened.write_intent, opened.ret, opened.ts_ns) == ("/tmp/a", True, 3, 1700000000000002000)
    assert by[101, "execve"].argv == ["ls", "-la"] and by[101, "connect"].family == 2 and by[101, "connect"].ret is None
    # The read's end names another call than the latest start; the openat's first end counts once.
    assert by[104, "openat"].ret == 7 and by[104, "openat"].path == '/b"c\xc3'
    assert (104, "read") not in by


def test_wildcard_trace_and_names(spark, tmp_path):
    text = "BOOT|at nsecs=77\nT|10|257|5|5|py|thon\nT|11|999|5|6|sh\nF|12|5|6|child\nT|x|1|1|1|bad\n"
    with gzip.open(tmp_path / "h.trace.gz", "wt") as f:
        f.write(text)
    (tmp_path / "unistd.h").write_text("#define __NR_openat 257\n#define __NR_read 0\n#define OTHER 1\n")
    raw = lines.read_lines(spark, str(tmp_path), "*.gz").withColumn("trace_id", F.lit("t"))
    w = hostlog.parse_wildcard(raw)
    named = hostlog.name_calls(w.filter("kind = 'syscall'"), hostlog.read_call_names(spark, str(tmp_path / "unistd.h")))
    assert sorted((r.syscall, r.comm) for r in named.collect()) == [("openat", "py|thon"), ("sc_999", "sh")]
    fork = w.filter("kind = 'fork'").first()
    assert (fork.parent, fork.child, fork.comm) == (5, 6, "child")
    assert hostlog.boot_offset(raw, ["trace_id"]).first().boot_ns == 77


def test_line_numbers_grow_across_splits(spark, tmp_path):
    rows = [f"{i:06d} some text" for i in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = [r.value for r in lines.read_lines(spark, str(tmp_path / "big.txt")).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == rows


def test_hooks_file_and_signatures(spark, tmp_path):
    (tmp_path / "a.events.jsonl").write_text(
        '{"ts":1700000000.123456,"hook":"preToolUse","session_id":"s","tool_use_id":"u","tool_name":"Bash"}\nbroken\n'
    )
    h = sessions.read_hooks(spark, str(tmp_path)).collect()
    assert len(h) == 1 and h[0].hook == "PreToolUse" and h[0].ts_ns == 1700000000123456000
    sig = spark.createDataFrame([
        ("a", '[{"kind":"l1_syscall","syscall":"openat","path_contains":"x"},{"kind":"app"}]'),
        ("b", '{"any":[{"all":[{"not":{"kind":"l1_syscall","syscall":"execve"}}]}],"all":[{"kind":"l1_syscall","syscall":"connect"}]}'),
    ], "k string, predicates string")
    got = sorted((r.k, r.syscall, r.negated) for r in sessions.signature_predicates(sig, "k").collect())
    assert got == [("a", "openat", False), ("b", "connect", False), ("b", "execve", True)]


def test_sinks_round_trip(spark, tmp_path):
    from vestige.plans import analyst, graph_tables

    h = hostlog.read_host_json(spark, capture(tmp_path) + "/s1/l3.jsonl")
    t = graph_tables.build(h)
    sinks.write_graph(t, str(tmp_path / "g"))
    back = sinks.read_graph(spark, str(tmp_path / "g"), {n: d.schema for n, d in t.items()})
    assert analyst.session_overview(back).first().n_descendants == 1
    assert [r.path for r in back["write"].orderBy("ts_ns").collect()] == ["/tmp/flat", "/tmp/n"]
    sinks.register_views({"ProcessTable": back["Process"]})
    assert spark.sql("SELECT count(*) AS n FROM ProcessTable").first().n == 3
    sinks.write_rows(analyst.orphan_processes(back), str(tmp_path / "rows"))
    assert sorted(r.pid for r in spark.read.json(str(tmp_path / "rows")).collect()) == [6, 7]
