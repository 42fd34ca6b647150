"""Agent layer, ingest, graph questions, labels, subtrees, streams."""

import json
import random

import model
from test_core import frame

from vestige.operators import binding, callwindows, detect, subtree
from vestige.plans import agent_layer, analyst, corpora, fidelity, graph_tables, scoring
from vestige.sources.sessions import clean_hooks, parse_transcript

ISO = "2024-01-01T00:00:%02dZ"
T0 = 1704067200 * 10**9


def transcript(spark, rows):
    return parse_transcript(spark.createDataFrame([(s, i, v) for s, i, v in rows], "session_dir string, seq bigint, value string"))


def use(sec, i, name="Bash", **kw):
    return json.dumps({"type": "assistant", "session_id": "s", "timestamp": ISO % sec, "message": {"content": [{"type": "tool_use", "id": i, "name": name}]}, **kw})


def result(sec, i, err=False):
    return json.dumps({"type": "user", "session_id": "s", "timestamp": ISO % sec, "message": {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": err}]}})


def test_transcript_layer(spark):
    t = transcript(spark, [
        ("s", 0, json.dumps({"type": "system", "subtype": "init", "session_id": "s", "tools": ["Bash", "mcp__git__log"]})),
        ("s", 1, use(10, "u1")), ("s", 2, use(12, "u2", "mcp__git__log", parent_tool_use_id="u1")), ("s", 3, result(15, "u1", True)),
        ("s", 4, result(16, "zz")), ("s", 5, use(20, "u3")), ("s", 6, json.dumps({"type": "result", "session_id": "s", "result": "done", "terminal_reason": "completed", "stop_reason": "end"})),
    ])
    s = spark.createDataFrame([("s", "ask", T0, T0 + 60 * 10**9), ("gone", "p", 0, 9)], "session_id string, prompt string, t_start_ns bigint, t_end_ns bigint")
    a = agent_layer.extract(s, t)
    calls = {r.tool_call_id: r for r in a["ToolCall"].collect()}
    assert (calls["u1"].t_open_ns, calls["u1"].t_close_ns, calls["u1"].is_error) == (T0 + 10 * 10**9, T0 + 15 * 10**9, True)
    assert calls["u2"].mcp_id == "mcp/s/git" and calls["u2"].t_close_ns == T0 + 60 * 10**9 and calls["u2"].is_error
    assert calls["u2"].parent_tool_use_id == "u1" and calls["u1"].kernel_timing == "approximate"
    ends = {r.session_id: (r.terminator_status, r.terminator_reason) for r in a["Session"].collect()}
    assert ends == {"s": ("clean", "end"), "gone": ("crash", "no result record")}
    assert {r.outcome for r in a["Iteration"].collect()} == {"responded", "terminated"}
    content = callwindows.content_rows(t, ["session_dir"])
    loose = {r.use_id: (r.lo, r.hi) for r in callwindows.loose_windows(content, ["session_dir"]).collect()}
    assert loose == {"u1": (T0 + 5 * 10**9, T0 + 15 * 10**9)}
    assert agent_layer.advertised_tools(t, server_only=True).first().name == "mcp__git__log"


def test_hook_layer_and_modes(spark):
    rows = [
        (1.0, "UserPromptSubmit", "s", "", "", "said", False), (2.0, "preToolUse", "s", "u1", "mcp__git__log", None, False), (3.5, "PostToolUse", "s", "u1", "", None, True),
        (4.0, "PreToolUse", "s", "u2", "Bash", None, False), (5.0, "PostToolUse", "s", "u9", "Bash", None, False), (6.0, "Stop", "s", "", "", None, False),
    ]
    h = clean_hooks(spark.createDataFrame([(*r, "") for r in rows], "ts double, hook string, session_id string, tool_use_id string, tool_name string, prompt string, is_error boolean, parent_tool_use_id string"))
    t = transcript(spark, [("s", 0, '{"type":"x","session_id":"s"}'), ("o", 0, '{"type":"x","session_id":"o"}')])
    s = spark.createDataFrame([("s", "meta", 0, 10**10), ("o", "meta", 0, 10**10)], "session_id string, prompt string, t_start_ns bigint, t_end_ns bigint")
    a = agent_layer.extract(s, t, h, mode="auto")
    calls = {r.tool_call_id: (r.t_open_ns, r.t_close_ns, r.is_error) for r in a["ToolCall"].collect()}
    assert calls == {"u1": (2 * 10**9, 3_500_000_000, True), "u2": (4 * 10**9, 10**10, True)}
    assert {r.session_id: r.text for r in a["Prompt"].collect()} == {"s": "said", "o": "meta"}
    assert {r.session_id: r.terminator_status for r in a["Session"].collect()} == {"s": "clean", "o": "crash"}
    tight = callwindows.tight_windows(h, ["session_id"])
    assert [(r.use_id, r.lo) for r in tight.collect()] == [("u1", 2 * 10**9)]
    orphans = callwindows.orphan_starts(h, ["session_id"])
    assert [r.use_id for r in orphans.collect()] == ["u2"]
    loose = spark.createDataFrame([("s", "u1", 0, 1), ("o", "x", 0, 1)], "session_id string, use_id string, lo bigint, hi bigint")
    chosen = callwindows.choose_windows(tight, loose, ["session_id"])
    assert sorted((r.session_id, r.source) for r in chosen.collect()) == [("o", "stream"), ("s", "hooks")]
    pred = a["ToolCall"].filter("tool_call_id = 'u1'").select("session_id", "tool_call_id", "t_open_ns", "t_close_ns")
    row = scoring.call_totals(scoring.per_call(tight, orphans, pred, ["session_id"]), ["session_id"]).first()
    assert (row.n_truth, row.n_matched, row.n_missed, row.n_covers, row.identification) == (2, 1, 1, 1, 0.5)


def events(spark):
    rows = [
        dict(pid=1, event="execve", path="/c/claude", argv=["claude", "-p", "x"]), dict(pid=1, event="sched_fork", parent_pid=1, child_pid=2, parent_comm="c"),
        dict(pid=2, event="execve", path="/m", argv=["/b/git-mcp", "x"]), dict(pid=2, event="openat", path="/home/u/.ssh/id_rsa", flags=0),
        dict(pid=2, event="connect", family=2, daddr="9.9.9.9", dport=443), dict(pid=2, event="connect", family=1, daddr="x"), dict(pid=1, event="openat", path="/w", flags=3), dict(pid=8, event="openat", path="/w", flags=0),
    ]
    return frame(spark, [dict(r, trace_id="t", seq=i, ts_ns=T0 + (i + 1) * 10**9, tid=r["pid"], comm="c") for i, r in enumerate(rows)])


def test_graph_and_ingest(spark):
    kernel = graph_tables.build(events(spark))
    t = transcript(spark, [
        ("s", 0, json.dumps({"type": "system", "subtype": "init", "session_id": "s", "tools": ["Bash", "mcp__git__log"]})),
        ("s", 1, use(3, "u1", "mcp__git__log")), ("s", 2, result(6, "u1")), ("s", 3, use(6, "u2")), ("s", 4, result(8, "u2")),
    ])
    s = spark.createDataFrame([("s", "read my ssh key", T0, T0 + 60 * 10**9)], "session_id string, prompt string, t_start_ns bigint, t_end_ns bigint")
    place = spark.createDataFrame([("s", "t", "sess_0")], "session_id string, trace_id string, graph_session string")
    g = agent_layer.ingest(kernel, agent_layer.extract(s, t), place)
    calls = {r.tool_call_id: r for r in g["ToolCall"].collect()}
    assert calls["u1"].mcp_id == "mcp_0_git-mcp" and g["handled_by"].first().mcp_id == "mcp_0_git-mcp"
    assert [(r.call, r.next) for r in g["next_call"].collect()] == [("u1", "u2")] and g["first_call"].first().tool_call_id == "u1"
    assert g["exposes"].first().tool_key == "s/mcp__git__log" and g["Session"].first().terminator_status == "crash"
    assert {(r.kind, r.target) for r in analyst.touch_set(g).collect()} == {("file", "/home/u/.ssh/id_rsa"), ("socket", "2:9.9.9.9:443")}
    assert [(r.op, r.target, r.mcp_id) for r in analyst.credential_forward(g).collect()] == [("connect", "2:9.9.9.9:443", "mcp_0_git-mcp")]
    act = {r.tool_call: (r.dur_ms, r.n_file_ops, r.n_socket_ops) for r in analyst.call_activity(g).collect()}
    assert act["u1"] == (3000, 1, 1)
    assert [r.tool_call for r in analyst.network_calls(g).collect()] == ["u1"]
    assert [r.pid for r in analyst.orphan_processes(g).collect()] == [8]
    assert analyst.intent_and_read(g, "ssh", "id_rsa").count() == 1
    assert {r.tool_call_id for r in analyst.precise_calls(g).collect()} == {"u1"}
    assert analyst.session_subgraph(g, "t", "sess_0").count() == 5
    assert {(r.tool_call_id, r.session_id) for r in analyst.call_list(g).collect()} == {("u1", "sess_0"), ("u2", "sess_0")}
    assert analyst.bindings(g).count() == 3
    assert {(r.pid, r.t_first_seen_ns) for r in g["Process"].collect()} >= {(2, T0 + 2 * 10**9)}


def test_labels_merges_and_trials(spark):
    e = events(spark)
    meta = spark.createDataFrame([("t", "S", "g/git")], "trace_id string, session_id string, mcp string")
    w = spark.createDataFrame([("t", "u1", T0 + 3 * 10**9, T0 + 6 * 10**9, "m"), ("t", "u2", T0 + 6 * 10**9, T0 + 8 * 10**9, "")], "trace_id string, use_id string, lo bigint, hi bigint, mcp_id string")
    lab = {r.seq: (r.src_session, r.src_mcp, r.src_tool_call) for r in corpora.label(e, meta, w).collect()}
    assert lab[3] == ("S", "g/git", "u1") and lab[6] == ("S", "", "") and lab[7] == ("", "", "")
    hook = {r.seq: r.src_tool_call for r in corpora.label(e, meta, w, scope="hooks").collect()}
    assert hook[3] == "u1" and hook[6] == "u2" and hook[0] == ""
    trial = spark.createDataFrame([(0, "t")], "trial int, trace_id string")
    merged = corpora.merge(corpora.label(e, meta, w), trial)
    score = {r.level: r for r in scoring.run_trials(merged, detector="layered").collect()}
    assert score["session"].f1 == 1.0 and score["mcp"].recall > 0
    both = scoring.run_trials_with_cohesion(merged)
    assert both.count() == 6
    moved, shifted = corpora.rebase(e, w)
    assert moved.agg({"ts_ns": "min"}).first()[0] == 0 and shifted.agg({"lo": "min"}).first()[0] == 2 * 10**9


def test_detector_layers(spark):
    rows = [
        ["claude", "mcp", "add", "fs", "--scope", "local", "--", "env", "K=V", "/o/fs-tool", "--root"], ["fs-tool", "/a/--root"], ["fs-tool"], ["node", "/x/fs-tool"],
        ["chroma-mcp"], ["my.mcp-server"], ["uvx", "mcp_thing"], ["python3", "app.py"], ["claude", "mcp", "add", "x"], ["a-mcp-b"],
    ]
    df = spark.createDataFrame([("t", i, i, r[0], r) for i, r in enumerate(rows)], "trace_id string, seq int, ts_ns bigint, path string, argv array<string>")
    got = {r.seq: (r.server_label, r.server_layer) for r in detect.layered_servers(df).collect()}
    assert got[0] == (None, "") and got[1] == ("fs", "registered") and got[2] == ("fs", "registered") and got[3] == ("fs", "registered")
    assert got[4] == ("chroma-mcp", "broadened") and got[5][1] == "broadened" and got[6] == ("mcp_thing", "broadened") and got[7] == (None, "") and got[9][1] == "broadened"
    off = {r.seq: r.server_layer for r in detect.layered_servers(df, registry=False).collect()}
    assert off[1] == "" and off[4] == "broadened"


def test_subtrees(spark):
    rows = [
        (1, 7, "execve", "/usr/local/bin/claude", ["claude"], None), (2, 7, "clone", None, None, 9), (3, 9, "execve", "/usr/local/bin/srv", ["srv"], None),
        (4, 9, "clone", None, None, 10), (5, 10, "openat", "/x", None, 3), (6, 3, "execve", "/usr/bin/strace", ["/usr/bin/strace"], None), (7, 4, "execve", "/usr/bin/docker-entrypoint.sh", ["sh"], None),
    ]
    c = spark.createDataFrame([("t", *r) for r in rows], "trace_id string, seq bigint, pid bigint, event string, path string, argv array<string>, ret bigint")
    assert sorted(r.pid for r in subtree.fork_subtree(c, ["trace_id"]).collect()) == [9, 10]
    assert sorted(r.pid for r in subtree.builtin_subtree(c, ["trace_id"]).collect()) == [7, 9, 10]


def test_process_fidelity(spark):
    e = events(spark).filter("seq <> 2")
    ex = spark.createDataFrame([("t", 101, T0 + 10**9 + 5, 0, "/c/claude", ["claude"]), ("t", 102, T0 + 9 * 10**9, 1, "/m", ["zz"])], "trace_id string, pid bigint, ts_ns bigint, seq bigint, image string, argv array<string>")
    orc = spark.createDataFrame([("t", T0, 0, 101, "clone", "102")], "trace_id string, ts_ns bigint, seq bigint, pid bigint, syscall string, ret string")
    r = fidelity.process_fidelity(orc, ex, e).first()
    assert (r.l1_subprocesses, r.host_subprocesses, r.bridged, r.subprocess_recall) == (2, 1, 1, 0.5)
    assert r.host_saw_claude_root and r.host_pids_total == 3


def test_live_attribution_equals_batch(spark, tmp_path):
    from vestige.streaming.live_attribution import LiveAttribution

    rng = random.Random(11)
    evs = model.random_trace(rng, 40, trace="a") + model.random_trace(rng, 32, trace="b")
    df = frame(spark, evs)
    want = {(r.trace_id, r.seq): (r.session, r.server) for r in binding.attribute(df, binding.bind(df, detector="strict")).collect()}
    order = sorted(evs, key=lambda e: e["ts_ns"] + rng.randrange(0, 400_000_000))
    for i in range(2):
        part = order[i * 36:(i + 1) * 36]
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = LiveAttribution(spark, str(tmp_path / "state"), delay_ns=10**9, detector="strict")
    size = len(order) // 3
    for i in range(3):
        live(frame(spark, order[i * size:(i + 1) * size]), i)
    live(frame(spark, order[2 * size:3 * size]), 2)  # a repeated batch changes nothing
    live.finish(3)
    got = {(r.trace_id, r.seq): (r.session, r.server) for r in live.results().collect()}
    assert got == want
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    again = LiveAttribution(spark, str(tmp_path / "s2"), delay_ns=10**10, detector="strict")
    q = stream.writeStream.foreachBatch(again).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    again.finish(len(q.recentProgress))
    assert {(r.trace_id, r.seq) for r in again.results().collect()} == set(want)


def test_hook_stream_and_rates(spark, tmp_path):
    from vestige.streaming import hooks as hs

    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text("\n".join(json.dumps(x) for x in [
        {"ts": 100.0, "hook": "PreToolUse", "session_id": "s", "tool_use_id": "u", "tool_name": "Bash"}, {"ts": 101.5, "hook": "postToolUse", "session_id": "s", "tool_use_id": "u"},
        {"ts": 102.0, "hook": "PreToolUse", "session_id": "s", "tool_use_id": "v", "tool_name": "Bash"},
    ]))
    q = hs.call_windows(hs.read_hook_stream(spark, str(tmp_path / "h"))).writeStream.format("memory").queryName("calls").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.use_id, r.lo, r.hi) for r in spark.table("calls").collect()] == [("u", 100 * 10**9, 101_500_000_000)]
    df = frame(spark, model.random_trace(random.Random(1), 30))
    df.unionByName(df).write.parquet(str(tmp_path / "e"))
    rates = hs.event_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("rates").collect()) == 30
