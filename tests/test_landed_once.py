"""What the graph tables read several times is made once, and lookups that cannot find anything are not made."""

import random

import model
from test_core import frame

from vestige.operators import binding, detect
from vestige.plans import graph_tables


def test_sent_frames_are_attributed_once(spark, monkeypatch):
    seen, plain = [], binding.attribute

    def counted(*args):
        seen.append(1)
        return plain(*args)

    monkeypatch.setattr(binding, "attribute", counted)
    df = frame(spark, model.random_trace(random.Random(5), 60, trace="t"))
    tables = graph_tables.build(df)
    assert len(seen) == 1
    states = binding.bind(df)
    want = binding.servers(states, df).select("mcp_id", "promoted_by").collect()
    assert sorted(map(tuple, tables["MCP"].select("mcp_id", "promoted_by").collect())) == sorted(map(tuple, want))


def test_only_registered_keys_are_looked_up(spark, monkeypatch):
    asked, plain = [], detect.asof

    def counted(left, right, *args, **options):
        asked.append(left.count())
        return plain(left, right, *args, **options)

    monkeypatch.setattr(detect, "asof", counted)
    add = ["claude", "mcp", "add", "fs", "--", "env", "K=V", "fs-tool", "--root"]
    rows = [("t", 0, 0, None, add), ("t", 1, 1, "/opt/fs-tool", ["/opt/fs-tool", "--root"]), ("t", 2, 2, None, None)]
    rows += [("t", i, i, None, ["ls", None, "add"]) for i in range(3, 40)]
    df = spark.createDataFrame(rows, "trace_id string, seq bigint, ts_ns bigint, path string, argv array<string>")
    got = {r.seq: (r.server_label, r.server_layer) for r in detect.layered_servers(df).collect()}
    assert got == {1: ("fs", "registered"), **{i: (None, "") for i in (0, *range(2, 40))}}
    assert sum(asked) == 2  # fs-tool by its argument and by its name; ls is not registered
