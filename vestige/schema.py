"""Read schemas (Spark DDL) of the log formats and the canonical event row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nested host event, one JSON object per line.
HOST_NESTED = """
event STRING, pid BIGINT, tid BIGINT, ts_ns BIGINT, comm STRING, cgroup_id BIGINT,
args STRUCT<path: STRING, argv: ARRAY<STRING>, flags: INT, fd: INT, family: INT, daddr: STRING,
            dport: INT, len: BIGINT, buf_b64: STRING, parent_pid: BIGINT, child_pid: BIGINT,
            parent_comm: STRING>,
path STRING, argv ARRAY<STRING>, flags INT, fd INT, family INT, _corrupt_record STRING
"""

SESSION_META = """
session_id STRING, session_label STRING, mcp STRING, prompt STRING, prompt_slug STRING,
variant STRING, category STRING, threat_model STRING, gold_label STRING, intent_class STRING,
patches_applied ARRAY<STRING>, cgroup_id BIGINT, t_start_unix_ns BIGINT, t_end_unix_ns BIGINT,
duration_ms BIGINT, exit_code INT, l1_strace_path STRING, l3_slice_path STRING,
stream_json_path STRING,
session_sentinels STRUCT<token: STRING, url_token: STRING, write_path: STRING,
                         cred_path: STRING, exfil_host: STRING, exfil_ip: STRING>
"""

TRANSCRIPT = """
type STRING, subtype STRING, session_id STRING, tools ARRAY<STRING>, timestamp STRING,
parent_tool_use_id STRING, message STRING, result STRING, is_error BOOLEAN,
stop_reason STRING, terminal_reason STRING, _corrupt_record STRING
"""

CONTENT_BLOCKS = """
ARRAY<STRUCT<type: STRING, id: STRING, name: STRING, input: STRING, tool_use_id: STRING,
             is_error: BOOLEAN, text: STRING>>
"""

HOOK_EVENT = """
ts DOUBLE, hook STRING, session_id STRING, tool_use_id STRING, parent_tool_use_id STRING,
tool_name STRING, tool_input STRING, is_error BOOLEAN, prompt STRING, stop_hook_active BOOLEAN,
stop_reason STRING, agent_pid BIGINT, cwd STRING, unknown_hook BOOLEAN, _corrupt_record STRING
"""

# Members of a policy document's struct.
ENVELOPE_BODY = """
file_ops: STRUCT<read_paths: ARRAY<STRING>, write_paths: ARRAY<STRING>, delete_paths: ARRAY<STRING>>,
network: STRUCT<allow_egress: BOOLEAN, allow_hosts: ARRAY<STRING>, allow_ports: ARRAY<INT>>,
process: STRUCT<allow_spawn: BOOLEAN, allow_binaries: ARRAY<STRING>>, rationale: STRING
"""

# The one event row all operators read: name -> Spark type.
CANONICAL = {
    "trace_id": "string",
    "seq": "bigint",
    "ts_ns": "bigint",
    "event": "string",
    "pid": "bigint",
    "tid": "bigint",
    "comm": "string",
    "cgroup_id": "bigint",
    "path": "string",
    "argv": "array<string>",
    "flags": "int",
    "write_intent": "boolean",
    "family": "int",
    "daddr": "string",
    "dport": "int",
    "fd": "int",
    "len": "bigint",
    "buf": "string",
    "parent_pid": "bigint",
    "child_pid": "bigint",
    "parent_comm": "string",
}


def canonical(df: DataFrame, **given: Column) -> DataFrame:
    """Project ``df`` to the canonical row; columns it lacks become typed NULLs."""
    kinds = dict(df.dtypes)
    out: list = []
    for name, kind in CANONICAL.items():
        if name in given:
            out.append(given[name].cast(kind).alias(name))
        elif kinds.get(name) == kind:
            out.append(name)
        else:
            source = name if name in kinds else "NULL"
            out.append(F.expr(f"CAST({source} AS {kind}) AS {name}"))
    return df.select(*out)
