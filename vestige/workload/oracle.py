"""SQL twins of the views, as common table expressions for a plain SQL engine."""

from __future__ import annotations

EV = """ev AS (
  SELECT 't' || (user_id % 4) AS trace_id, event_id AS seq, epoch_us(ts) - 1704067200000000 AS ts_ns,
         user_id AS pid, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value
  FROM events)"""

HOST = EV + """, host AS (
  SELECT trace_id, seq, ts_ns, pid, pid * 10 + k % 3 AS tid, k,
    CASE event_type
      WHEN 'signup' THEN CASE WHEN k < 70 THEN 'execve' ELSE 'sched_fork' END
      WHEN 'error' THEN CASE WHEN k < 40 THEN 'clone' WHEN k < 60 THEN 'execve' ELSE 'unlinkat' END
      WHEN 'view' THEN 'openat' WHEN 'click' THEN 'openat'
      ELSE CASE WHEN k < 40 THEN 'connect' WHEN k < 70 THEN 'sendto' ELSE 'recvfrom' END END AS event,
    ['node', 'MainThread', 'claude', 'sh', 'libuv-worker'][1 + pid % 5] AS comm,
    CASE WHEN k % 10 <> 0 THEN 100 + pid % 2 END AS cgroup_id,
    CASE event_type
      WHEN 'signup' THEN CASE WHEN k < 20 THEN '/usr/bin/claude' WHEN k < 40 THEN '/usr/local/bin/mcp-server-' || (k % 5)
                              WHEN k < 50 THEN '/usr/bin/node' WHEN k < 60 THEN '/usr/bin/claude' WHEN k < 70 THEN '/opt/fs-tool' END
      WHEN 'error' THEN CASE WHEN k < 40 THEN NULL WHEN k < 60 THEN '/bin/ls' ELSE '/data/p' || (k % 10) || '/x' END
      WHEN 'view' THEN CASE WHEN k < 20 THEN '/etc/p' || k ELSE '/data/p' || (k % 10) || '/f' || k END
      WHEN 'click' THEN CASE WHEN k < 10 THEN '/tmp/.h' || k ELSE '/tmp/mcp-' || (k % 5) || '/f' || k END END AS path,
    CASE WHEN event_type = 'signup' AND k < 20 THEN ['/usr/bin/claude', '-p', 'prompt ' || k]
         WHEN event_type = 'signup' AND k < 40 THEN ['/usr/local/bin/mcp-server-' || (k % 5), '--stdio']
         WHEN event_type = 'signup' AND k < 50 THEN ['node', '/srv/chroma-mcp-server.js']
         WHEN event_type = 'signup' AND k < 60 THEN ['claude', 'mcp', 'add', 'fs' || (k % 5), '--scope', 'local', '--', 'env', 'K=V', 'fs-tool', '--root']
         WHEN event_type = 'signup' AND k < 70 THEN ['/opt/fs-tool', '--root']
         WHEN event_type = 'error' AND k BETWEEN 40 AND 59 THEN ['ls', '-la', '/data/p' || (k % 10), 'api.example.com'] END AS argv,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN [1, 2, 66, 3][1 + k % 4] END AS flags,
    event_type = 'click' AND k % 4 <> 3 AS write_intent,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 9 THEN 1 WHEN k % 2 = 0 THEN 2 ELSE 10 END END AS family,
    CASE WHEN event_type = 'purchase' THEN '10.0.0.' || (k % 8) END AS daddr,
    CASE WHEN event_type = 'purchase' THEN 443 + k % 3 END AS dport,
    CASE WHEN event_type = 'purchase' THEN k % 4 END AS fd,
    CASE WHEN event_type = 'purchase' THEN k * 10 END AS len,
    CASE WHEN event_type = 'signup' AND k >= 70 THEN pid END AS parent_pid,
    CASE WHEN event_type = 'signup' AND k >= 70 THEN pid + 4 * (k % 7) END AS child_pid
  FROM ev)"""

FORKS = HOST + """, forks AS (
  SELECT trace_id, ts_ns, seq, parent_pid AS parent, child_pid AS child FROM host
  WHERE event = 'sched_fork' AND parent_pid <> 0 AND child_pid <> 0 AND parent_pid <> child_pid)"""

WINDOWS = EV + """, win AS (
  SELECT trace_id, pid, seq AS use_id, ts_ns AS lo, coalesce(lead(ts_ns) OVER (PARTITION BY pid ORDER BY ts_ns, seq), -1) AS hi, k
  FROM ev WHERE event_type = 'purchase')"""

SPANS = EV + """, spans AS (
  SELECT trace_id, pid, seq AS use_id, ts_ns AS lo, ts_ns + k * 1000000000 AS hi, k FROM ev WHERE event_type = 'purchase')"""

TREE = """tree AS (SELECT event_id AS child, event_id // 3 AS parent, event_type FROM events WHERE event_id > 0)"""

FILES = HOST + """, files AS (
  SELECT trace_id, pid, path, ts_ns, seq,
    CASE WHEN event = 'unlinkat' THEN 'unlink' WHEN (coalesce(flags, 0) & 3) = 0 THEN 'read' ELSE 'write' END AS op
  FROM host WHERE event IN ('openat', 'unlinkat') AND path <> '')
, socks AS (
  SELECT trace_id, pid, ts_ns, seq, family || ':' || daddr || ':' || dport AS sock_key, daddr, dport, len, fd,
    CASE event WHEN 'connect' THEN 'connect' WHEN 'sendto' THEN 'send' ELSE 'recv' END AS op
  FROM host WHERE event IN ('connect', 'sendto', 'recvfrom') AND family IN (2, 10) AND daddr <> '')"""

SESSIONS = """convo AS (
  SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, 's' || conv_id AS session_id,
         (conv_id * 10000 + 7 * (turn + 1)) * 1000000000 AS at_ns FROM conversations)
, sess AS (
  SELECT 's' || conv_id AS session_id, conv_id, coalesce(arg_min(text, CASE WHEN role = 'user' THEN turn END), '') AS prompt,
         conv_id * 10000000000000 AS t_start_ns, conv_id * 10000000000000 + (max(turn) + 1) * 7000000000 AS t_end_ns
  FROM conversations GROUP BY conv_id)
, uses AS (
  SELECT session_id, conv_id, turn, 'u_' || conv_id || '_' || turn AS use_id, at_ns,
         CASE WHEN turn % 3 = 1 THEN 'mcp__srv' || (conv_id % 5) || '__run' ELSE 'Bash' END AS name
  FROM convo WHERE role = 'assistant')
, results AS (
  SELECT session_id, turn, 'u_' || conv_id || '_' || (turn - 1) AS use_id, at_ns, length(text) % 5 = 0 AS is_error
  FROM convo WHERE role <> 'assistant')"""

HOOKS = EV + """, hooks AS (
  SELECT 'a' || pid AS session_id, ts_ns * 1000 AS ts_ns, seq, k,
    CASE event_type WHEN 'purchase' THEN 'PreToolUse' WHEN 'view' THEN 'PostToolUse' WHEN 'error' THEN 'Stop' ELSE 'UserPromptSubmit' END AS hook,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'h' || k ELSE '' END AS use_id,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'Bash' ELSE 'mcp__srv' || (k % 3) || '__run' END END AS tool_name,
    k % 9 = 0 AS is_error
  FROM ev WHERE event_type <> 'click')
, tight AS (
  SELECT session_id, use_id, max(CASE WHEN hook = 'PreToolUse' THEN ts_ns END) AS lo,
         min(CASE WHEN hook = 'PostToolUse' THEN ts_ns END) AS hi
  FROM hooks WHERE use_id <> '' GROUP BY 1, 2)"""

# Host events with their user's policy, and what the policy's lists say about them.
POLICED = HOST + """, policed AS (
  SELECT h.*, n, m.n_regionkey AS region,
    path LIKE '/data/p' || (n % 10) || '/%' OR (path LIKE '/etc/p' || (n % 10) || '_') AS read_listed,
    path LIKE '/tmp/mcp-' || (n % 5) || '/%' OR path = '/tmp/.h' || (n % 10) AS write_listed,
    n % 2 = 0 AND path LIKE '/data/%' AS delete_listed,
    path = '/tmp/.h' || (n % 10) AS exact_write,
    path LIKE '/data/p' || (n % 10) || '/%' AS any_prefix,
    path IN ('/usr/bin/claude') OR split_part(path, '/', -1) IN ('ls', 'node') AS binary_listed,
    n % 4 <> 0 AS allow_egress, n % 3 <> 0 AS allow_spawn,
    regexp_matches(coalesce(path, ''), '^(/etc/|/usr/|/lib/|/lib64/|/proc/|/sys/|/dev/|/System/|/opt/|/root/|/var/lib/|/run/|/tmp/)') AS noise
  FROM host h JOIN (SELECT CAST(n_nationkey AS BIGINT) AS n, n_regionkey FROM nation) m ON h.pid % 25 = m.n)"""


def v1_reason(noise_floor: bool = False, dotfile: bool = False, argv: bool = False, prefix: str = "unknown_event_") -> str:
    """The decision rule as a CASE over ``policed``."""
    parts = []
    if noise_floor:
        parts.append("WHEN event = 'openat' AND NOT write_intent AND noise THEN 'noise_floor_read'")
    if dotfile:
        parts.append("WHEN event = 'openat' AND write_intent AND path LIKE '/tmp/.h%' AND exact_write THEN 'write_ok_explicit_dotfile'")
        parts.append("WHEN event = 'openat' AND write_intent AND path LIKE '/tmp/.h%' THEN 'write_denied_dotfile_in_scratch'")
    parts += [
        "WHEN event = 'openat' AND write_intent THEN CASE WHEN write_listed THEN 'write_ok' ELSE 'write_out_of_envelope' END",
        "WHEN event = 'openat' THEN CASE WHEN read_listed THEN 'read_ok' ELSE 'read_out_of_envelope' END",
        "WHEN event = 'unlinkat' THEN CASE WHEN delete_listed THEN 'unlink_ok' ELSE 'unlink_out_of_envelope' END",
        "WHEN event = 'execve' AND NOT allow_spawn THEN 'execve_denied_no_spawn'",
        "WHEN event = 'execve' AND NOT binary_listed THEN 'execve_binary_not_allowed'",
    ]
    if argv:
        parts += [
            "WHEN event = 'execve' AND argv[1] = 'ls' AND NOT (n % 2 = 0 OR false) THEN 'execve_argv_path_out_of_envelope:' || argv[3]",
            "WHEN event = 'execve' AND argv[1] = 'node' THEN 'execve_argv_path_out_of_envelope:' || argv[2]",
            "WHEN event = 'execve' AND argv[1] = 'claude' THEN 'execve_ok'",
        ]
    parts += [
        "WHEN event = 'execve' THEN 'execve_ok'",
        "WHEN event IN ('connect', 'sendto') AND NOT allow_egress THEN event || '_denied_no_egress'",
        "WHEN event IN ('connect', 'sendto') THEN event || '_ok_egress_allowed'",
        f"ELSE '{prefix}' || event || '_pass'",
    ]
    return "CASE " + " ".join(parts) + " END"


OK_REASON = "(reason LIKE '%\\_ok%' ESCAPE '\\' OR reason LIKE '%\\_pass' ESCAPE '\\' OR reason = 'noise_floor_read')"


def with_views(views: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}\n{body}"


# The binding rule as one ordered walk: what every operation finds and leaves, a map from pid
# to session and server carried from operation to operation of a trace.
STATES = FORKS + """, first_fork AS (SELECT trace_id, child, min((ts_ns, seq)) AS at FROM forks GROUP BY 1, 2)
, near AS (SELECT *, last_value(CASE WHEN event = 'clone' THEN {'pid': pid, 'ts': ts_ns, 'cg': cgroup_id} END IGNORE NULLS)
     OVER (PARTITION BY trace_id ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl FROM host)
, reg AS (SELECT trace_id, ts_ns, seq, argv[4] AS name FROM host WHERE event = 'execve' AND argv[2] = 'mcp')
, ex AS (SELECT h.*, (SELECT arg_max(name, (r.ts_ns, r.seq)) FROM reg r WHERE r.trace_id = h.trace_id AND (r.ts_ns, r.seq) <= (h.ts_ns, h.seq)) AS known FROM host h WHERE event = 'execve')
, served AS (SELECT *, CASE WHEN argv[1] = '/opt/fs-tool' AND known IS NOT NULL THEN known WHEN argv[1] LIKE '%/mcp-server-%' THEN split_part(argv[1], '/', -1) WHEN argv[1] = 'node' THEN 'chroma-mcp-server.js' END AS label FROM ex)
, ops AS (
  SELECT n.trace_id, n.ts_ns, n.seq, 0 AS step, 'clone' AS kind, n.pid, n.cl.pid AS parent, NULL AS label FROM near n LEFT JOIN first_fork f ON f.trace_id = n.trace_id AND f.child = n.pid
    WHERE n.cl IS NOT NULL AND n.ts_ns - n.cl.ts BETWEEN 0 AND 199999999 AND (n.cl.cg IS NULL OR n.cgroup_id IS NULL OR n.cl.cg = n.cgroup_id) AND n.cl.pid <> n.pid AND (f.at IS NULL OR (n.ts_ns, n.seq) < f.at)
  UNION ALL SELECT trace_id, ts_ns, seq, 1, 'root', pid, NULL, 'sess_' || (row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, seq) - 1) FROM host
    WHERE event = 'execve' AND split_part(argv[1], '/', -1) = 'claude' AND list_contains(argv, '-p')
  UNION ALL SELECT trace_id, ts_ns, seq, 2, 'server', pid, NULL, label FROM served WHERE label IS NOT NULL
  UNION ALL SELECT trace_id, ts_ns, seq, 3, 'fork', child, parent, NULL FROM forks)
, numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, seq, step) AS n FROM ops)
, walk AS (
  SELECT trace_id, 0::BIGINT AS n, MAP {}::MAP(BIGINT, VARCHAR) AS sessions, MAP {}::MAP(BIGINT, VARCHAR) AS servers, NULL::VARCHAR AS was_session, NULL::VARCHAR AS was_server, NULL::VARCHAR AS session, NULL::VARCHAR AS server
  FROM (SELECT DISTINCT trace_id FROM ops)
  UNION ALL
  SELECT trace_id, n, map_concat(sessions, MAP {pid: s}), map_concat(servers, MAP {pid: CASE
      WHEN kind = 'root' THEN NULL
      WHEN kind = 'clone' AND was_s IS NULL AND par_s IS NOT NULL THEN par_v
      WHEN kind = 'server' AND was_s IS NOT NULL AND was_v IS NULL THEN pid || '|' || seq || '|' || label
      WHEN kind = 'fork' AND par_s IS NOT NULL THEN coalesce(par_v, was_v) ELSE was_v END}), was_s, was_v, s, CASE
      WHEN kind = 'root' THEN NULL
      WHEN kind = 'clone' AND was_s IS NULL AND par_s IS NOT NULL THEN par_v
      WHEN kind = 'server' AND was_s IS NOT NULL AND was_v IS NULL THEN pid || '|' || seq || '|' || label
      WHEN kind = 'fork' AND par_s IS NOT NULL THEN coalesce(par_v, was_v) ELSE was_v END
  FROM (SELECT *, CASE WHEN kind = 'root' THEN label WHEN kind = 'clone' AND was_s IS NULL THEN par_s WHEN kind = 'fork' AND par_s IS NOT NULL THEN par_s ELSE was_s END AS s
    FROM (SELECT o.*, w.sessions, w.servers, map_extract(w.sessions, o.pid)[1] AS was_s, map_extract(w.servers, o.pid)[1] AS was_v,
            map_extract(w.sessions, o.parent)[1] AS par_s, map_extract(w.servers, o.parent)[1] AS par_v
          FROM walk w JOIN numbered o ON o.trace_id = w.trace_id AND o.n = w.n + 1)))
, states AS MATERIALIZED (
  SELECT o.trace_id, o.pid, o.ts_ns, o.seq, o.step, o.kind, w.session, w.server, o.label FROM walk w JOIN numbered o USING (trace_id, n)
  WHERE o.kind = 'root' OR w.session IS DISTINCT FROM w.was_session OR w.server IS DISTINCT FROM w.was_server)
, mcps AS (SELECT trace_id, 'mcp_' || (row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, seq) - 1) || '_' || label AS mcp_id, server AS server_key, session AS session_id, pid AS anchor_pid, label AS name, ts_ns AS t_start_ns, seq
  FROM states WHERE kind = 'server')
, in_session AS (SELECT trace_id, pid, session AS session_id, min(ts_ns) AS bound_ns FROM states WHERE session IS NOT NULL GROUP BY 1, 2, 3)
, in_mcp AS (SELECT DISTINCT s.trace_id, s.pid, m.mcp_id FROM states s JOIN mcps m ON m.trace_id = s.trace_id AND m.server_key = s.server)"""

# Each host event with the state of its pid, and each call from its request to its server's reply.
ATTRIBUTED = STATES + """, here AS MATERIALIZED (
  SELECT e.trace_id, e.seq, e.ts_ns, e.pid, e.event, e.k, s.session, s.server FROM host e ASOF LEFT JOIN
    (SELECT trace_id, pid, ts_ns::HUGEINT * 10000000 + seq AS at, arg_max(session, step) AS session, arg_max(server, step) AS server FROM states GROUP BY 1, 2, 3) s
    ON s.trace_id = e.trace_id AND s.pid = e.pid AND s.at <= e.ts_ns::HUGEINT * 10000000 + e.seq)
, asks AS (
  SELECT h.trace_id, h.ts_ns, h.seq, h.pid, 't' || (h.k % 5) AS name, m.mcp_id, m.server_key, m.anchor_pid, h.session AS session_id
  FROM here h ASOF JOIN (SELECT *, t_start_ns::HUGEINT * 10000000 + seq AS at FROM mcps) m ON m.trace_id = h.trace_id AND m.session_id = h.session AND m.at <= h.ts_ns::HUGEINT * 10000000 + h.seq
  WHERE h.event = 'sendto' AND h.k % 2 = 0 AND h.k BETWEEN 40 AND 69 AND h.session IS NOT NULL)
, calls AS MATERIALIZED (
  SELECT *, 'tc_' || (row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, seq) - 1) AS tool_call_id FROM asks)
, marks AS (
  SELECT trace_id, anchor_pid AS pid, ts_ns, seq, false AS reply, tool_call_id FROM calls
  UNION ALL SELECT trace_id, pid, ts_ns, seq, true, NULL FROM here WHERE event = 'sendto' AND k % 2 = 1 AND k BETWEEN 40 AND 69 AND server IS NOT NULL)
, closes AS (
  SELECT trace_id, tool_call_id, CASE WHEN next_reply THEN next_ts ELSE -1 END AS t_close_ns FROM (
    SELECT *, lead(reply) OVER w AS next_reply, lead(ts_ns) OVER w AS next_ts FROM marks WINDOW w AS (PARTITION BY trace_id, pid ORDER BY ts_ns, seq, reply)) WHERE NOT reply)"""
