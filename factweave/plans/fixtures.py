"""Facts, logs, snapshots and commits drawn from the given tables.

The tables hold no facts, so each fixture derives them by a SQL text that Spark and DuckDB both
read. ``{name}`` stands for a table or another fixture, MS(x) for the milliseconds of a time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "labels", "conversations", "events", "orders", "lineitem", "part", "pages", "benchmark", "customer")
K = ("target_type", "target_value", "key")

FIXTURES: dict[str, str] = {
    "ev": """
SELECT event_id, user_id, event_type, MS(ts) AS ts, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k FROM {events}""",
    "mut": """
SELECT event_id AS seq, 'change-id' AS target_type, 'user-' || CAST(user_id AS STRING) AS target_value,
  CASE WHEN event_type IN ('signup', 'error') THEN 'profile:k' || CAST(k % 5 AS STRING) WHEN event_type = 'view' THEN 'activity:view' ELSE 'tags:seen' END AS key,
  CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'rm' WHEN 'view' THEN 'push' WHEN 'click' THEN 'set_add' ELSE 'set_rm' END AS op,
  CASE event_type WHEN 'signup' THEN 'v' || CAST(event_id AS STRING) WHEN 'error' THEN NULL ELSE 'k' || CAST(k % 20 AS STRING) END AS value,
  CASE WHEN event_type IN ('signup', 'error') THEN 'string' WHEN event_type = 'view' THEN 'list' ELSE 'set' END AS value_type,
  CAST(NULL AS INT) AS idx, 'u' || CAST(user_id % 9 AS STRING) || '@example.com' AS email, ts FROM {ev}""",
    "facts": """
SELECT 'path' AS target_type, source || '/' || lang || '/' || CAST(doc_id AS STRING) AS target_value, key, 'string' AS value_type,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE value END AS value, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1700000000000 + doc_id * 3600000 END AS last_ts,
  FALSE AS is_ref, doc_id % 17 = 0 AS is_promised, doc_id
FROM (SELECT doc_id, source, lang, 'doc:source' AS key, source AS value FROM {documents} UNION ALL SELECT doc_id, source, lang, 'doc:lang', lang FROM {documents}
  UNION ALL SELECT doc_id, source, lang, 'text:v' || CAST(doc_id % 3 AS STRING), text FROM {documents}
  UNION ALL SELECT d.doc_id, source, lang, 'label:quality', CAST(quality AS STRING) FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
  UNION ALL SELECT d.doc_id, source, lang, 'label:toxic', CAST(toxic AS STRING) FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) x
UNION ALL SELECT 'project', '', 'meta:note:n' || CAST(item_id AS STRING), 'string', text, 1600000000000 + item_id, FALSE, FALSE, item_id FROM {benchmark}""",
    "doc_versions": """
SELECT doc_id, 'path' AS target_type, source || '/' || lang || '/' || CAST(doc_id AS STRING) AS target_value, 'doc:' || lang AS key, text AS v FROM {documents}""",
    "chat": """
SELECT conv_id, turn, role, 'change-id' AS target_type, 'conv-' || CAST(conv_id AS STRING) AS target_value, CAST(1700000000000 + conv_id * 100000 + turn * 1000 AS BIGINT) AS ts, text FROM {conversations}""",
    "base": """
SELECT target_type, target_value, key, 'string' AS value_type, '' AS id, v AS value FROM {doc_versions} WHERE doc_id % 10 <> 9
UNION ALL SELECT target_type, target_value, 'chat:log', 'list', CAST(ts AS STRING) || '-' || substr(sha1(text), 1, 5), text FROM {chat} WHERE turn % 3 = 0
UNION ALL SELECT DISTINCT target_type, target_value, 'chat:roles', 'set', sha1(role), role FROM {chat} WHERE role = 'user'""",
    "local": """
SELECT target_type, target_value, key, 'string' AS value_type, '' AS id, CASE WHEN doc_id % 4 = 1 THEN v || ' L' ELSE v END AS value FROM {doc_versions}
  WHERE doc_id % 7 <> 3 AND (doc_id % 10 <> 9 OR doc_id % 2 = 1 AND doc_id % 3 < 2)
UNION ALL SELECT target_type, target_value, 'chat:log', 'list', CAST(ts AS STRING) || '-' || substr(sha1(text), 1, 5), text FROM {chat} WHERE turn % 3 < 2 AND conv_id % 6 <> 1
UNION ALL SELECT DISTINCT target_type, target_value, 'chat:roles', 'set', sha1(role), role FROM {chat} WHERE role <> 'system'""",
    "remote": """
SELECT target_type, target_value, key, 'string' AS value_type, '' AS id, CASE WHEN doc_id % 5 = 2 THEN v || ' R' ELSE v END AS value FROM {doc_versions}
  WHERE doc_id % 11 <> 5 AND (doc_id % 10 <> 9 OR doc_id % 3 = 0)
UNION ALL SELECT target_type, target_value, 'chat:log', 'list', CAST(ts AS STRING) || '-' || substr(sha1(text), 1, 5), CASE WHEN turn = 0 AND conv_id % 4 = 0 THEN text || '!' ELSE text END FROM {chat} WHERE turn % 3 <> 1 AND conv_id % 8 <> 3
UNION ALL SELECT DISTINCT target_type, target_value, 'chat:roles', 'set', sha1(role), role FROM {chat} WHERE role <> 'assistant'""",
    "tomb_base": """
SELECT target_type, target_value, key, 1500000000000 + doc_id AS ts, 'b@example.com' AS email FROM {doc_versions} WHERE doc_id % 10 = 9""",
    "tomb_local": """
SELECT target_type, target_value, key, CASE WHEN doc_id % 3 = 0 THEN 1500000000000 + doc_id ELSE 1510000000000 + doc_id END AS ts, 'b@example.com' AS email FROM {doc_versions} WHERE doc_id % 10 = 9 AND doc_id % 4 <> 1 OR doc_id % 7 = 3""",
    "tomb_remote": """
SELECT target_type, target_value, key, CASE WHEN doc_id % 5 <> 4 THEN 1500000000000 + doc_id ELSE 1520000000000 + doc_id END AS ts, 'b@example.com' AS email FROM {doc_versions} WHERE doc_id % 10 = 9 AND doc_id % 6 <> 1 OR doc_id % 11 = 5""",
    "entry_tombs": """
SELECT side, target_type, target_value, 'chat:log' AS key, CAST(ts AS STRING) || '-' || substr(sha1(text), 1, 5) AS id, 1600000000000 + conv_id * 7 % (side_no + 3) AS ts, side || '@example.com' AS email
FROM {chat} CROSS JOIN (SELECT 'local' AS side, 1 AS side_no UNION ALL SELECT 'remote', 2) s WHERE (turn + side_no) % 3 = 1""",
    "member_tombs": """
SELECT DISTINCT side, target_type, target_value, 'chat:roles' AS key, sha1(role) AS id, role || side AS value
FROM {chat} CROSS JOIN (SELECT 'local' AS side, 'system' AS r UNION ALL SELECT 'remote', 'assistant' UNION ALL SELECT 'remote', 'system') s WHERE role = r
UNION ALL SELECT DISTINCT side, target_type, target_value, 'chat:roles', sha1('guest'), 'guest' || side FROM {chat} CROSS JOIN (SELECT 'local' AS side, 2 AS m UNION ALL SELECT 'remote', 3) s WHERE conv_id % m = 0""",
    "queue": """
SELECT event_id + CASE WHEN event_type = 'click' AND user_id % 3 > 0 THEN 100000000 ELSE 0 END AS seq, 'change-id' AS target_type, 'user-' || CAST(user_id AS STRING) AS target_value, 'queue:q' AS key,
  CASE WHEN event_type = 'view' THEN 'push' ELSE 'pop' END AS op, 'k' || CAST(k % 6 AS STRING) AS value, 'list' AS value_type, CAST(NULL AS INT) AS idx, 'u@example.com' AS email,
  CASE WHEN event_id % 7 = 0 THEN ts - 90000000 ELSE ts END AS ts FROM {ev} WHERE event_type IN ('view', 'click')""",
    "commits": """
SELECT sha1('o' || CAST(o_orderkey AS STRING)) AS id, lag(sha1('o' || CAST(o_orderkey AS STRING))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent,
  'u' || CAST(o_custkey AS STRING) || '@example.com' AS author, o_custkey, o_orderkey, MS(o_orderdate) // 1000 AS ts,
  CASE o_orderkey % 3 WHEN 0 THEN 'fix(' ELSE 'feat(' END || o_orderstatus || '): ' || o_orderpriority || '\n\nChange-Id: I' || CAST(o_orderkey AS STRING) AS message FROM {orders}""",
    "commit_facts": """
SELECT 'commit' AS target_type, id AS target_value, 'branch-id' AS key, CAST(o_custkey AS STRING) || '#' || CAST(o_orderkey % 100 AS STRING) AS value, ts FROM {commits} WHERE o_orderkey % 4 <> 0
UNION ALL SELECT 'commit', id, 'review:status', o_state, ts FROM (SELECT id, ts, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'open' END AS o_state FROM {commits}) c WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'change-id', 'I' || CAST(o_orderkey AS STRING), 'agent:model', 'm' || CAST(o_orderkey % 3 AS STRING), ts FROM {commits} WHERE o_orderkey % 6 = 0""",
    "tags": """
SELECT 'v' || CAST(o_orderkey AS STRING) AS name, sha1('o' || CAST(o_orderkey AS STRING)) AS commit_id, MS(o_orderdate) // 1000 AS created FROM {orders} WHERE o_orderstatus = 'P'""",
    "lines": """
SELECT file, row_number() OVER (PARTITION BY file ORDER BY l_orderkey, l_linenumber) + CASE WHEN l_orderkey % 50 > 40 THEN 1 ELSE 0 END AS line, sha1('o' || CAST(l_orderkey AS STRING)) AS commit_id
FROM (SELECT l_partkey % 50 AS file, l_orderkey, l_linenumber FROM {lineitem}) x""",
    "sessions": """
SELECT user_id, sid, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM (
  SELECT user_id, ts, event_id, CAST(sum(CASE WHEN gap > 1800000 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sid
  FROM (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {ev}) g) s GROUP BY user_id, sid""",
    "purchases": """
SELECT sha1('e' || CAST(event_id AS STRING)) AS id, user_id, ts, event_id, k, k % 3 = 0 AS assisted FROM {ev} WHERE event_type = 'purchase'""",
    "outputs": """
SELECT p.event_id AS out_id, p.user_id, s.sid, CASE p.k % 4 WHEN 0 THEN '[main ' || substr(p.id, 1, 7) || '] done' WHEN 1 THEN 'commit ' || p.id || ' ok' WHEN 2 THEN '00' || substr(p.id, 1, 7) || 'fff' ELSE substr(p.id, 1, 6) END AS result
FROM {purchases} p JOIN {sessions} s ON s.user_id = p.user_id AND p.ts BETWEEN s.start_ts AND s.end_ts""",
    "target_texts": """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'project' WHEN 1 THEN 'project:x' WHEN 2 THEN 'path:' || source || '/' || lang WHEN 3 THEN 'commit:' || sha1(text) WHEN 4 THEN 'branch:a:b' || lang
  WHEN 5 THEN 'change-id:' || lang WHEN 6 THEN 'tag:' || lang WHEN 7 THEN lang ELSE 'path:é' END AS s FROM {documents}""",
    "key_texts": """
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'a:' || source WHEN 1 THEN 'a::' || source WHEN 2 THEN '__' || lang WHEN 3 THEN 'x:__list' WHEN 4 THEN 'x/' || lang WHEN 5 THEN '..:' || lang WHEN 6 THEN '' WHEN 7 THEN 'session-' || CAST(doc_id AS STRING) || ':v2'
  WHEN 8 THEN 'draft:' || lang || ':x' ELSE 'draft' END AS key, doc_id % 7 AS k FROM {documents}""",
    "targets": """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'project' WHEN 1 THEN 'path' WHEN 2 THEN 'commit' WHEN 3 THEN 'branch' ELSE 'change-id' END AS target_type,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN '__' ELSE '~' END || source || '/' || lang || '/__x/' || CAST(doc_id AS STRING) WHEN 2 THEN sha1(text) WHEN 3 THEN 'feature/' || lang || '/' || CAST(doc_id AS STRING) ELSE 'I' || CAST(doc_id AS STRING) END AS target_value,
  'doc:' || lang || ':v' || CAST(doc_id % 4 AS STRING) AS key, text AS value, 1600000000000 + doc_id AS ts FROM {documents}""",
    "subjects": """
SELECT doc_id, CASE doc_id % 13 WHEN 8 THEN ' feat: ' WHEN 9 THEN 'feat : ' WHEN 10 THEN 'fix(a) : ' WHEN 11 THEN 'fix !: ' WHEN 12 THEN ' : ' WHEN 0 THEN 'feat: ' WHEN 1 THEN 'fix(core)!: ' WHEN 2 THEN 'chore!: ' WHEN 3 THEN 'Not a type: ' WHEN 4 THEN 'docs(a:b): ' WHEN 5 THEN 'no colon ' WHEN 6 THEN 'UP: ' ELSE 'perf-2: ' END || lang AS subject,
  'This fixes #' || CAST(doc_id AS STRING) || ' and Closes: #' || CAST(doc_id % 5 AS STRING) || ', see #7 resolved (#12). fix nothing' AS body,
  'Subject' || CASE WHEN doc_id % 2 = 0 THEN ' x' ELSE '' END || '~~Change-Id: Iold~Change-Id:  I' || CAST(doc_id AS STRING) || ' ~Entire-Checkpoint: c' || CAST(doc_id AS STRING) || '~Entire-Checkpoint: d~' AS message,
  CASE doc_id % 4 WHEN 0 THEN ' u' || CAST(doc_id AS STRING) || ' ' WHEN 1 THEN ' ' WHEN 2 THEN '' ELSE NULL END AS login, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 5 = 1 THEN '' ELSE 'Name ' || CAST(doc_id AS STRING) || ' <n' || CAST(doc_id AS STRING) || '@example.com>' END AS author FROM {documents}""",
    "rules": """
SELECT * FROM (VALUES (1, 'exclude label:tox*'), (2, 'route label:** quality,audit'), (3, 'exclude draft:**'), (4, 'route text:* texts'), (5, 'route meta:** config,audit'), (6, 'exclude label:toxic')) r(n, rule)""",
}


def _text(sql: str, engine: str) -> str:
    if engine == "spark":
        sql = re.sub(r"MS\(([^()]*)\)", r"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1) div 1000)", sql)
        return sql.replace("//", "div")
    return re.sub(r"MS\(([^()]*)\)", r"(epoch_us(\1) // 1000)", sql).replace("'\\n\\n", "chr(10) || chr(10) || '")


def needs(sql: str) -> list[str]:
    """Fixtures that a text refers to, each after those it builds on."""
    found: list[str] = []
    for name in re.findall(r"\{(\w+)\}", sql):
        if name in FIXTURES and name not in found:
            found += [x for x in [*needs(FIXTURES[name]), name] if x not in found]
    return found


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a fixture built from tables."""
    if name in FIXTURES:
        text = _text(FIXTURES[name], "spark")
        return spark.sql(text, **{x: frame(spark, sf_dir, x) for x in set(re.findall(r"\{(\w+)\}", text))})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """SQL for DuckDB: the fixtures that ``sql`` names as {fixture}, then ``sql`` itself."""
    names = needs(sql)
    strip = lambda text: re.sub(r"\{(\w+)\}", r"\1", _text(text, "duckdb"))
    head = ", ".join(f"{x} AS ({strip(FIXTURES[x])})" for x in names)
    body = strip(sql).strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
