"""Queries of the importers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators.shared import scratch
from factweave.plans.registry import query
from factweave.sources import importers as I
from factweave.sources.tables import read_transcripts

MERGED = "1700000000000 + o_custkey * 1000"
PRS = f"""
WITH o AS (SELECT id, author, ts, o_custkey, message, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {{commits}}),
p AS (SELECT DISTINCT o_custkey, 'feature-x#' || o_custkey AS b, {MERGED} AS merged FROM o),
c AS (SELECT o_custkey, n, id, split_part(split_part(message, chr(10), 1), '(', 1) AS kind FROM o),
w AS (SELECT o_custkey, 'branch' AS target_type, b AS target_value, key, value_type, value, s, n FROM p, LATERAL (VALUES
    (1, 0, 'title', 'string', 'PR ' || o_custkey), (2, 0, 'description', 'string', 'Fixes #' || o_custkey || ' now'), (3, 0, 'review:number', 'string', CAST(o_custkey AS VARCHAR)), (4, 0, 'review:url', 'string', 'https://example.com/' || o_custkey),
    (5, 0, 'github:head-ref', 'string', 'feature/x'), (6, 0, 'github:base-ref', 'string', CASE WHEN o_custkey % 20 = 0 THEN 'main' END), (7, 1, 'issue:id', 'set', '#7'), (7, CASE WHEN CAST(o_custkey AS VARCHAR) < '7' THEN 0 ELSE 2 END, 'issue:id', 'set', CASE WHEN o_custkey <> 7 THEN '#' || o_custkey END), (8, 0, 'issue:url', 'set', 'https://example.com/i/7'),
    (9, 0, 'review:reviewed', 'set', 'ann'), (9, 1, 'review:reviewed', 'set', 'bob'), (10, 0, 'review:approved', 'set', 'bob'), (11, 0, 'review:comment', 'list', '{{"kind":"comment","author":"ann","body":" looks good ","url":null,"created_at":"t0"}}'), (11, 1, 'review:comment', 'list', '{{"kind":"review","author":"ann","body":"hm","url":"u","created_at":null}}')) v(s, n, key, value_type, value) WHERE value IS NOT NULL
  UNION ALL SELECT o_custkey, 'commit', id, 'branch-id', 'string', 'feature-x#' || o_custkey, 12, n * 2 FROM c UNION ALL SELECT o_custkey, 'commit', id, 'conventional:type', 'set', kind, 12, n * 2 + 1 FROM c
  UNION ALL SELECT o_custkey, 'branch', 'feature-x#' || o_custkey, 'commits:author', 'set', author, 13, 0 FROM (SELECT DISTINCT o_custkey, author FROM o) a
  UNION ALL SELECT o_custkey, 'branch', 'feature-x#' || o_custkey, 'commits:author-date', 'set', CAST(ts AS VARCHAR), 14, ts FROM (SELECT DISTINCT o_custkey, ts FROM o) a
  UNION ALL SELECT o_custkey, 'project', '', key, value_type, value, s, 0 FROM p, LATERAL (VALUES (15, 'github:repo', 'string', 'a/b'), (16, 'github:last-imported-merged-at', 'string', CAST(merged AS VARCHAR)), (17, 'github:imported-pr', 'set', CAST(o_custkey AS VARCHAR))) v(s, key, value_type, value)),
facts AS (SELECT o_custkey AS number, target_type, target_value, key, value_type, value, {MERGED} + row_number() OVER (PARTITION BY o_custkey ORDER BY s, n) - 1 AS ts FROM w)
"""


def pulls(s):
    """Pull requests as JSON, one for every customer: its orders are the commits."""
    c = s.commits.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("id").alias("oid"), F.substring_index("message", "\n", 1).alias("messageHeadline")))).alias("c"))
    n = F.col("o_custkey")
    text = lambda f: F.format_string(f, n)
    who = lambda w: F.struct(F.lit(w).alias("login"))
    real = F.transform("c", lambda x: F.struct(x["oid"].alias("oid"), x["messageHeadline"].alias("messageHeadline")))
    merged = F.concat(F.translate(F.substring((F.timestamp_millis(1_700_000_000_000 + n * 1000)).cast("string"), 1, 19), " ", "T"), F.lit("Z"))
    at = F.lit(1_700_000_000) + n
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86400).cast("int")).cast("string")
    merged = F.format_string("%sT%02d:%02d:%02dZ", day, F.floor(at / 3600) % 24, F.floor(at / 60) % 60, at % 60)
    json = F.to_json(F.struct(
        n.alias("number"), text("PR %d").alias("title"), text("Fixes #%d now").alias("body"), text("https://example.com/%d").alias("url"), F.lit("feature/x").alias("headRefName"),
        F.when(n % 20 == 0, "main").alias("baseRefName"), merged.alias("mergedAt"), F.concat(F.array(F.struct(F.lit("gone").alias("oid"), F.lit("x").alias("messageHeadline"))), real).alias("commits"),
        F.array(F.struct(who("ann").alias("author"), F.lit(" looks good ").alias("body"), F.lit("t0").alias("createdAt")), F.struct(who("ann").alias("author"), F.lit("  ").alias("body"), F.lit("t1").alias("createdAt"))).alias("comments"),
        F.array(F.struct(who("bob").alias("author"), F.lit("approved").alias("state"), F.lit("").alias("body"), F.lit("u").alias("url")), F.struct(who("ann").alias("author"), F.lit("COMMENTED").alias("state"), F.lit("hm").alias("body"), F.lit("u").alias("url"))).alias("reviews"),
        F.struct(F.lit("gone").alias("oid")).alias("mergeCommit"), F.array(F.struct(F.lit(7).alias("number"), F.lit("https://example.com/i/7").alias("url"))).alias("closingIssuesReferences")))
    return c.select(json.alias("json"))


@query("s12_import_pull_requests", PRS + "SELECT number, target_type, target_value, key, value_type, value, ts FROM facts")
def s12(s):
    return I.import_pull_requests(pulls(s), s.commits, "a/b")


@query("n4_import_times", PRS + "SELECT number, min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS n FROM facts GROUP BY number")
def n4(s):
    return s12(s).groupBy("number").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("ts").alias("n"))


@query("a13_import_summary", PRS[:-1] + """, k AS (SELECT DISTINCT o_custkey FROM {commits} WHERE contains(message, '(P): 1-')),
f AS (SELECT * FROM facts WHERE number NOT IN (SELECT o_custkey FROM k) AND number % 7 <> 0)
SELECT (SELECT count(*) FROM p) AS fetched, (SELECT count(*) FROM p WHERE o_custkey % 7 = 0 OR o_custkey IN (SELECT o_custkey FROM k)) AS skipped, count(DISTINCT number) AS imported, count(*) FILTER (key = 'review:comment') AS comments, count(*) AS writes, count(DISTINCT number) AS missing_commits FROM f""")
def a13(s):
    """A second run: some were imported before, some were merged before the cutoff."""
    early = F.regexp_replace("json", '"mergedAt":"[^"]*"', '"mergedAt":"2001-01-01T00:00:00Z"')
    number = F.get_json_object("json", "$.number").cast("long")
    p = pulls(s).withColumn("json", F.when(number % 7 == 0, early).otherwise(F.col("json")))
    had = s.commits.where(F.contains("message", F.lit("(P): 1-"))).select(F.lit("project").alias("target_type"), F.lit("github:imported-pr").alias("key"), F.col("o_custkey").cast("string").alias("value"))
    known, since = I.imported_numbers(had), 1_600_000_000
    new = I.skipped_pull_requests(p, known, since).where("not skipped")
    return I.import_summary(p, I.import_pull_requests(new, s.commits, "a/b"), s.commits, known, since)


@query("s13_import_checkpoints", """
WITH c AS (SELECT conv_id, turn, role, text FROM {chat}),
w AS (SELECT conv_id, turn, s, n, key, value_type, value FROM c, LATERAL (VALUES (1, 0, 'agent', 'string', 'tool'), (2, 0, 'model', 'string', role), (3, 0, 'turn-id', 'string', 't' || turn), (4, 0, 'token-usage', 'string', '{"in":' || turn || '}'),
  (5, 0, 'prompt', 'string', text), (6, 0, 'transcript', 'string', '{"a":1}'), (7, 0, 'content-hash', 'string', 'h' || conv_id), (8, 0, 'tasks:s-0:checkpoint', 'string', '{"step":' || turn || '}'), (9, 0, 'tasks:t-1:checkpoint', 'string', text), (10, 0, 'tasks:t-1:agent-a', 'list', 'l1'), (10, 1, 'tasks:t-1:agent-a', 'list', 'l2'), (11, 0, NULL, NULL, NULL)) v(s, n, key, value_type, value)
  UNION ALL SELECT conv_id, turn, 12, i, 'tasks:t-1:agent-x', 'list', line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c) l WHERE trim(line) <> ''),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s, n) AS place FROM w)
SELECT 'k' || conv_id AS checkpoint, CAST(turn AS INT) AS session, 'commit' AS target_type, 'c' || conv_id AS target_value, CASE WHEN turn = 0 THEN 'agent:' ELSE 'agent:session-' || turn || ':' END || key AS key, value_type, value,
  1700000000000 + conv_id * 1000 + place - 1 AS ts FROM x WHERE key IS NOT NULL""")
def s13(s):
    c = s.chat
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    meta = F.concat(F.lit('{"agent":"tool","model":"'), "role", F.lit('","turn_id":"t'), turn, F.lit('","tokenUsage":{"in":'), turn, F.lit("}}"))
    pairs = (("metadata.json", meta), ("prompt.txt", F.col("text")), ("full.jsonl", F.lit('{"a":1}')), ("content_hash.txt", F.concat(F.lit(" h"), conv, F.lit(" "))), ("tasks/t:1/agent-a.jsonl", F.lit("l1\n\nl2\n")), ("tasks/t:1/other", F.lit("z")),
             ("tasks/t:1/agent-x.jsonl", F.col("text")), ("tasks/t:1/agent-y.jsonl", F.lit("\n \n")), ("tasks/t:1/checkpoint.json", F.col("text")), ("tasks/s/0", F.lit("z")), ("tasks/s:0/checkpoint.json", F.concat(F.lit('{"step":'), turn, F.lit("}"))))
    files = c.select(F.concat(F.lit("k"), conv).alias("checkpoint"), F.col("turn").cast("int").alias("session"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("content")) for n, v in pairs))).alias("f")).select("checkpoint", "session", "f.*")
    commits = s.chat.select("conv_id").distinct().select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), (F.lit(1_700_000_000) + F.col("conv_id")).alias("ts"), F.concat(F.lit("x\n\nEntire-Checkpoint: k"), F.col("conv_id").cast("string")).alias("message"))
    return I.import_checkpoints(commits, files)


@query("s14_import_trails", """
WITH t AS (SELECT DISTINCT 't' || conv_id AS trail, conv_id FROM {chat} WHERE conv_id % 3 > 0),
w AS (SELECT trail, 'b' || conv_id || '-' || substr(sha1(trail), 1, 8) AS b, n, key, value_type, value FROM t, LATERAL (VALUES (1, 'review:trail-id', 'string', trail), (2, 'review:title', 'string', 'T' || conv_id), (3, 'review:priority', 'string', '2'), (4, 'review:labels', 'string', '["x","y"]'),
  (5, 'review:checkpoints', 'list', '{"a":1}'), (6, 'review:checkpoints', 'list', '{"a":2}')) v(n, key, value_type, value))
SELECT trail, 'branch' AS target_type, b AS target_value, key, value_type, value, 1700000000000 + n - 1 AS ts FROM w""")
def s14(s):
    conv = F.col("conv_id").cast("string")
    t = s.chat.select("conv_id").distinct()
    meta = F.concat(F.lit('{"branch":"b'), conv, F.lit('","title":"T'), conv, F.lit('","priority":2,"labels":["x","y"]}'))
    files = t.select(F.concat(F.lit("t"), conv).alias("trail"), F.explode(F.array(F.struct(F.lit("metadata.json").alias("name"), meta.alias("content")), F.struct(F.lit("checkpoints.json").alias("name"), F.lit('[{"a":1},{"a":2}]').alias("content")))).alias("f")).select("trail", "f.*")
    known = t.where("conv_id % 3 = 0").select(F.lit("review:trail-id").alias("key"), F.concat(F.lit("t"), conv).alias("value"))
    return I.import_trails(files, known, 1_700_000_000_000)


@query("s15_import_notes", """
WITH o AS (SELECT id, ts, o_orderkey FROM {commits} WHERE o_orderkey % 4 < 3)
SELECT id, 'commit' AS target_type, id AS target_value, key, 'string' AS value_type, value, ts * 1000 + row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS ts FROM o, LATERAL (VALUES (1, 'agent.blame', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'f.py 1-' || o_orderkey END), (2, 'agent.schema-version', CASE WHEN o_orderkey % 4 = 0 THEN '3' ELSE 'unknown' END),
  (3, 'agent.tool-version', CASE WHEN o_orderkey % 4 = 0 THEN '1.0' END), (4, 'agent.model', CASE WHEN o_orderkey % 4 = 0 THEN 'cli/m1, unknown/m2' ELSE 'unknown' END)) v(n, key, value) WHERE value IS NOT NULL""")
def s15(s):
    m = F.col("o_orderkey") % 4
    full = F.lit('---\n{"schema_version":"3","git_ai_version":"1.0","prompts":{"p1":{"agent_id":{"tool":"cli","model":"m1"}},"p2":{"agent_id":{"model":"m2"}},"p3":{"agent_id":{"tool":"cli","model":"m1"}}}}')
    text = F.when(m == 0, full).when(m == 3, "no separator").otherwise(F.concat(F.lit("f.py 1-"), F.col("o_orderkey").cast("string"), F.lit("  \n---\n{}")))
    return I.import_notes(s.commits.select("id", text.alias("text")), s.commits)


@query("s16_read_transcripts", """
SELECT 's' || conv_id AS session_id, role AS type, turn = 1 AS is_meta, CASE WHEN turn % 2 = 0 THEN text ELSE '[{"type":"text","text":"x' || turn || '"}]' END AS content, CASE WHEN turn % 2 = 0 THEN 'm' || turn END AS model, CASE WHEN turn % 2 = 0 THEN turn END AS input_tokens FROM {chat}""")
def s16(s):
    """Transcripts of both layouts as JSONL, with a line in each session that doesn't parse."""
    path = scratch(s.spark, "transcripts")
    sid, turn = F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.col("turn")
    deep = F.to_json(F.struct(F.col("role").alias("type"), sid.alias("sessionId"), F.struct(F.concat(F.lit("m"), turn.cast("string")).alias("model"), F.struct(turn.alias("input_tokens")).alias("usage"), F.col("text").alias("content")).alias("message")))
    flat = F.to_json(F.struct(F.col("role"), sid.alias("sessionId"), (turn == 1).alias("isMeta"), F.concat(F.lit('[{"type":"text","text":"x'), turn.cast("string"), F.lit('"}]')).alias("content")))
    lines = s.chat.select(F.when(turn % 2 == 0, deep).otherwise(flat).alias("value"))
    lines.unionByName(s.chat.where("turn = 0").select(F.lit('{"type":').alias("value"))).write.text(path)
    return read_transcripts(s.spark, path).select("session_id", "type", "is_meta", "content", "model", "input_tokens")
