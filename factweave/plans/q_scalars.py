"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.plans.registry import query

TYPES = "('commit', 'change-id', 'branch', 'path', 'project')"


@query("f1_parse_target", f"""
WITH p AS (SELECT doc_id, s, instr(s, ':') AS i FROM {{target_texts}}), t AS (SELECT *, CASE WHEN s = 'project' THEN s WHEN i > 0 THEN substr(s, 1, i - 1) END AS t, CASE WHEN i > 0 THEN substr(s, i + 1) END AS v FROM p),
e AS (SELECT *, CASE WHEN s = 'project' THEN NULL WHEN i = 0 THEN 'format' WHEN t NOT IN {TYPES} THEN 'type' WHEN t <> 'project' AND octet_length(encode(v)) < 3 THEN 'short' END AS error FROM t)
SELECT doc_id, CASE WHEN error IS NULL THEN t END AS type, CASE WHEN error IS NULL AND t <> 'project' THEN v END AS value, error FROM e""")
def f1(s):
    return s.target_texts.select("doc_id", C.parse_target("s").alias("p")).select("doc_id", "p.type", "p.value", "p.error")


@query("f2_key_error", """
WITH p AS (SELECT doc_id, key, string_split(key, ':') AS a FROM {key_texts})
SELECT doc_id, key, CASE WHEN list_contains(a, '') THEN 'empty' WHEN list_contains(a, '.') OR list_contains(a, '..') THEN 'dots' WHEN contains(key, '/') THEN 'slash' WHEN len(list_filter(a, lambda x: starts_with(x, '__'))) > 0 THEN 'reserved' END AS error FROM p""")
def f2(s):
    return s.key_texts.select("doc_id", "key", C.key_error("key").alias("error"))


@query("f3_target_label", "SELECT doc_id, CASE WHEN target_type = 'project' THEN 'project' ELSE target_type || ':' || target_value END AS label FROM {targets}")
def f3(s):
    return s.targets.select("doc_id", C.target_label("target_type", "target_value").alias("label"))


ESCAPED = "array_to_string(list_transform(string_split(target_value, '/'), lambda x: CASE WHEN starts_with(x, '~') OR starts_with(x, '__') THEN '~' || x ELSE x END), '/')"
BASE = f"CASE target_type WHEN 'project' THEN 'project' WHEN 'commit' THEN 'commit/' || substr(target_value, 1, 2) || '/' || target_value WHEN 'path' THEN 'path/' || {ESCAPED} || '/__target__' ELSE target_type || '/' || substr(sha1(target_value), 1, 2) || '/' || target_value END"


@query("f4_base_path", f"SELECT doc_id, {BASE} AS base FROM {{targets}}")
def f4(s):
    return s.targets.select("doc_id", C.base_path("target_type", "target_value").alias("base"))


@query("f5_escape_path", f"SELECT doc_id, {ESCAPED} AS escaped, target_value AS back FROM {{targets}}")
def f5(s):
    escaped = C.escape_path("target_value")
    return s.targets.select("doc_id", escaped.alias("escaped"), C.unescape_path(escaped).alias("back"))


@query("f6_fact_path", f"""
WITH b AS (SELECT *, {BASE} AS base, replace(key, ':', '/') AS k, CAST(ts AS VARCHAR) || '-' || substr(sha1(value), 1, 5) AS e FROM {{targets}})
SELECT doc_id, base || '/' || k || '/__value' AS v, base || '/' || k || '/__list/' || e AS l, base || '/' || k || '/__set/' || e AS s, base || '/__tombstones/' || k || '/__deleted' AS t, base || '/' || k || '/__list/__tombstones/' || e AS lt, base || '/' || k || '/__tombstones/' || e AS st FROM b""")
def f6(s):
    at = ("target_type", "target_value", "key")
    e = C.entry_name("ts", "value")
    names = {"v": "value", "l": "list", "s": "set", "t": "tombstone", "lt": "list_tombstone", "st": "set_tombstone"}
    return s.targets.select("doc_id", *(C.fact_path(what, *at, e if short not in "vt" else None).alias(short) for short, what in names.items()))


@query("f7_parse_path", """
SELECT doc_id, target_type AS type, CASE target_type WHEN 'branch' THEN CASE
    WHEN substr(sha1('feature'), 1, 2) = substr(sha1(target_value), 1, 2) THEN 'feature'
    WHEN substr(sha1(array_to_string(string_split(target_value, '/')[1:2], '/')), 1, 2) = substr(sha1(target_value), 1, 2) THEN array_to_string(string_split(target_value, '/')[1:2], '/')
    ELSE target_value END ELSE target_value END AS value,
  substr(target_value, length(CASE target_type WHEN 'branch' THEN CASE
    WHEN substr(sha1('feature'), 1, 2) = substr(sha1(target_value), 1, 2) THEN 'feature'
    WHEN substr(sha1(array_to_string(string_split(target_value, '/')[1:2], '/')), 1, 2) = substr(sha1(target_value), 1, 2) THEN array_to_string(string_split(target_value, '/')[1:2], '/')
    ELSE target_value END ELSE target_value END) + 2) || CASE WHEN target_type = 'branch' AND (substr(sha1('feature'), 1, 2) = substr(sha1(target_value), 1, 2) OR substr(sha1(array_to_string(string_split(target_value, '/')[1:2], '/')), 1, 2) = substr(sha1(target_value), 1, 2)) THEN '/' ELSE '' END || replace(key, ':', '/') || '/__value' AS rest FROM {targets}""")
def f7(s):
    p = C.parse_path(C.fact_path("value", "target_type", "target_value", "key"))
    return s.targets.select("doc_id", p.alias("p")).select("doc_id", "p.type", "p.value", F.array_join("p.parts", "/").alias("rest"))


@query("f8_entry_name", """
SELECT doc_id, CAST(ts AS VARCHAR) || '-' || substr(sha1(value), 1, 5) AS name, ts AS back, doc_id % 2 = 0 AS valid FROM {targets}""")
def f8(s):
    name = C.entry_name("ts", "value")
    spoiled = F.when(F.col("doc_id") % 2 == 0, name).otherwise(F.concat(F.lit("x"), name))
    return s.targets.select("doc_id", name.alias("name"), C.entry_ts(name).alias("back"), C.is_entry_name(spoiled).alias("valid"))


@query("f9_member_id", "SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS id FROM {documents}")
def f9(s):
    return s.documents.select("doc_id", C.member_id("text").alias("id"))


@query("f10_pattern_regex", r"""
WITH p AS (SELECT * FROM (VALUES ('draft:**', '^draft:(?:[^:]*:)*$'), ('*:*', '^[^:]*:[^:]*:$'), ('a:*', '^a:[^:]*:$'), ('**:v2', '^(?:[^:]*:)*v2:$'), ('session-*:v2', '^session-\*:v2:$')) v(pattern, re))
SELECT pattern, doc_id, key FROM p, {key_texts} WHERE regexp_matches(key || ':', re)""")
def f10(s):
    patterns = s.spark.createDataFrame([(x,) for x in ("draft:**", "*:*", "a:*", "**:v2", "session-*:v2")], "pattern string").withColumn("re", C.pattern_regex("pattern"))
    keys = s.key_texts
    return keys.join(F.broadcast(patterns), F.regexp_like(F.concat(keys["key"], F.lit(":")), F.col("re"))).select("pattern", "doc_id", "key")


RULES = "('exclude draft:**'), ('route a:* x,,y'), ('route b'), ('drop c'), ('exclude'), ('  route   c:d  z ')"


@query("f11_parse_rule", f"""
WITH r AS (SELECT rule, string_split(trim(regexp_replace(rule, '\\s+', ' ', 'g')), ' ') AS p FROM (VALUES {RULES}) v(rule)),
e AS (SELECT *, CASE WHEN len(p) < 2 THEN 'incomplete' WHEN p[1] NOT IN ('exclude', 'route') THEN 'action' WHEN p[1] = 'route' AND len(p) < 3 THEN 'destination' END AS error FROM r)
SELECT rule, CASE WHEN error IS NULL THEN p[1] END AS action, CASE WHEN error IS NULL THEN p[2] END AS pattern, CASE WHEN error IS NULL AND p[1] = 'route' THEN array_to_string(list_filter(string_split(p[3], ','), lambda x: x <> ''), ',') ELSE '' END AS dests, error, count(doc_id) AS n
FROM e LEFT JOIN {{key_texts}} ON p[2] = key GROUP BY ALL""")
def f11(s):
    rules = s.spark.sql(f"SELECT * FROM VALUES {RULES} AS v(rule)").select("rule", C.parse_rule("rule").alias("r")).select("rule", "r.action", "r.pattern", F.array_join("r.dests", ",").alias("dests"), "r.error")
    named = s.spark.sql(f"SELECT * FROM VALUES {RULES} AS v(rule)").select(F.col("rule").alias("r2"), F.get(F.split(F.trim(F.regexp_replace("rule", "\\s+", " ")), " "), F.lit(1)).alias("p"))
    n = named.join(s.key_texts, F.col("p") == F.col("key"), "left").groupBy("r2").agg(F.count("doc_id").alias("n"))
    return rules.join(n, F.col("rule") == F.col("r2")).drop("r2")


@query("f12_cutoff_ms", """
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id || 'd' WHEN 1 THEN (doc_id % 12) || 'm' WHEN 2 THEN '2y' ELSE '2024-0' || (1 + doc_id % 9) || '-11' END AS since FROM {documents})
SELECT doc_id, since, CASE doc_id % 4 WHEN 0 THEN 1700000000000 - doc_id * 86400000 WHEN 1 THEN 1700000000000 - (doc_id % 12) * 2592000000 WHEN 2 THEN 1700000000000 - 63072000000 ELSE epoch_us(CAST(since AS TIMESTAMP)) // 1000 END AS cutoff FROM t""")
def f12(s):
    d = F.col("doc_id")
    since = F.when(d % 4 == 0, F.concat(d.cast("string"), F.lit("d"))).when(d % 4 == 1, F.concat((d % 12).cast("string"), F.lit("m"))).when(d % 4 == 2, "2y").otherwise(F.concat(F.lit("2024-0"), (1 + d % 9).cast("string"), F.lit("-11")))
    return s.documents.select("doc_id", since.alias("since")).withColumn("cutoff", C.cutoff_ms("since", 1_700_000_000_000))


@query("f13_size_bytes", """
SELECT doc_id, n_chars || CASE doc_id % 5 WHEN 0 THEN 'k' WHEN 1 THEN 'M' WHEN 2 THEN 'g' WHEN 3 THEN '' ELSE 'x' END AS size, CASE doc_id % 5 WHEN 0 THEN n_chars * 1024 WHEN 1 THEN n_chars * 1048576 WHEN 2 THEN n_chars * 1073741824 WHEN 3 THEN n_chars END AS bytes FROM {documents}""")
def f13(s):
    d = F.col("doc_id") % 5
    unit = F.when(d == 0, "k").when(d == 1, "M").when(d == 2, "g").when(d == 3, "").otherwise("x")
    return s.documents.select("doc_id", F.concat(F.col("n_chars").cast("string"), unit).alias("size")).withColumn("bytes", C.size_bytes("size"))


@query("f14_key_shape", "SELECT doc_id, regexp_replace(key, '[0-9]+', '[n]', 'g') AS shape FROM {key_texts}")
def f14(s):
    return s.key_texts.select("doc_id", C.key_shape("key").alias("shape"))


@query("f15_preview", r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '["a","b"]' WHEN doc_id % 10 = 1 THEN '{"a":1,"b":{"c":2}}' ELSE text END AS v FROM {documents}),
f AS (SELECT *, string_split(v, chr(10))[1] AS first FROM t)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '[list: 2 items]' WHEN doc_id % 10 = 1 THEN '{object: 2 keys}' WHEN length(first) > 50 THEN substr(first, 1, 50) || '...' WHEN contains(v, chr(10)) AND regexp_replace(v, '\n+$', '') <> first THEN first || ' ...' ELSE first END AS preview,
  CASE WHEN length(v) <= 50 THEN v ELSE substr(v, 1, 47) || '...' END AS short FROM f""")
def f15(s):
    v = F.when(F.col("doc_id") % 10 == 0, '["a","b"]').when(F.col("doc_id") % 10 == 1, '{"a":1,"b":{"c":2}}').otherwise(F.col("text"))
    return s.documents.select("doc_id", C.preview(v).alias("preview"), C.truncate(v).alias("short"))


@query("f16_render_compact", """
SELECT target_value, key, CASE WHEN value_type = 'set' THEN string_agg(value, ', ' ORDER BY value) ELSE string_agg(value, ', ' ORDER BY id) END AS text FROM {base} WHERE value_type <> 'string' GROUP BY target_value, key, value_type""")
def f16(s):
    rows = s.base.where("value_type <> 'string'").groupBy("target_value", "key", "value_type").agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("i"))
    return rows.select("target_value", "key", C.render_compact("value_type", F.col("i.value")).alias("text"))


@query("f17_sanitise", "SELECT doc_id, replace(replace(s, '/', '-'), ':', '-') AS clean, replace(replace(s, '/', '-'), ':', '-') || '#' || doc_id AS branch FROM {target_texts}")
def f17(s):
    return s.target_texts.select("doc_id", C.sanitise("s").alias("clean"), C.branch_id("s", "doc_id").alias("branch"))


@query("f18_conventional_type", """
SELECT doc_id, subject, CASE doc_id % 13 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'chore' WHEN 4 THEN 'docs' WHEN 7 THEN 'perf-2' WHEN 8 THEN 'feat' WHEN 9 THEN 'feat' WHEN 10 THEN 'fix' END AS type, CASE WHEN doc_id % 13 IN (0, 4, 7, 8, 9, 10) THEN FALSE WHEN doc_id % 13 IN (1, 2) THEN TRUE END AS breaking FROM {subjects}""")
def f18(s):
    return s.subjects.select("doc_id", "subject", C.conventional_type("subject").alias("t")).select("doc_id", "subject", "t.type", "t.breaking")


@query("f19_closing_issues", "SELECT doc_id, array_to_string(list_sort(list_distinct(['#' || doc_id, '#' || doc_id % 5, '#12'])), ',') AS issues FROM {subjects}")
def f19(s):
    return s.subjects.select("doc_id", F.array_join(C.closing_issues("body"), ",").alias("issues"))


@query("f20_trailers", "SELECT doc_id, 'I' || doc_id AS change_id, 'c' || doc_id || ',d' AS checkpoints FROM {subjects}")
def f20(s):
    m = F.translate("message", "~", "\n")
    return s.subjects.select("doc_id", C.last_trailer(m, "Change-Id").alias("change_id"), F.array_join(C.trailers(m, "Entire-Checkpoint"), ",").alias("checkpoints"))


@query("f21_email_and_dates", """
WITH u AS (SELECT user_id, min(ts) // 1000 AS a, max(ts) // 1000 AS b FROM {ev} GROUP BY user_id)
SELECT user_id, 'n' || user_id || '@example.com' AS email, CASE WHEN a // 86400 = b // 86400 THEN strftime(make_timestamp(a * 1000000), '%Y-%m-%d') ELSE strftime(make_timestamp(a * 1000000), '%Y-%m-%d') || '..' || strftime(make_timestamp(b * 1000000), '%Y-%m-%d') END AS days FROM u""")
def f21(s):
    u = s.ev.groupBy("user_id").agg(F.floor(F.min("ts") / 1000).alias("a"), F.floor(F.max("ts") / 1000).alias("b"))
    return u.select("user_id", C.email_of(F.format_string("N %s <n%s@example.com>", F.col("user_id"), F.col("user_id"))).alias("email"), C.date_range(F.col("a"), F.col("b")).alias("days"))


@query("f22_content_texts", """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(replace(text, '"', '')) ELSE 'first|' || trim(replace(replace(text, '"', ''), chr(10), ' ')) END AS texts FROM {conversations}""")
def f22(s):
    t = F.regexp_replace("text", '"', "")
    blocks = F.concat(F.lit('[{"type":"text","text":" first "},{"type":"image","text":"no"},{"type":"text","text":"'), F.translate(t, "\n", " "), F.lit('"},{"type":"text","text":"  "}]'))
    return s.conversations.select("conv_id", "turn", F.array_join(C.content_texts(F.when(F.col("turn") % 2 == 0, t).otherwise(blocks)), "|").alias("texts"))


@query("f23_author_identity", "SELECT doc_id, CASE WHEN login IS NOT NULL THEN CASE WHEN trim(login) <> '' THEN login END WHEN trim(author) <> '' THEN author END AS who, doc_id % 2 = 0 AS approved FROM {subjects}")
def f23(s):
    state = F.when(F.col("doc_id") % 2 == 0, "Approved").otherwise("COMMENTED")
    return s.subjects.select("doc_id", C.author_identity("login", "author").alias("who"), (F.upper(state) == "APPROVED").alias("approved"))


@query("f24_rfc3339_ms", "SELECT event_id, ts // 1000 * 1000 AS ms FROM {ev}")
def f24(s):
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400000).cast("int")).cast("string")
    t = F.floor(F.col("ts") / 1000) % 86400
    text = F.format_string("%sT%02d:%02d:%02dZ", day, F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)
    return s.ev.select("event_id", C.rfc3339_ms(text).alias("ms"))


@query("f25_age_label", """
WITH d AS (SELECT doc_id, doc_id * doc_id * 131 - 50 AS d FROM {documents})
SELECT doc_id, CASE WHEN d < 0 THEN 'in the future' WHEN d < 60 THEN d || 's ago' WHEN d < 3600 THEN d // 60 || 'm ago' WHEN d < 86400 THEN d // 3600 || 'h ago' WHEN d < 604800 THEN d // 86400 || 'd ago'
  WHEN d // 604800 < 5 THEN d // 604800 || 'w ago' WHEN d // 2592000 < 12 THEN d // 2592000 || 'mo ago' ELSE d // 31536000 || 'y ago' END AS age FROM d""")
def f25(s):
    d = F.col("doc_id")
    return s.documents.select("doc_id", C.age_label(F.lit(1_700_000_000) - (d * d * 131 - 50), 1_700_000_000).alias("age"))


@query("f26_json_encode", "SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS json FROM {documents}")
def f26(s):
    return s.documents.select("doc_id", C.json_encode("text").alias("json"))


@query("f28_tool_summary", """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'ls ' || conv_id WHEN 1 THEN 'f' || turn WHEN 2 THEN '*.py' ELSE substr(replace(replace(text, '"', ''), chr(10), ' '), 1, 120) END AS summary FROM {conversations}""")
def f28(s):
    t, text = F.col("turn") % 4, F.translate(F.regexp_replace("text", '"', ""), "\n", " ")
    j = F.when(t == 0, F.format_string('{"command":"ls %s","file_path":"x"}', F.col("conv_id"))).when(t == 1, F.format_string('{"file_path":"f%s"}', F.col("turn"))).when(t == 2, '{"pattern":"*.py"}').otherwise(F.concat(F.lit('{"prompt":"'), text, F.lit('"}')))
    return s.conversations.select("conv_id", "turn", C.tool_summary(j).alias("summary"))


@query("s18_decode_list", """
SELECT target_value, ts, value FROM (SELECT target_value, CASE WHEN conv_id % 2 = 0 THEN ts ELSE turn END AS ts, role AS value FROM {chat}) x""")
def s18(s):
    c = s.chat.groupBy("target_value", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "ts"))).alias("t"))
    boxed = F.transform("t", lambda x: F.to_json(F.struct(x["role"].alias("value"), F.when(x["turn"] % 2 == 0, x["ts"].cast("string")).otherwise(x["ts"].cast("string")).alias("timestamp"))))
    payload = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("["), F.array_join(boxed, ","), F.lit("]"))).otherwise(F.to_json(F.col("t.role")))
    return c.select("target_value", F.explode(C.decode_list(payload)).alias("i")).select("target_value", "i.ts", "i.value")
