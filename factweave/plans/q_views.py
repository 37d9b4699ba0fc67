"""Queries of the read views and of retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import retention as R
from factweave.operators import snapshot as N
from factweave.operators import views as V
from factweave.operators.merge import K
from factweave.plans.q_snapshot import BIG, FILES, ROUTE_RULES, _local
from factweave.plans.registry import query

KC = "target_type, target_value, key"
NOW = 1_703_700_000_000
WEEK = 7 * 86_400_000


@query("a1_stats_by_key", 'SELECT target_type, key, count(*) AS "count" FROM {facts} GROUP BY ALL')
def a1(s):
    return V.stats_by_key(s.facts)


@query("a2_size_histogram", f"""
WITH v AS (SELECT {BIG} AS r, CASE WHEN {BIG} THEN 40 ELSE octet_length(encode(value)) END AS n FROM {{facts}}),
b AS (SELECT CASE WHEN r THEN 'references' WHEN n < 64 THEN '<64B' WHEN n < 1024 THEN '64B–1KB' WHEN n < 4096 THEN '1KB–4KB' ELSE '4KB–16KB' END AS bucket, count(*) AS n FROM v GROUP BY ALL)
SELECT bucket, coalesce(b.n, 0) AS n FROM (SELECT unnest(['<64B', '64B–1KB', '1KB–4KB', '4KB–16KB', '16KB–64KB', '64KB+', 'references']) AS bucket) a LEFT JOIN b USING (bucket)""")
def a2(s):
    return V.size_histogram(N.externalise(s.facts.drop("is_ref"))[0])


@query("a3_storage_counts", f"SELECT count(*) FILTER (NOT {BIG}) AS inline, count(*) FILTER ({BIG}) AS external FROM {{facts}}")
def a3(s):
    return V.storage_counts(N.externalise(s.facts.drop("is_ref"))[0])


@query("a4_stats_by_shape", """
WITH k AS (SELECT target_type, key, regexp_replace(key, '[0-9]+', '[n]', 'g') AS shape, count(*) AS n FROM {facts} GROUP BY ALL)
SELECT target_type, CASE WHEN count(*) > 1 THEN shape ELSE min(key) END AS key, sum(n) AS n FROM k GROUP BY target_type, shape""")
def a4(s):
    return V.stats_by_shape(s.facts)


@query("a5_overview", "SELECT target_type, count(*) FILTER (NOT is_promised) AS keys, count(DISTINCT target_value) FILTER (NOT is_promised) AS targets, count(*) FILTER (is_promised) AS promised, count(*) AS total FROM {facts} GROUP BY target_type")
def a5(s):
    return V.overview(s.facts)


@query("a6_promised_by_type", "SELECT target_type, count(*) AS n FROM {facts} WHERE is_promised GROUP BY target_type")
def a6(s):
    return V.promised_by_type(s.facts)


@query("a7_timeline", f"""
WITH w AS (SELECT CASE WHEN last_ts < {NOW - 20 * WEEK} THEN -1 ELSE (last_ts - {NOW - 20 * WEEK}) // {WEEK} END AS week FROM {{facts}} WHERE last_ts < {NOW})
SELECT CAST(a.week AS INT) AS week, count(w.week) AS n FROM (SELECT unnest(range(-1, 20)) AS week) a LEFT JOIN w ON a.week = w.week GROUP BY ALL""")
def a7(s):
    return V.timeline(s.facts, NOW)


@query("a8_prune_counts", f"""
SELECT 'values' AS "table", count(*) AS before, count(*) FILTER (target_type = 'project' OR last_ts >= {NOW}) AS remaining FROM {{facts}}
UNION ALL SELECT 'log', count(*), count(*) FILTER (ts >= {NOW + 10**9}) FROM {{mut}} UNION ALL SELECT 'tombstones', count(*), count(*) FILTER (ts >= {NOW}) FROM {{tomb_local}}""")
def a8(s):
    return V.prune_counts({"values": (s.facts, "last_ts")}, NOW).unionByName(V.prune_counts({"log": (s.mut, "ts")}, NOW + 10**9)).unionByName(V.prune_counts({"tombstones": (s.tomb_local, "ts")}, NOW))


@query("a9_should_prune", FILES + """, n AS (SELECT count(DISTINCT CASE WHEN NOT contains(path, '/__tombstones/') THEN regexp_replace(path, '/(__value|__list/[^/]*|__set/[^/]*)$', '') END) AS keys,
  CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM files)
SELECT 'keys' AS rule, keys, bytes, keys > 500 AS prune FROM n UNION ALL SELECT 'size', keys, bytes, bytes > 500000 FROM n UNION ALL SELECT 'none', keys, bytes, FALSE FROM n""")
def a9(s):
    files, out = N.render_snapshot(_local(s)), None
    for name, most in (("keys", (500, None)), ("size", (None, 500_000)), ("none", (None, None))):
        row = V.should_prune(files, *most).withColumn("rule", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("a10_prune_stats", f"SELECT count(*) AS before, count(*) FILTER (last_ts >= {NOW}) AS after, count(*) FILTER (last_ts < {NOW}) AS dropped FROM {{facts}}")
def a10(s):
    return V.prune_stats(s.facts, s.facts.where(F.col("last_ts") >= NOW))


@query("a15_all_keys", f"SELECT DISTINCT {KC} FROM {{facts}} WHERE NOT is_promised")
def a15(s):
    return V.all_keys(s.facts)


@query("a14_nested_json", """
WITH f AS (SELECT target_value, key, value FROM {mut} WHERE op = 'set'), l AS (SELECT target_value, key, max(value) AS value FROM f GROUP BY ALL)
SELECT 'change-id' AS target_type, target_value, '{"profile":{' || string_agg('"' || substr(key, 9) || '":"' || value || '"', ',' ORDER BY '"' || substr(key, 9) || '":"' || value || '"') || CASE WHEN CAST(substr(target_value, 6) AS INT) % 2 = 0 THEN '},"x":{"__value":"1","y":"2"}}' ELSE '}}' END AS json FROM l GROUP BY target_value""")
def a14(s):
    f = s.mut.where("op = 'set'").groupBy(*K).agg(F.max("value").alias("value"))
    even = f.select("target_type", "target_value").distinct().where("cast(substr(target_value, 6) as int) % 2 = 0")
    extra = even.select("target_type", "target_value", F.lit("x").alias("key"), F.lit("1").alias("value")).unionByName(even.select("target_type", "target_value", F.lit("x:y").alias("key"), F.lit("2").alias("value")))
    return V.to_nested_json(f.unionByName(extra))


@query("a14_nested_authorship", """
WITH f AS (SELECT target_value, key, max(value) AS value FROM {mut} WHERE op = 'set' GROUP BY ALL),
l AS (SELECT target_value, key, arg_max(email, (ts, seq)) AS email, arg_max(ts, (ts, seq)) AS ts FROM {mut} GROUP BY ALL),
m AS (SELECT target_value, '"' || substr(key, 9) || '":{"value":"' || value || '","author":"' || email || '","timestamp":' || ts || '}' AS m FROM f JOIN l USING (target_value, key))
SELECT 'change-id' AS target_type, target_value, '{"profile":{' || string_agg(m, ',' ORDER BY m) || '}}' AS json FROM m GROUP BY target_value""")
def a14a(s):
    f = s.mut.where("op = 'set'").groupBy(*K).agg(F.max("value").alias("value"))
    return V.to_nested_json(f, log=s.mut)


@query("a14_nested_paths", """
WITH e AS (SELECT target_value, '"' || key || '":' || CAST(to_json(value) AS VARCHAR) AS m FROM {facts} WHERE target_type = 'path' AND NOT is_promised),
p AS (SELECT target_value, '"' || target_value || '":{' || string_agg(m, ',' ORDER BY m) || '}' AS m FROM e GROUP BY target_value)
SELECT 'path' AS target_type, split_part(target_value, '/', 1) AS target_value, '{' || string_agg(m, ',' ORDER BY m) || '}' AS json FROM p GROUP BY ALL""")
def a14p(s):
    """Facts of paths, an object for each directory at the top."""
    return V.to_nested_json(s.facts.where("target_type = 'path' and not is_promised"), fragments=True)


DEEP = "CASE WHEN seq % 2 = 0 THEN key || ':deep:er:' || op || ':k' || CAST(seq % 3 AS STRING) ELSE key END"


@query("f27_flatten_json", f"""
WITH w AS (SELECT target_value, {DEEP} AS key, max(value) AS value FROM {{mut}} WHERE op = 'set' GROUP BY ALL)
SELECT target_value, CASE WHEN EXISTS (SELECT 1 FROM w x WHERE x.target_value = w.target_value AND starts_with(x.key, w.key || ':')) THEN key || ':__value' ELSE key END AS key, value FROM w""")
def f27(s):
    """Keys of up to six segments back from their nested form; one that is leaf and parent has its value below."""
    f = s.mut.where("op = 'set'").withColumn("key", F.expr(DEEP)).groupBy(*K).agg(F.max("value").alias("value"))
    return V.flatten_json(V.to_nested_json(f), "json", ["target_value"])


@query("j1_facts_with_payload", f"SELECT {KC}, value_type, string_agg(value, '|' ORDER BY id, value) AS items FROM {{local}} GROUP BY {KC}, value_type")
def j1(s):
    values = F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: x["value"])
    return s.local.groupBy(*K, "value_type").agg(F.array_join(values, "|").alias("items"))


@query("j2_authorship", f"""
WITH l AS (SELECT {KC}, arg_max(email, (ts, seq)) AS email, max(ts) AS ts FROM {{mut}} WHERE seq % 3 = 0 GROUP BY ALL), k AS (SELECT DISTINCT {KC} FROM {{mut}})
SELECT {KC}, coalesce(email, 'unknown') AS author, coalesce(ts, 0) AS timestamp FROM k LEFT JOIN l USING ({KC})""")
def j2(s):
    return V.authorship(s.mut.select(*K).distinct(), s.mut.where("seq % 3 = 0"))


@query("j3_modified_since", f"""
WITH r AS (SELECT DISTINCT {KC}, op FROM {{mut}} WHERE ts > 1705000000000), v AS (SELECT {KC}, value FROM (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq DESC) AS n FROM {{mut}} WHERE value_type = 'string') x WHERE n = 1 AND op = 'set')
SELECT {KC}, op, coalesce(value, '') AS value FROM r LEFT JOIN v USING ({KC})""")
def j3(s):
    from factweave.operators.state import fold_strings

    return V.modified_since(s.mut, fold_strings(s.mut), 1_705_000_000_000)


@query("j5_log_view", """
WITH c AS (SELECT * FROM {commits} ORDER BY ts DESC, id LIMIT 200), f AS (SELECT target_value AS id, string_agg(key || '=' || value, ';' ORDER BY key || '=' || value) AS facts FROM {commit_facts} WHERE target_type = 'commit' GROUP BY ALL)
SELECT id, ts, coalesce(facts, '') AS facts, replace(message, chr(10) || chr(10), '|') AS head, 0 AS more FROM c LEFT JOIN f USING (id)""")
def j5(s):
    return V.log_view(s.commits, s.commit_facts, 200)


@query("o3_newest_with_facts", """
WITH c AS (SELECT * FROM {commits} WHERE id IN (SELECT target_value FROM {commit_facts} WHERE target_type = 'commit') ORDER BY ts DESC, id LIMIT 50) SELECT id, ts FROM c""")
def o3(s):
    return V.log_view(s.commits, s.commit_facts, 50, only_with_facts=True).select("id", "ts")


@query("j6_show_view", """
SELECT target_value AS id, 'commit' AS source, key, value FROM {commit_facts} WHERE target_type = 'commit'
UNION ALL SELECT c.id, 'change-id', key, value FROM {commit_facts} f JOIN {commits} c ON f.target_value = 'I' || c.o_orderkey WHERE target_type = 'change-id'""")
def j6(s):
    return V.show_view(s.commits, s.commit_facts)


BRANCHES = "SELECT DISTINCT value AS branch, 'pr:number' AS key, split_part(value, '#', 2) AS value FROM {commit_facts} WHERE key = 'branch-id' UNION ALL SELECT DISTINCT value, 'pr:author', 'a' || split_part(value, '#', 1) FROM {commit_facts} WHERE key = 'branch-id' AND right(value, 1) < '5'"


def _branch_facts(s):
    b = s.commit_facts.where("key = 'branch-id'").select(F.col("value").alias("branch")).distinct()
    number = b.select("branch", F.lit("pr:number").alias("key"), F.split("branch", "#")[1].alias("value"))
    return number.unionByName(b.where(F.right("branch", F.lit(1)) < "5").select("branch", F.lit("pr:author").alias("key"), F.concat(F.lit("a"), F.split("branch", "#")[0]).alias("value")))


@query("j7_annotate_lines", f"""
WITH bf AS ({BRANCHES}), w AS (SELECT branch, max(value) FILTER (key = 'pr:number') AS "pr:number", max(value) FILTER (key = 'pr:author') AS "pr:author" FROM bf GROUP BY branch)
SELECT file, line, commit_id, f.value AS branch, "pr:number" AS number, "pr:author" AS author FROM {{lines}} LEFT JOIN (SELECT * FROM {{commit_facts}} WHERE key = 'branch-id') f ON commit_id = target_value LEFT JOIN w ON w.branch = f.value""")
def j7(s):
    rows = V.annotate_lines(s.lines, s.commit_facts, _branch_facts(s), ["pr:number", "pr:author"])
    return rows.select("file", "line", "commit_id", "branch", F.col("`pr:number`").alias("number"), F.col("`pr:author`").alias("author"))


@query("n1_line_groups", """
WITH l AS (SELECT file, line, commit_id, coalesce(f.value, commit_id) AS identity FROM {lines} LEFT JOIN (SELECT * FROM {commit_facts} WHERE key = 'branch-id') f ON commit_id = target_value),
u AS (SELECT file, line, min(commit_id) AS commit_id, min(identity) AS identity FROM l GROUP BY file, line),
c AS (SELECT *, CASE WHEN lag(identity) OVER w = identity AND lag(line) OVER w + 1 = line THEN 0 ELSE 1 END AS cut FROM u WINDOW w AS (PARTITION BY file ORDER BY line)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY file ORDER BY line) AS run FROM c)
SELECT file, min(line) AS first, max(line) AS last, arg_min(identity, line) AS identity, arg_min(commit_id, line) AS commit_id FROM r GROUP BY file, run""")
def n1(s):
    rows = V.in_blocks(V.annotate_lines(s.lines, s.commit_facts)).withColumn("who", F.coalesce("branch", "commit_id"))
    one = rows.groupBy("file", "__block", "line").agg(F.min("commit_id").alias("commit_id"), F.min("who").alias("who"))
    return V.line_groups(one, F.col("who"))


@query("n6_first_seen", "SELECT value AS branch, value || '@' || min(ts) AS name FROM {commit_facts} WHERE key = 'branch-id' GROUP BY value")
def n6(s):
    return V.first_seen(s.commit_facts.where("key = 'branch-id'").select(F.col("value").alias("branch"), "ts"))


@query("n7_entry_index", f"SELECT {KC}, value, ts, row_number() OVER (PARTITION BY {KC} ORDER BY ts, value) - 1 AS idx FROM {{mut}} WHERE op = 'push' QUALIFY count(*) OVER (PARTITION BY {KC}, ts, value) = 1")
def n7(s):
    rows = s.mut.where("op = 'push'")
    return V.entry_index(rows).select(*K, "value", "ts", "idx")


@query("a12_branch_commit_stats", """
SELECT f.value AS branch, string_agg(DISTINCT author, ',' ORDER BY author) AS authors, array_to_string(list_sort(list(DISTINCT c.ts)), ',') AS times FROM {commits} c JOIN {commit_facts} f ON c.id = f.target_value WHERE key = 'branch-id' GROUP BY f.value""")
def a12(s):
    return V.branch_commit_stats(s.commits, s.commit_facts.where("key = 'branch-id'").select(F.col("target_value").alias("id"), F.col("value").alias("branch")))


@query("r1_prune_rules", f"""
WITH n AS (SELECT count(*) AS docs, count(DISTINCT lang) AS langs FROM {{documents}}), c AS (SELECT {NOW} - langs * 86400000 AS cutoff, docs AS max_keys, langs * 1024 AS max_size FROM n)
SELECT cutoff, max_keys, max_size, count(*) AS facts, count(*) FILTER (last_ts >= cutoff OR target_type = 'project') AS kept, count(*) > max_keys AS over FROM {{facts}}, c GROUP BY cutoff, max_keys, max_size""")
def r1(s):
    """Rules that stand among the facts, drawn from the documents, and what they mean for the facts."""
    n = s.documents.agg(F.count(F.lit(1)).cast("string").alias("docs"), F.count_distinct("lang").cast("string").alias("langs"))
    rules = n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("meta:prune:since", F.concat("langs", F.lit("d"))), ("meta:prune:max-keys", F.col("docs")), ("meta:prune:max-size", F.concat("langs", F.lit("k"))))))).alias("r"))
    found = R.prune_rules(s.facts.select(*K, "value").unionByName(rules.select(F.lit("project").alias("target_type"), F.lit("").alias("target_value"), "r.key", "r.value")), NOW)
    kept = R.prune_snapshot(s.facts, found["cutoff"], dry_run=True)
    named = kept.select((F.col("kept") + F.col("dropped")).alias("facts"), "kept").withColumns({k: F.lit(found[k]).cast("long") for k in ("cutoff", "max_keys", "max_size")})
    return named.withColumn("over", F.col("facts") > F.col("max_keys"))


@query("r2_auto_prune", "WITH " + ROUTE_RULES + f""", main AS (SELECT key FROM routed WHERE dest = 'main')
SELECT {KC}, 'value' AS part FROM {{facts}} JOIN main USING (key) WHERE target_type = 'project' OR last_ts >= {NOW} UNION ALL SELECT {KC}, 'entry' FROM {{local}} WHERE value_type = 'list' AND TRY_CAST(split_part(id, '-', 1) AS BIGINT) >= 1700005000000
UNION ALL SELECT {KC}, 'tombstone' FROM {{tomb_local}} WHERE ts >= 1510000000000""")
def r2(s):
    entries = s.local.where("value_type = 'list'").select(*K, F.substring_index("id", "-", 1).try_cast("long").alias("ts"))
    cut = F.when(F.col("key") == "chat:log", 1_700_005_000_000).when(F.col("key").startswith("doc:") & ~F.col("key").isin("doc:source", "doc:lang"), 1_510_000_000_000).otherwise(NOW)
    v, e, t = R.auto_prune(s.facts, entries, s.tomb_local, s.rules, cut)
    return v.select(*K, F.lit("value").alias("part")).unionByName(e.select(*K, F.lit("entry").alias("part"))).unionByName(t.select(*K, F.lit("tombstone").alias("part")))


@query("r3_prune_snapshot", f"SELECT count(*) FILTER (target_type = 'project' OR last_ts >= {NOW}) AS kept, count(*) FILTER (target_type <> 'project' AND last_ts < {NOW}) AS dropped FROM {{facts}}")
def r3(s):
    return R.prune_snapshot(s.facts, NOW, dry_run=True)


@query("r4_prune_local", f"""
SELECT 'values' AS part, count(*) AS n FROM {{facts}} WHERE target_type = 'project' OR last_ts >= {NOW}
UNION ALL SELECT 'entries', count(*) FROM {{facts}} WHERE (target_type = 'project' OR last_ts >= {NOW}) AND (target_type = 'project' OR last_ts + doc_id % 2 * 1000 - 500 >= {NOW})
UNION ALL SELECT 'tombstones', count(*) FROM {{tomb_local}} WHERE ts % 2 = 0 OR ts >= {NOW} UNION ALL SELECT 'log', count(*) FROM {{mut}} WHERE ts >= {NOW}""")
def r4(s):
    entries = s.facts.withColumn("ts", F.col("last_ts") + F.col("doc_id") % 2 * 1000 - 500)
    tombs = s.tomb_local.withColumn("tombstone_type", F.when(F.col("ts") % 2 == 0, "list_entry").otherwise("metadata"))
    parts = R.prune_local(s.facts, entries, tombs, s.mut, NOW)
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("r5_prune_files", FILES + """SELECT path, content FROM files WHERE NOT (regexp_matches(path, '/__list/[^/]*$') AND TRY_CAST(regexp_extract(path, '/__list/([0-9]+)-', 1) AS BIGINT) < 1700005000000)
  AND NOT (path LIKE '%/__deleted' AND TRY_CAST(regexp_extract(content, ':([0-9]+),', 1) AS BIGINT) < 1700005000000)""")
def r5(s):
    return R.prune_files(N.render_snapshot(_local(s)), 1_700_005_000_000)
