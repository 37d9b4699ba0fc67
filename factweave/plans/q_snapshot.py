"""Queries of reading, routing, rendering and parsing."""

from __future__ import annotations


from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators import filters as P
from factweave.operators import snapshot as N
from factweave.operators.merge import K, Snapshot
from factweave.operators.shared import scratch
from factweave.operators.versions import Store
from factweave.plans.q_scalars import BASE
from factweave.plans.registry import query
from factweave.sources import tables

KC = "target_type, target_value, key"


def _local(s) -> Snapshot:
    e, m = s.entry_tombs, s.member_tombs
    return Snapshot(s.local, s.tomb_local, m.where("side = 'local'").drop("side"), e.where("side = 'local'").drop("side"))


FILES = f"""
WITH v AS (SELECT *, replace(key, ':', '/') AS k, {BASE} AS base FROM {{local}}),
t AS (SELECT *, replace(key, ':', '/') AS k, {BASE} AS base FROM {{tomb_local}}),
e AS (SELECT *, replace(key, ':', '/') AS k, {BASE} AS base FROM {{entry_tombs}} WHERE side = 'local'),
m AS (SELECT *, replace(key, ':', '/') AS k, {BASE} AS base FROM {{member_tombs}} WHERE side = 'local'),
files AS (SELECT {KC}, base || '/' || k || CASE value_type WHEN 'string' THEN '/__value' WHEN 'list' THEN '/__list/' || id ELSE '/__set/' || id END AS path, value AS content FROM v
  UNION ALL SELECT {KC}, base || '/__tombstones/' || k || '/__deleted', '{{"timestamp":' || ts || ',"email":"' || email || '"}}' FROM t
  UNION ALL SELECT {KC}, base || '/' || k || '/__list/__tombstones/' || id, '{{"timestamp":' || ts || ',"email":"' || email || '"}}' FROM e
  UNION ALL SELECT {KC}, base || '/' || k || '/__tombstones/' || id, value FROM m)
"""


@query("s1_read_state", f"""
WITH l AS (SELECT {KC}, value_type, string_agg(value, '|' ORDER BY ts, value) AS v FROM (SELECT {KC}, value_type, value, CAST(split_part(id, '-', 1) AS BIGINT) AS ts FROM {{local}} WHERE value_type = 'list') x GROUP BY ALL),
m AS (SELECT {KC}, value_type, string_agg(value, '|' ORDER BY value) AS v FROM {{local}} WHERE value_type = 'set' GROUP BY ALL)
SELECT {KC}, value_type, v AS items, '' AS value FROM l UNION ALL SELECT {KC}, value_type, v, '' FROM m UNION ALL SELECT {KC}, value_type, NULL, value FROM {{local}} WHERE value_type = 'string'""")
def s1(s):
    v = s.local
    heads = v.where("value_type <> 'string'").select(*K, "value_type").distinct().withColumn("value", F.lit("")).unionByName(v.where("value_type = 'string'").select(*K, "value_type", "value"))
    rows = tables.read_state(heads.withColumn("is_promised", F.lit(False)), v.where("value_type = 'list'").select(*K, "value", C.entry_ts("id").alias("ts")), v.where("value_type = 'set'").select(*K, "value"))
    return rows.select(*K, "value_type", F.array_join("items", "|").alias("items"), "value")


@query("s2_read_mutations", "SELECT seq, target_type, target_value, key, op, value, value_type, email, ts FROM {mut} WHERE op <> 'rm'")
def s2(s):
    store = scratch(s.spark, "store")
    tables.write_table(s.mut, store, "mutations")
    return tables.read_mutations(s.spark, store).where("op <> 'rm'").drop("idx")


@query("s3_all_facts", f"SELECT {KC}, value FROM {{facts}} WHERE NOT is_promised")
def s3(s):
    return P.all_facts(s.facts).select(*K, "value").orderBy("target_value", "key")


ALL_TOMBS = "SELECT 'metadata' AS tombstone_type, target_type, target_value, key, '' AS id, ts FROM {tomb_local} UNION ALL SELECT 'list_entry', target_type, target_value, key, id, ts FROM {entry_tombs} WHERE side = 'local'"


@query("s4_tombstones", "SELECT target_type, target_value, key, id, ts FROM {entry_tombs} WHERE side = 'local'")
def s4(s):
    every = s.tomb_local.select(F.lit("metadata").alias("tombstone_type"), *K, F.lit("").alias("id"), "ts").unionByName(s.entry_tombs.where("side = 'local'").select(F.lit("list_entry").alias("tombstone_type"), *K, "id", "ts"))
    return P.tombstones_of(every, "list_entry").drop("tombstone_type")


def _parse(s):
    return N.parse_snapshot(N.render_snapshot(_local(s)))


@query("s5_parse_values", "SELECT target_type, target_value, key, value_type, id, value FROM {local}")
def s5(s):
    """Import of an export: the values come back."""
    return _parse(s).values


@query("s5_parse_tombstones", f"""
SELECT {KC}, '' AS id, 'key' AS kind, CAST(ts AS VARCHAR) || email AS content FROM {{tomb_local}} ANTI JOIN {{local}} USING ({KC})
UNION ALL SELECT {KC}, id, 'list', CAST(ts AS VARCHAR) || email FROM (SELECT * FROM {{entry_tombs}} WHERE side = 'local') e ANTI JOIN {{local}} USING ({KC}, id)
UNION ALL SELECT {KC}, id, 'set', value FROM (SELECT * FROM {{member_tombs}} WHERE side = 'local') m ANTI JOIN {{local}} USING ({KC}, id)""")
def s5t(s):
    p = _parse(s)
    both = F.concat(F.col("ts").cast("string"), "email")
    rows = p.tombstones.select(*K, F.lit("").alias("id"), F.lit("key").alias("kind"), both.alias("content")).unionByName(p.list_tombstones.select(*K, "id", F.lit("list").alias("kind"), both.alias("content")))
    return rows.unionByName(p.set_tombstones.select(*K, "id", F.lit("set").alias("kind"), F.col("value").alias("content")))


@query("s6_render_snapshot", FILES + "SELECT path, content FROM files")
def s6(s):
    return N.render_snapshot(_local(s)).select("path", "content")


@query("s7_render_incremental", FILES + """, dirty AS (SELECT DISTINCT target_type, target_value FROM {chat} WHERE conv_id % 3 = 0),
old AS (SELECT target_type, target_value, path, content || '?' AS content FROM files)
SELECT path, content FROM old ANTI JOIN dirty USING (target_type, target_value) UNION ALL SELECT path, content FROM files SEMI JOIN dirty USING (target_type, target_value)""")
def s7(s):
    """A version of all files, then one that follows it with the touched targets as they are now."""
    now = _local(s)
    store = Store(s.spark, scratch(s.spark, "versions"), buckets=16, leaves=1 << 6)
    store.write(N.render_snapshot(now).withColumn("content", F.concat("content", F.lit("?"))), "old")
    touched = s.chat.select("target_type", "target_value", F.when(F.col("conv_id") % 3 == 0, 10).otherwise(1).alias("ts"))
    N.export_incremental(store, "old", "new", now, touched, 5)
    return store.read("new").select("path", "content")


ROUTE_RULES = r"""
r AS (SELECT * FROM (VALUES (2, 'quality', '^label:'), (2, 'audit', '^label:'), (4, 'texts', '^text:[^:]*$'), (5, 'config', '^meta(:|$)'), (5, 'audit', '^meta(:|$)')) v(n, dest, re)),
k AS (SELECT DISTINCT key FROM {facts} WHERE key <> 'label:toxic' AND NOT starts_with(key, 'meta:local:')),
routed AS (SELECT DISTINCT key, coalesce(dest, 'main') AS dest FROM k LEFT JOIN r ON regexp_matches(key, re))
"""


@query("s8_write_routed", "WITH " + ROUTE_RULES + "SELECT dest, count(*) AS n, count(DISTINCT key) AS keys FROM {facts} JOIN routed USING (key) GROUP BY dest")
def s8(s):
    path = scratch(s.spark, "routed")
    N.write_routed(P.route(s.facts, s.rules), path)
    return s.spark.read.parquet(path).groupBy("dest").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


@query("s9_is_unchanged", "SELECT count(*) > 0 AS same, count(*) = 0 AS other FROM {local}")
def s9(s):
    """The same files once more make no version; fewer do, and its manifest tells."""
    files = N.render_snapshot(_local(s))
    store = Store(s.spark, scratch(s.spark, "versions"), buckets=16, leaves=1 << 6)
    store.write(files, "one")
    again = store.follow("one", "again", files, files.repartition("path"))
    store.follow("one", "other", files, files.where("content <> 'user'"))
    same = not again and not store.exists("again")
    return s.spark.createDataFrame([(same, store.exists("other") and store.unchanged("one", "other"))], "same boolean, other boolean")


SINCE = 1_706_000_000_000


LINES = f"WITH c AS (SELECT DISTINCT email, CASE op WHEN 'rm' THEN 'D' ELSE 'M' END AS status, target_type || ':' || target_value AS target, key FROM {{mut}} WHERE ts > {SINCE}), l AS (SELECT email, status || chr(9) || target || chr(9) || key AS line FROM c)"
BODY = "CASE WHEN count(*) > {most} THEN 'changes-omitted: true' || chr(10) || 'count: ' || count(*) ELSE string_agg(line, chr(10) ORDER BY line) END AS body"


@query("s10_change_manifests", LINES + f"SELECT email, {BODY.format(most=350)} FROM l GROUP BY email")
def s10s(s):
    """Each author's changes; those of some are too many for a list at the larger sizes."""
    return N.change_manifests(s.mut, SINCE, True, ["email"], most=350)


@query("s10_change_manifest", LINES + f"SELECT {BODY.format(most=1000)} FROM (SELECT DISTINCT line FROM l) x")
def s10(s):
    return N.change_manifest(s.mut, SINCE, True)


@query("s10_change_rows", f"SELECT DISTINCT CASE op WHEN 'rm' THEN 'D' WHEN 'set' THEN 'A' ELSE 'M' END AS status, target_type || ':' || target_value AS target, key FROM {{mut}} WHERE ts > {SINCE}")
def s10r(s):
    return N.change_rows(s.mut, SINCE, False)


@query("s11_parse_manifests", """
SELECT 'c' || user_id AS id, CASE op WHEN 'rm' THEN 'D' ELSE 'M' END AS status, target_type || ':' || target_value AS target, key
FROM (SELECT DISTINCT CAST(substr(target_value, 6) AS INT) AS user_id, op, target_type, target_value, key FROM {mut} WHERE op IN ('set', 'rm')) x WHERE user_id % 5 > 1""")
def s11(s):
    m = s.mut.where("op in ('set', 'rm')").withColumn("u", F.substring("target_value", 6, 9).cast("int"))
    line = F.concat_ws("\t", F.when(F.col("op") == "rm", "D").otherwise("M"), C.target_label("target_type", "target_value"), "key")
    body = m.groupBy("u").agg(F.array_join(F.collect_set(line), "\n").alias("body"))
    head = F.when(F.col("u") % 5 == 0, "other: x\n\n").when(F.col("u") % 5 == 1, "facts: update\n\nchanges-omitted: true\n").otherwise("facts: update (9 changes)\n\nbad line\n")
    return N.parse_manifests(body.select(F.concat(F.lit("c"), F.col("u").cast("string")).alias("id"), F.concat(head, "body").alias("message")))


BIG = "octet_length(encode(value)) > 1024"


@query("s17_externalise", f"""
SELECT {KC}, {BIG} AS is_ref, CASE WHEN {BIG} THEN sha1('blob ' || octet_length(encode(value)) || chr(0) || value) ELSE value END AS stored, value AS back FROM {{facts}}""")
def s17(s):
    out, blobs = N.externalise(s.facts.select(*K, "value"))
    both = out.withColumn("stored", F.col("value"))
    return N.resolve(both, blobs).select(*K, "is_ref", "stored", F.col("value").alias("back"))


@query("s19_transcript_to_list", """
WITH o AS (SELECT conv_id, text, min(ts) OVER (PARTITION BY conv_id) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ts FROM {chat})
SELECT conv_id, ts, text AS value, ts || '-' || substr(sha1(text), 1, 5) AS id FROM o""")
def s19(s):
    return N.transcript_to_list(s.chat, ["conv_id"], F.col("turn"), F.col("ts"), "text")


@query("p1_get", f"SELECT {KC}, value FROM {{facts}} WHERE target_value LIKE 'src1/%' AND key = 'doc:lang'")
def p1(s):
    """Each target of one source looked up by target and key."""
    asked = s.documents.where("source = 'src1'").select(F.lit("path").alias("target_type"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("target_value"), F.lit("doc:lang").alias("key"))
    return P.get_each(s.facts, asked).select(*K, "value")


@query("p1_get_one", f"SELECT {KC}, value FROM {{facts}} WHERE target_type = 'project' AND key = 'meta:note:n1'")
def p1_one(s):
    return P.get(s.facts, "project", "", "meta:note:n1").select(*K, "value")


@query("p2_get_all", f"SELECT {KC}, value FROM {{facts}} WHERE key = 'label' OR starts_with(key, 'label:')")
def p2(s):
    return s.facts.where(P.key_prefix("label")).select(*K, "value")


@query("p3_get_subtree", f"SELECT {KC}, value FROM {{facts}} WHERE starts_with(target_value, 'src1/en/') AND starts_with(key, 'doc:')")
def p3(s):
    return P.get_subtree(s.facts, "src1/en", "doc").select(*K, "value")


@query("p4_visible", f"SELECT {KC}, value FROM {{facts}} WHERE NOT is_promised")
def p4(s):
    return P.visible(s.facts).select(*K, "value")


@query("p5_fuzzy", f"SELECT {KC} FROM {{facts}} WHERE target_type = 'path' AND (lower(target_value) LIKE '%s%1%d%e%' OR lower(key) LIKE '%s%1%d%e%' OR lower(value) LIKE '%s%1%d%e%')")
def p5(s):
    return P.fuzzy(s.facts, "path", "s1De").select(*K)


@query("p6_classify", "WITH " + ROUTE_RULES + "SELECT key, dest FROM routed")
def p6(s):
    return P.classify(s.facts, s.rules)


@query("p7_classify_tombstones", f"SELECT kind, {KC}, id FROM (SELECT 'key' AS kind, {KC}, '' AS id FROM {{tomb_local}} UNION ALL SELECT 'list', {KC}, id FROM {{entry_tombs}} UNION ALL SELECT 'set', {KC}, id FROM {{member_tombs}}) x")
def p7(s):
    t = s.tomb_local.select(F.lit("key").alias("kind"), *K, F.lit("").alias("id")).unionByName(s.entry_tombs.select(F.lit("list").alias("kind"), *K, "id")).unionByName(s.member_tombs.select(F.lit("set").alias("kind"), *K, "id"))
    return P.route(t, s.rules).where("dest = 'main'").drop("dest")


@query("p8_retain", f"SELECT {KC} FROM {{facts}} WHERE target_type = 'project' OR last_ts >= 1700900000000")
def p8(s):
    return P.retain(s.facts, 1_700_900_000_000).select(*K)


@query("p9_since_filter", "SELECT id FROM {commits} WHERE ts >= 830000000")
def p9(s):
    return P.since_filter(s.commits, 830_000_000).select("id")


@query("p10_config", f"SELECT {KC}, value FROM {{facts}} WHERE target_type = 'project' AND starts_with(key, 'meta:')")
def p10(s):
    return P.config(s.facts).select(*K, "value")


@query("m16_diff_snapshots", f"""
WITH a AS (SELECT {BASE} || '/' || replace(key, ':', '/') AS path, value FROM {{base}} WHERE value_type = 'string'), b AS (SELECT {BASE} || '/' || replace(key, ':', '/') AS path, value FROM {{local}} WHERE value_type = 'string')
SELECT path || '/__value' AS path, CASE WHEN a.value IS NULL THEN 'A' WHEN b.value IS NULL THEN 'D' ELSE 'M' END AS status FROM a FULL JOIN b USING (path) WHERE a.value IS DISTINCT FROM b.value""")
def m16(s):
    """Two versions in a store, compared by their digests."""
    files = lambda v: N.render_snapshot(Snapshot(v.where("value_type = 'string'")))
    store = Store(s.spark, scratch(s.spark, "versions"), buckets=16, leaves=1 << 6)
    store.write(files(s.base), "base")
    store.write(files(s.local), "local")
    return store.diff("base", "local")


@query("m16_import_changes", f"SELECT {KC}, value_type, id, value FROM {{remote}}")
def m16i(s):
    """The base state takes over what changed from its version to the remote one."""
    store = Store(s.spark, scratch(s.spark, "versions"), buckets=16, leaves=1 << 6)
    store.write(N.render_snapshot(Snapshot(s.base, s.tomb_base)), "base")
    store.write(N.render_snapshot(Snapshot(s.remote, s.tomb_remote)), "remote")
    return N.apply_changes(s.base, store.diff("base", "remote", contents=True))


@query("j4_expand_targets", """
WITH t AS (SELECT DISTINCT target_type, target_value FROM {facts}), p AS (SELECT DISTINCT substr(target_value, 1, 9) AS prefix FROM t WHERE target_type = 'path'),
h AS (SELECT prefix, target_value, row_number() OVER (PARTITION BY prefix ORDER BY target_value) AS n, least(2, count(*) OVER (PARTITION BY prefix)) AS matches FROM t JOIN p ON starts_with(target_value, prefix) WHERE target_type = 'path')
SELECT 'path' AS kind, prefix, target_value, matches FROM h WHERE n <= 2""")
def j4(s):
    prefixes = s.facts.where("target_type = 'path'").select(F.lit("path").alias("kind"), F.substring("target_value", 1, 9).alias("prefix")).distinct()
    return P.expand_targets(s.facts, prefixes)
