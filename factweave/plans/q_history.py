"""Queries of history, releases and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators import history as H
from factweave.operators import sessions as S
from factweave.operators.merge import K
from factweave.operators.shared import scratch, stored
from factweave.plans.registry import query
from factweave.sources.tables import read_transcripts

KC = "target_type, target_value, key"


def _commits(s):
    return s.commits.withColumn("parents", F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent")))


# each customer's commits are one chain: reachable from a tag is what comes before it in the chain
RELEASE = """
WITH o AS (SELECT id, o_custkey, message, row_number() OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) AS n FROM {commits}),
t AS (SELECT name, o_custkey, n, row_number() OVER (ORDER BY created, name) AS rank FROM {tags} JOIN o ON commit_id = id),
rel AS (SELECT o.id AS commit_id, message, arg_min(name, rank) AS tag FROM o JOIN t ON o.o_custkey = t.o_custkey AND o.n <= t.n GROUP BY ALL)
"""


@query("j10_release_of", RELEASE + "SELECT commit_id, tag FROM rel")
def j10(s):
    return H.release_of(_commits(s), s.tags)


@query("n5_previous_tags", "SELECT name, lag(name) OVER (ORDER BY created, name) AS previous FROM {tags}")
def n5(s):
    return H.previous_tags(s.tags)


@query("j11_propagate_release", RELEASE + """
SELECT DISTINCT 'commit' AS target_type, commit_id AS target_value, tag FROM rel UNION SELECT DISTINCT 'branch', value, tag FROM rel JOIN {commit_facts} ON target_value = commit_id AND key = 'branch-id'
UNION SELECT DISTINCT 'change-id', regexp_extract(message, 'Change-Id: (\\S+)', 1), tag FROM rel""")
def j11(s):
    c = _commits(s)
    return H.propagate_release(H.release_of(c, s.tags), c, s.commit_facts)


HISTORY = """
WITH h AS (SELECT DISTINCT CAST(substr(target_value, 6) AS INT) AS u, op, target_type, target_value, key FROM {mut} WHERE op IN ('set', 'rm', 'push')),
known AS (SELECT DISTINCT target_type, target_value, key FROM {mut} WHERE seq % 3 = 0),
n AS (SELECT target_type, target_value, key FROM h WHERE u <> 7 AND u % 10 <> 0 AND op <> 'rm' UNION SELECT target_type, target_value, key FROM {mut} WHERE CAST(substr(target_value, 6) AS INT) % 10 = 0 AND op IN ('set', 'rm', 'push', 'set_add') AND CAST(substr(target_value, 6) AS INT) <> 7)
"""


def _history(s):
    m = s.mut.where("op in ('set', 'rm', 'push')").withColumn("u", F.substring("target_value", 6, 9).cast("int"))
    line = F.concat_ws("\t", F.when(F.col("op") == "rm", "D").otherwise("M"), C.target_label("target_type", "target_value"), "key")
    body = m.groupBy("u").agg(F.array_join(F.collect_set(line), "\n").alias("body"))
    message = F.concat(F.lit("facts: update\n\n"), F.when(F.col("u") % 10 == 0, F.lit("changes-omitted: true")).otherwise(F.col("body")))
    return body.select(F.concat(F.lit("c"), F.col("u").cast("string")).alias("id"), F.array(F.lit("p")).alias("parents"), message.alias("message"))


@query("j9_history_index", HISTORY + f"SELECT {KC} FROM n ANTI JOIN known USING ({KC})")
def j9(s):
    keys = s.mut.where("op in ('set', 'rm', 'push', 'set_add')").select(F.concat(F.lit("c"), F.substring("target_value", 6, 9)).alias("id"), *K).distinct()
    return H.history_index(_history(s), "c7", s.mut.where("seq % 3 = 0"), keys)


@query("r6_rebuild_keys", HISTORY + f"SELECT count(*) AS n, count(DISTINCT target_value) AS targets FROM (SELECT {KC} FROM n ANTI JOIN known USING ({KC})) x")
def r6(s):
    return j9(s).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_value").alias("targets"))


@query("a16_index_summary", """
WITH h AS (SELECT DISTINCT CAST(substr(target_value, 6) AS INT) AS u, CASE op WHEN 'rm' THEN 'D' ELSE 'M' END AS st, target_type, target_value, key FROM {mut} WHERE op IN ('set', 'rm', 'push')),
k AS (SELECT DISTINCT target_type, target_value, key FROM {mut} WHERE seq % 3 = 0), l AS (SELECT * FROM h WHERE u <> 7 AND u % 10 <> 0), d AS (SELECT DISTINCT target_type, target_value, key FROM l WHERE st <> 'D')
SELECT (SELECT count(DISTINCT u) FROM h WHERE u <> 7) AS versions, (SELECT count(DISTINCT u) FROM h WHERE u % 10 = 0) AS omitted, (SELECT count(DISTINCT u) FROM l) AS listed, (SELECT count(*) FROM l WHERE st = 'D') AS deletes,
  (SELECT count(*) FROM d ANTI JOIN k USING (target_type, target_value, key)) AS inserted, (SELECT count(*) FROM d SEMI JOIN k USING (target_type, target_value, key)) AS already_known""")
def a16(s):
    return H.index_summary(_history(s), "c7", s.mut.where("seq % 3 = 0"))


@query("a16_export_summary", "SELECT value_type AS kind, count(*) AS files, count(DISTINCT target_value) AS targets FROM {local} GROUP BY value_type")
def a16e(s):
    return s.local.groupBy(F.col("value_type").alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("target_value").alias("targets"))


@query("j8_hydrate", f"""
WITH p AS (SELECT DISTINCT {KC} FROM {{base}}), i AS (SELECT {KC}, value_type, string_agg(value, '|' ORDER BY id, value) AS value FROM {{remote}} GROUP BY ALL)
SELECT {KC}, value_type, value, value_type IS NOT NULL AS found FROM p LEFT JOIN i USING ({KC})""")
def j8(s):
    return H.hydrate(s.base, s.remote)


PAIRS = """
WITH o AS (SELECT id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) AS n FROM {commits}),
e AS (SELECT o_custkey, arg_max(id, n) AS last, arg_min(id, n) AS first, max(n) AS len FROM o GROUP BY o_custkey)
"""


@query("j19_merge_strategies", PAIRS + """
SELECT CAST(o_custkey AS VARCHAR) AS pair, CASE o_custkey % 6 WHEN 3 THEN 'two-way' WHEN 4 THEN 'fast-forward' WHEN 5 THEN 'three-way' WHEN 0 THEN 'up-to-date' ELSE CASE WHEN len = 1 THEN 'up-to-date' WHEN o_custkey % 6 = 1 THEN 'fast-forward' ELSE 'three-way' END END AS strategy,
  CASE WHEN o_custkey % 6 = 2 AND len > 1 THEN first WHEN o_custkey % 6 = 5 THEN last END AS base FROM e""")
def j19(s):
    """Every customer's chain: both heads at its end, one behind, none local, another history, or two
    merges, l and r, of its first commit with its last, which is the better base but further away."""
    c = _commits(s)
    e = c.groupBy("o_custkey").agg(F.max_by("id", F.struct("ts", "o_orderkey")).alias("last"), F.min_by("id", F.struct("ts", "o_orderkey")).alias("first")).withColumn("pair", F.col("o_custkey").cast("string"))
    e = stored(e, "ends")
    m = F.col("o_custkey") % 6
    name = lambda x: F.concat(F.lit(x), "pair")
    local = F.when(m == 1, F.col("first")).when(m == 4, F.lit(None)).when(m == 5, name("l")).otherwise(F.col("last"))
    remote = F.when(m == 2, F.col("first")).when(m == 3, F.lit("elsewhere")).when(m == 5, name("r")).otherwise(F.col("last"))
    made = F.array(*(F.struct(a.alias("id"), b.alias("parent")) for a, b in ((name("l"), F.col("first")), (name("l"), name("x")), (name("x"), F.col("last")), (name("r"), F.col("first")), (name("r"), F.col("last")))))
    edges = H.edges_of(c).unionByName(e.where(m == 5).select(F.explode(made).alias("e")).select("e.*"))
    return H.merge_strategies(edges, e.select("pair", local.alias("local"), remote.alias("remote")))


@query("j20_new_versions", PAIRS + "SELECT CAST(o_custkey AS VARCHAR) AS pair, len - 1 AS n FROM e")
def j20(s):
    """From each customer's first commit to its last."""
    c = _commits(s)
    ends = c.groupBy(F.col("o_custkey").cast("string").alias("pair")).agg(F.min_by("id", F.struct("ts", "o_orderkey")).alias("old"), F.max_by("id", F.struct("ts", "o_orderkey")).alias("new"))
    return H.new_versions_each(H.edges_of(c), ends)


@query("j20_are_ancestors", PAIRS + "SELECT CAST(o_custkey AS VARCHAR) AS pair, TRUE AS up, len = 1 AS down FROM e")
def j20a(s):
    """Each customer's last commit reaches the first; the other way only where they are one."""
    c = _commits(s)
    ends = c.groupBy(F.col("o_custkey").cast("string").alias("pair")).agg(F.min_by("id", F.struct("ts", "o_orderkey")).alias("old"), F.max_by("id", F.struct("ts", "o_orderkey")).alias("new"))
    way = lambda name, old, new: F.struct(F.concat("pair", F.lit(name)).alias("pair"), F.col(old).alias("old"), F.col(new).alias("new"))
    both = ends.select(F.inline(F.array(way("u", "old", "new"), way("d", "new", "old"))))
    got = H.are_ancestors(H.edges_of(c), both).select(F.expr("substring(pair, 1, length(pair) - 1)").alias("p"), F.right("pair", F.lit(1)).alias("way"), "is_ancestor")
    return got.groupBy(F.col("p").alias("pair")).agg(F.max(F.when(F.col("way") == "u", F.col("is_ancestor"))).alias("up"), F.max(F.when(F.col("way") == "d", F.col("is_ancestor"))).alias("down"))


@query("a11_summarise_sessions", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg(DISTINCT role, ',' ORDER BY role) FILTER (role <> 'system') AS models, string_agg(DISTINCT 't' || turn % 2, ',' ORDER BY 't' || turn % 2) AS tools, sum(length(text)) AS input_tokens, sum(turn) AS output_tokens,
  count(*) AS messages, min(ts) AS start_ts, max(ts) AS end_ts, (max(ts) - min(ts)) // 1000 AS seconds FROM {chat} GROUP BY conv_id HAVING count(*) >= 2""")
def a11(s):
    model = F.when(F.col("role") == "system", "<synthetic>").otherwise(F.col("role"))
    return S.summarise_sessions(s.chat.select(F.col("conv_id").cast("string").alias("session_id"), "ts", model.alias("model"), F.array(F.concat(F.lit("t"), (F.col("turn") % 2).cast("string"))).alias("tools"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens")))


@query("a11_from_transcripts", """
SELECT 'c' || conv_id AS session_id, CASE WHEN bool_or(role = 'assistant') THEN 'm1' ELSE '' END AS models, CASE WHEN bool_or(role = 'assistant') THEN 'Edit' ELSE '' END AS tools,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS input_tokens, sum(CASE WHEN role = 'assistant' THEN turn ELSE 0 END) AS output_tokens,
  sum(CASE role WHEN 'assistant' THEN 1 ELSE 0 END + CASE WHEN role <> 'system' AND trim(text) <> '' THEN 1 ELSE 0 END)::BIGINT AS messages, min(ts // 1000 * 1000) AS start_ts, max(ts // 1000 * 1000) AS end_ts, (max(ts // 1000) - min(ts // 1000)) AS seconds
FROM {chat} GROUP BY conv_id HAVING messages >= 2""")
def a11t(s):
    """Transcript files written, read back and summed up: the assistant's lines hold a text and a tool."""
    block = lambda **f: F.struct(*(F.lit(None).cast("string").alias(c) if v is None else v.alias(c) for c, v in f.items()))
    blocks = F.to_json(F.array(block(type=F.lit("text"), text=F.col("text"), name=None), block(type=F.lit("tool_use"), text=None, name=F.lit("Edit"))))
    message = F.struct(F.lit("m1").alias("model"), F.struct(F.length("text").cast("long").alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage"), F.when(F.col("role") == "assistant", blocks).otherwise(F.col("text")).alias("content"))
    at = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sessionId"), F.col("role").alias("type"), at.alias("timestamp"), message.alias("message")))
    path = scratch(s.spark, "transcripts")
    s.chat.select(line.alias("value")).write.text(path)
    return S.summarise_transcripts(read_transcripts(s.spark, path))


RANGE = """
WITH m AS (SELECT s.user_id, s.sid, p.id, p.assisted, s.user_id = p.user_id AS same_author FROM {sessions} s JOIN {purchases} p ON p.ts BETWEEN s.start_ts - 60000 AND s.end_ts + 300000 WHERE p.assisted OR s.user_id = p.user_id),
a AS (SELECT * FROM (SELECT s.user_id, s.sid, p.id, row_number() OVER (PARTITION BY s.user_id, s.sid ORDER BY p.ts, p.id) AS n FROM {sessions} s JOIN {purchases} p ON s.user_id = p.user_id AND p.ts >= s.end_ts AND p.ts - s.end_ts < 3600000) x WHERE n = 1),
o AS (SELECT DISTINCT t.out_id, t.user_id, t.sid, c.id FROM {outputs} t JOIN {purchases} c ON contains(result, substr(c.id, 1, 7)))
"""


@query("j12_range_matches", RANGE + "SELECT user_id, sid, id, assisted, same_author FROM m")
def j12(s):
    return S.range_matches(s.sessions, s.purchases).drop("ts")


@query("j13_output_matches", RANGE + "SELECT DISTINCT out_id, id FROM o")
def j13(s):
    return S.output_matches(s.outputs, s.purchases)


@query("j14_asof_fallback", RANGE + "SELECT user_id, sid, id FROM a")
def j14(s):
    return S.asof_fallback(s.sessions, s.purchases)


PRIORITY = RANGE[:-1] + """,
r AS (SELECT user_id, sid, id, 1 AS n, 'output' AS strategy FROM o UNION ALL SELECT user_id, sid, id, 2, 'assisted' FROM m WHERE assisted UNION ALL SELECT user_id, sid, id, 3, 'author' FROM m WHERE same_author),
p AS (SELECT user_id, sid, id, arg_min(strategy, n) AS strategy FROM r GROUP BY ALL UNION ALL SELECT user_id, sid, id, 'fallback' FROM a ANTI JOIN r USING (user_id, sid))
"""


@query("j15_by_priority", PRIORITY + "SELECT user_id, sid, id, strategy FROM p")
def j15(s):
    return S.find_commits(s.sessions, s.purchases, s.outputs)


@query("j16_attach", PRIORITY + """, c AS (SELECT id, CASE WHEN k % 2 = 0 THEN 'I' || event_id END AS change_id, k FROM {purchases})
SELECT DISTINCT CASE WHEN change_id IS NULL THEN 'commit' ELSE 'change-id' END AS target_type, coalesce(change_id, p.id) AS target_value, user_id, sid FROM p JOIN c ON p.id = c.id WHERE k % 5 <> 1 OR k % 2 = 0""")
def j16(s):
    ids = s.purchases.where("k % 2 = 0").select("id", F.concat(F.lit("I"), F.col("event_id").cast("string")).alias("change_id"))
    tagged = s.purchases.where("k % 5 = 1").select(F.lit("commit").alias("target_type"), F.col("id").alias("target_value"))
    return S.attach_found(s.sessions, s.purchases, s.outputs, ids, tagged)


@query("j17_untagged", "SELECT id, ts FROM {commits} WHERE o_orderkey % 4 = 0 ORDER BY ts DESC, id LIMIT 100")
def j17(s):
    return S.untagged(s.commits, s.commit_facts, "branch-id", 100).select("id", "ts")


@query("j18_not_imported", "SELECT id FROM {commits} WHERE id NOT IN (SELECT target_value FROM {commit_facts} WHERE target_type = 'commit')")
def j18(s):
    done = s.commit_facts.where("target_type = 'commit'").select(F.lit("import:id").alias("key"), F.col("target_value").alias("value"))
    return S.not_imported(s.commits, done, "id", "import:id").select("id")


@query("n8_since_attachment", """
SELECT event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM {ev}""")
def n8(s):
    return S.since_attachment(s.ev, F.col("event_type") == "purchase").select("event_id", "part")
