"""Queries of the folds over the mutation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import state as S
from factweave.operators.state import K
from factweave.plans.registry import query

KC = "target_type, target_value, key"
SETS = """SELECT seq, target_type, target_value, 'tags:all' AS key, 'set' AS op, 'set' AS value_type, '["' || value || '","k' || CAST(seq % 3 AS STRING) || '","k1"]' AS value, CAST(NULL AS INT) AS idx, email, ts FROM {mut} WHERE op = 'set_add'"""
LISTS = """SELECT seq, target_type, target_value, 'notes:l' AS key, CASE WHEN op = 'set' THEN 'set' ELSE 'push' END AS op, 'list' AS value_type,
  CASE WHEN op = 'set' THEN '[{"value":"a' || CAST(seq AS STRING) || '","timestamp":' || CAST(ts AS STRING) || '},{"value":"b","timestamp":' || CAST(ts - 5 AS STRING) || '}]' ELSE value END AS value, CAST(NULL AS INT) AS idx, email, ts FROM {mut} WHERE op IN ('set', 'push')"""


def _sql(s, text: str):
    escaped = text.replace("{mut}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{mut}")
    return s.spark.sql(escaped, mut=s.mut)


@query("w1_fold_strings", f"""SELECT {KC}, value, ts AS last_ts, email FROM (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq DESC) AS n FROM {{mut}} WHERE value_type = 'string') x WHERE n = 1 AND op = 'set'""")
def w1(s):
    return S.fold_strings(s.mut)


@query("w2_fold_list_set", f"""
WITH l AS ({LISTS}), c AS (SELECT *, max(seq) FILTER (op = 'set') OVER (PARTITION BY {KC}) AS cut FROM l),
e AS (SELECT {KC}, seq, 0 AS pos, CASE WHEN op = 'set' THEN 'a' || seq ELSE value END AS value, ts FROM c WHERE cut IS NULL OR seq >= cut
  UNION ALL SELECT {KC}, seq, 1, 'b', ts - 5 FROM c WHERE op = 'set' AND seq = cut),
n AS (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq, pos) AS n FROM e)
SELECT {KC}, value, max(ts - n) OVER (PARTITION BY {KC} ORDER BY n) + n AS ts FROM n""")
def w2(s):
    return S.fold_list_set(_sql(s, LISTS))


SETS_CTE = f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n, count(*) OVER (PARTITION BY {KC}) AS last FROM ({SETS}) x),
m AS (SELECT DISTINCT {KC}, n, last, ts, unnest(CAST(value AS JSON)::VARCHAR[]) AS value FROM w),
i AS (SELECT *, n - row_number() OVER (PARTITION BY {KC}, value ORDER BY n) AS g FROM m),
r AS (SELECT {KC}, value, g, min(ts) AS since, max(n) AS n, max(last) AS last FROM i GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KC}, value ORDER BY n DESC) AS k FROM r) y WHERE k = 1)
"""


@query("w3_fold_set_set", SETS_CTE + f"""SELECT {KC}, value, since AS ts, 'member' AS part FROM f WHERE n = last
UNION ALL SELECT f.target_type, f.target_value, f.key, f.value, w.ts, 'tombstone' FROM f JOIN w ON f.target_type = w.target_type AND f.target_value = w.target_value AND f.key = w.key AND w.n = f.n + 1 WHERE f.n < f.last""")
def w3(s):
    live, dead = S.fold_set_set(_sql(s, SETS))
    return live.withColumn("part", F.lit("member")).unionByName(dead.drop("email").withColumn("part", F.lit("tombstone")))


@query("w4_fold_list_push", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n FROM {{mut}} WHERE op = 'push')
SELECT {KC}, value, max(ts - n) OVER (PARTITION BY {KC} ORDER BY n) + n AS ts FROM n""")
def w4(s):
    return S.fold_list_push(s.mut)


@query("w5_push_onto_string", f"""
WITH a AS (SELECT seq, target_type, target_value, 'mixed:k' AS key, op, value, ts FROM {{mut}} WHERE op IN ('set', 'push')),
f AS (SELECT *, min(seq) FILTER (op = 'push') OVER (PARTITION BY {KC}) AS first FROM a),
s AS (SELECT *, max(seq) FILTER (op = 'set' AND seq < first) OVER (PARTITION BY {KC}) AS seed FROM f WHERE first IS NOT NULL),
n AS (SELECT {KC}, value, CASE WHEN op = 'set' THEN 0 ELSE ts END AS ts, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n FROM s WHERE op = 'push' OR seq = seed)
SELECT {KC}, value, max(ts - n) OVER (PARTITION BY {KC} ORDER BY n) + n AS ts FROM n""")
def w5(s):
    return S.fold_list_push(s.mut.where("op in ('set', 'push')").withColumn("key", F.lit("mixed:k")))


@query("w6_fold_list_pop", f"""
WITH q AS (SELECT * REPLACE (seq % 100000000 + CASE op WHEN 'pop' THEN 100000000 ELSE 0 END AS seq) FROM {{queue}}),
n AS (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n FROM q WHERE op = 'push'),
b AS (SELECT {KC}, value, seq, max(ts - n) OVER (PARTITION BY {KC} ORDER BY n) + n AS ts, row_number() OVER (PARTITION BY {KC}, value ORDER BY seq DESC) AS back FROM n),
p AS (SELECT {KC}, value, count(*) AS pops FROM q WHERE op = 'pop' GROUP BY ALL)
SELECT {KC}, value, ts FROM b LEFT JOIN p USING ({KC}, value) WHERE back > coalesce(pops, 0)""")
def w6(s):
    """Every queue, its pops after its pushes: what needs no sequential fold."""
    later = F.col("seq") % 100_000_000 + F.when(F.col("op") == "pop", 100_000_000).otherwise(0)
    return S.fold_list_pop(s.queue.withColumn("seq", later))[0]


@query("w7_fold_list_rm")
def w7(s):
    """Every fifth event of a queue removes the entry at place 1: keys that need the sequential fold."""
    rm = s.queue.withColumn("op", F.when(F.col("seq") % 5 == 0, "list_rm").otherwise(F.col("op"))).withColumn("idx", F.lit(1))
    return S.fold_in_order(rm.where("op <> 'pop'"))


MEMBERS = f"""
WITH o AS (SELECT *, max(seq) FILTER (op = 'set_add') OVER (PARTITION BY {KC}, value) AS a FROM {{mut}} WHERE op IN ('set_add', 'set_rm')),
r AS (SELECT *, row_number() OVER (PARTITION BY {KC}, value ORDER BY seq) AS n FROM o WHERE a IS NOT NULL AND seq > a)
"""


@query("w8_set_members", MEMBERS + f"SELECT {KC}, value, ts FROM o WHERE seq = a AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = o.a)")
def w8(s):
    return S.fold_set(s.mut)[0]


@query("w9_set_tombstones", MEMBERS + f"SELECT {KC}, value, ts, email FROM r WHERE n = 1")
def w9(s):
    return S.fold_set(s.mut)[1]


@query("w10_fold_remove", f"""
WITH o AS (SELECT *, max(seq) FILTER (op = 'set') OVER (PARTITION BY {KC}) AS w FROM {{mut}} WHERE op IN ('set', 'rm')),
r AS (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n FROM o WHERE op = 'rm' AND seq > w) SELECT {KC}, ts, email FROM r WHERE n = 1""")
def w10(s):
    return S.fold_remove(s.mut.where("op in ('set', 'rm')"))



@query("w11_apply_tombstones", f"""
WITH f AS (SELECT {KC}, max(ts) + 1 AS ts FROM {{mut}} WHERE seq % 37 = 0 AND op IN ('set', 'set_add') GROUP BY ALL),
o AS (SELECT *, max(seq) FILTER (op = 'set') OVER (PARTITION BY {KC}) AS w, row_number() OVER (PARTITION BY {KC} ORDER BY seq DESC) AS d FROM {{mut}} WHERE op IN ('set', 'rm')),
v AS (SELECT {KC}, value FROM o WHERE d = 1 AND op = 'set'), r AS (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n FROM o WHERE op = 'rm' AND seq > w)
SELECT {KC}, 'value' AS part, value FROM v ANTI JOIN f USING ({KC}) UNION ALL SELECT {KC}, 'tombstone', CAST(ts AS VARCHAR) FROM (SELECT {KC}, ts FROM f UNION ALL SELECT {KC}, ts FROM r ANTI JOIN f USING ({KC}) WHERE n = 1) t""")
def w11(s):
    new = s.mut.where("seq % 37 = 0 and op in ('set', 'set_add')").groupBy(*K).agg((F.max("ts") + 1).alias("ts"), F.lit("x@example.com").alias("email"))
    own = s.mut.where("op in ('set', 'rm')")
    values, _, tombs = S.apply_tombstones(S.fold_strings(own), S.fold_set(s.mut)[0], S.fold_remove(own), new)
    return values.select(*K, F.lit("value").alias("part"), "value").unionByName(tombs.select(*K, F.lit("tombstone").alias("part"), F.col("ts").cast("string").alias("value")))


@query("w12_replay", MEMBERS + f""", l AS (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n FROM {{mut}} WHERE op = 'push'),
st AS (SELECT *, max(seq) FILTER (op = 'set') OVER (PARTITION BY {KC}) AS w, row_number() OVER (PARTITION BY {KC} ORDER BY seq DESC) AS d FROM {{mut}} WHERE op IN ('set', 'rm')),
rm AS (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n FROM st WHERE op = 'rm' AND seq > w),
pv AS (SELECT *, lag(op) OVER (PARTITION BY {KC}, value ORDER BY seq) AS b, min(seq) FILTER (op = 'set_add') OVER (PARTITION BY {KC}) AS f FROM {{mut}} WHERE op IN ('set_add', 'set_rm'))
SELECT {KC}, 'value' AS part, value, ts FROM st WHERE d = 1 AND op = 'set' UNION ALL SELECT {KC}, 'entry', value, max(ts - n) OVER (PARTITION BY {KC} ORDER BY n) + n FROM l
UNION ALL SELECT {KC}, 'member', value, ts FROM o WHERE seq = a AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = o.a) UNION ALL SELECT {KC}, 'tombstone', NULL, ts FROM rm WHERE n = 1
UNION ALL SELECT {KC}, 'member_tombstone', value, ts FROM r WHERE n = 1 UNION ALL SELECT {KC}, 'reject', CASE WHEN f < seq THEN 'ValueNotFound' ELSE 'KeyNotFound' END, NULL FROM pv WHERE op = 'set_rm' AND b IS DISTINCT FROM 'set_add'""")
def w12(s):
    return S.replay(s.mut).select(*K, "part", "value", "ts")


@query("w12_replay_ordered")
def w12_ordered(s):
    """Keys with pushes after pops: the sequential fold."""
    return S.replay(s.queue)


@query("w13_rejects", """
WITH b AS (SELECT seq, target_type, CASE WHEN seq % 41 = 0 THEN 'ab' ELSE target_value END AS target_value, CASE WHEN seq % 43 = 0 THEN key || '::x' WHEN seq % 47 = 0 THEN '__' || key ELSE key END AS key, op, CASE WHEN seq % 53 = 0 THEN NULL ELSE value END AS value FROM {mut})
SELECT seq, CASE WHEN seq % 41 = 0 THEN 'InvalidTarget' WHEN seq % 43 = 0 OR seq % 47 = 0 THEN 'InvalidKey' ELSE 'InvalidValue' END AS reason FROM b WHERE seq % 41 = 0 OR seq % 43 = 0 OR seq % 47 = 0 OR value IS NULL AND op <> 'rm'
UNION ALL SELECT seq, CASE WHEN f < seq THEN 'ValueNotFound' ELSE 'KeyNotFound' END FROM (SELECT seq, op, lag(op) OVER (PARTITION BY target_value, key, value ORDER BY seq) AS b, min(seq) FILTER (op = 'set_add') OVER (PARTITION BY target_value, key) AS f FROM {mut} WHERE op IN ('set_add', 'set_rm')) x WHERE op = 'set_rm' AND b IS DISTINCT FROM 'set_add'""")
def w13(s):
    n = F.col("seq")
    bad = s.mut.withColumns({
        "target_value": F.when(n % 41 == 0, "ab").otherwise(F.col("target_value")), "value": F.when(n % 53 != 0, F.col("value")),
        "key": F.when(n % 43 == 0, F.concat("key", F.lit("::x"))).when(n % 47 == 0, F.concat(F.lit("__"), "key")).otherwise(F.col("key")),
    })
    return S.invalid_rows(bad).unionByName(S.absent_removals(s.mut).select("seq", "reason"))


@query("w14_state_from_log", f"SELECT {KC}, op, value, ts AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY ts DESC, seq DESC) AS n FROM {{mut}}) x WHERE n = 1")
def w14(s):
    return S.state_from_log(s.mut)


PROMISED = f"SELECT {KC}, value, last_ts, is_promised FROM {{facts}} WHERE key <> 'doc:lang'"


@query("w15_promised", f"""
WITH v AS ({PROMISED}), a AS (SELECT * FROM v UNION ALL SELECT {KC}, '', 0, TRUE FROM {{facts}} WHERE key = 'doc:lang'),
f AS (SELECT {KC}, 'found' AS value, 5 AS last_ts FROM {{facts}} WHERE doc_id % 2 = 0)
SELECT {KC}, CASE WHEN a.is_promised THEN f.value ELSE a.value END AS value, CASE WHEN a.is_promised THEN f.last_ts ELSE a.last_ts END AS last_ts FROM a LEFT JOIN f USING ({KC}) WHERE NOT a.is_promised OR f.value IS NOT NULL""")
def w15(s):
    values = s.facts.where("key <> 'doc:lang'")
    found = s.facts.where("doc_id % 2 = 0").select(*K, F.lit("found").alias("value"), F.lit(5).cast("long").alias("last_ts"))
    return S.resolve_promised(S.add_promised(values, s.facts.where("key = 'doc:lang'")), found)
