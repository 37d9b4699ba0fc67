"""Queries of the merge operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import merge as M
from factweave.operators.merge import K, Snapshot
from factweave.plans.registry import query

ALL = "SELECT 'b' AS side, * FROM {base} UNION ALL SELECT 'l', * FROM {local} UNION ALL SELECT 'r', * FROM {remote}"
PER_KEY = f"""
WITH al AS ({ALL}),
k AS (SELECT target_type, target_value, key, max(value_type) FILTER (side = 'b') AS bt, max(value_type) FILTER (side = 'l') AS lt, max(value_type) FILTER (side = 'r') AS rt,
  max(value_type) FILTER (side = 'b') || string_agg(id || '=' || value, '|' ORDER BY id, value) FILTER (side = 'b') AS b,
  max(value_type) FILTER (side = 'l') || string_agg(id || '=' || value, '|' ORDER BY id, value) FILTER (side = 'l') AS l,
  max(value_type) FILTER (side = 'r') || string_agg(id || '=' || value, '|' ORDER BY id, value) FILTER (side = 'r') AS r FROM al GROUP BY ALL),
d AS (SELECT *, CASE WHEN b IS NOT NULL AND l <> b AND r <> b THEN 'both-changed' WHEN b IS NULL AND l IS NOT NULL AND r IS NOT NULL THEN 'concurrent-add'
    WHEN r IS NULL AND l <> b THEN 'local-modified-remote-removed' WHEN l IS NULL AND r <> b THEN 'remote-modified-local-removed' END AS reason FROM k),
c AS (SELECT *, CASE WHEN reason IN ('both-changed', 'concurrent-add') THEN CASE WHEN lt = rt AND lt <> 'string' THEN 'union' ELSE 'local' END
    WHEN reason LIKE 'local%' THEN 'local' WHEN reason LIKE 'remote%' THEN 'remote'
    WHEN b IS NULL THEN CASE WHEN l IS NULL THEN 'remote' ELSE 'local' END
    WHEN l IS NULL OR r IS NULL THEN NULL WHEN l <> b THEN 'local' WHEN r <> b THEN 'remote' ELSE 'base' END AS choice FROM d),
merged AS (SELECT target_type, target_value, key, value_type, id, value FROM (
    SELECT al.*, row_number() OVER (PARTITION BY target_type, target_value, key, al.id ORDER BY side) AS n FROM al JOIN c USING (target_type, target_value, key)
    WHERE side = choice[1] OR choice = 'union' AND side <> 'b') x WHERE n = 1)
"""
COLS = "target_type, target_value, key, value_type, id, value"


@query("m1_merge3", PER_KEY + f"SELECT {COLS}, choice AS resolution FROM merged JOIN c USING (target_type, target_value, key)")
def merge3(s):
    return M.merged_values(M.decisions(s.base, s.local, s.remote), s.local, s.remote).withColumnRenamed("choice", "resolution")


@query("m2_union_resolution", PER_KEY + f"SELECT {COLS} FROM merged JOIN c USING (target_type, target_value, key) WHERE choice = 'union'")
def union_resolution(s):
    return M.merged_values(M.decisions(s.base, s.local, s.remote).where("choice = 'union'"), s.local, s.remote).drop("choice")


@query("m3_conflicts", PER_KEY + "SELECT target_type, target_value, key, reason, choice AS resolution FROM c WHERE reason IS NOT NULL")
def conflict_report(s):
    return M.conflicts(s.base, s.local, s.remote)


@query("m4_merge2", f"""
WITH lv AS (SELECT target_type, target_value, key, 'value' AS kind, value_type || string_agg(id || '=' || value, '|' ORDER BY id, value) AS s FROM {{local}} GROUP BY target_type, target_value, key, value_type),
rv AS (SELECT target_type, target_value, key, 'value' AS kind, value_type || string_agg(id || '=' || value, '|' ORDER BY id, value) AS s FROM {{remote}} GROUP BY target_type, target_value, key, value_type),
l AS (SELECT * FROM lv UNION ALL SELECT target_type, target_value, key, 'tombstone', ts || email FROM {{tomb_local}} ANTI JOIN lv USING (target_type, target_value, key)),
r AS (SELECT * FROM rv UNION ALL SELECT target_type, target_value, key, 'tombstone', ts || email FROM {{tomb_remote}} ANTI JOIN rv USING (target_type, target_value, key))
SELECT target_type, target_value, key, coalesce(l.kind, r.kind) AS kind, coalesce(l.s, r.s) AS state, l.s IS NOT NULL AND r.s IS NOT NULL AND (l.s <> r.s OR l.kind <> r.kind) AS conflict
FROM l FULL JOIN r USING (target_type, target_value, key)""")
def merge2(s):
    """Of each key the selected state, as one text."""
    local, remote = Snapshot(s.local, s.tomb_local), Snapshot(s.remote, s.tomb_remote)
    items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: F.concat(x["id"], F.lit("="), x["value"])), "|")
    values = M.merge2(local, remote).values.groupBy(*K).agg(F.concat(F.max("value_type"), items).alias("text"))
    rows = M.decisions2(local, remote).join(values, K, "left")
    return rows.select(*K, "kind", F.coalesce("text", F.concat(F.col("ts").cast("string"), "email")).alias("state"), "conflict")


TOMBS = PER_KEY[:-1] + """,
t AS (SELECT target_type, target_value, key, b.ts || '/' || b.email AS tb, l.ts || '/' || l.email AS tl, r.ts || '/' || r.email AS tr FROM {tomb_base} b FULL JOIN {tomb_local} l USING (target_type, target_value, key) FULL JOIN {tomb_remote} r USING (target_type, target_value, key)),
tm AS (SELECT target_type, target_value, key, CASE WHEN tb IS NULL THEN coalesce(tl, tr) WHEN tl IS NULL AND tr IS NULL THEN NULL WHEN tl IS NULL THEN CASE WHEN tr <> tb THEN tr END
  WHEN tr IS NULL THEN CASE WHEN tl <> tb THEN tl END WHEN tl <> tb THEN tl ELSE tr END AS t FROM t),
tombs AS (SELECT * FROM tm ANTI JOIN merged USING (target_type, target_value, key) WHERE t IS NOT NULL)
"""


@query("m5_merge_tombstones", TOMBS + "SELECT target_type, target_value, key, CAST(split_part(t, '/', 1) AS BIGINT) AS ts, split_part(t, '/', 2) AS email FROM tombs")
def tombstones(s):
    return M.merge_tombstones(s.tomb_base, s.tomb_local, s.tomb_remote, M.merge3(s.base, s.local, s.remote))


@query("m6_merge_set_tombstones", PER_KEY + """
SELECT target_type, target_value, key, id, arg_max(value, side = 'local') AS value FROM {member_tombs} m
ANTI JOIN (SELECT * FROM merged WHERE value_type = 'set') USING (target_type, target_value, key, id) GROUP BY target_type, target_value, key, id""")
def set_tombstones(s):
    t = s.member_tombs
    return M.merge_set_tombstones(t.where("side = 'local'"), t.where("side = 'remote'"), M.merge3(s.base, s.local, s.remote))


@query("m7_merge_list_tombstones", PER_KEY + """
SELECT target_type, target_value, key, id, arg_max(ts, (ts, side)) AS ts, arg_max(email, (ts, side)) AS email FROM {entry_tombs} m
ANTI JOIN (SELECT * FROM merged WHERE value_type = 'list') USING (target_type, target_value, key, id) GROUP BY target_type, target_value, key, id""")
def list_tombstones(s):
    t = s.entry_tombs
    return M.merge_list_tombstones(t.where("side = 'local'"), t.where("side = 'remote'"), M.merge3(s.base, s.local, s.remote))


APPLY = """
WITH live AS (SELECT * FROM {remote} r WHERE NOT EXISTS (SELECT 1 FROM {entry_tombs} t WHERE t.side = 'remote' AND t.target_type = r.target_type AND t.target_value = r.target_value AND t.key = r.key AND t.id = r.id AND r.value_type = 'list')),
a AS (SELECT target_type, target_value, key, value_type || string_agg(id || '=' || value, '|' ORDER BY id, value) AS s, value_type AS t, count(*) AS n, min(value) AS v FROM {local} GROUP BY target_type, target_value, key, value_type),
b AS (SELECT target_type, target_value, key, value_type || string_agg(id || '=' || value, '|' ORDER BY id, value) AS s, value_type AS t, count(*) AS n, min(value) AS v FROM live GROUP BY target_type, target_value, key, value_type),
p AS (SELECT target_type, target_value, key, b.t, b.n, b.v, CASE WHEN b.s IS NOT NULL AND a.s IS DISTINCT FROM b.s THEN 'set' WHEN b.s IS NULL AND tt.ts IS NOT NULL THEN 'rm' END AS op
  FROM a FULL JOIN b USING (target_type, target_value, key) LEFT JOIN {tomb_remote} tt USING (target_type, target_value, key)),
after AS (SELECT l.* FROM {local} l JOIN p USING (target_type, target_value, key) WHERE op IS NULL UNION ALL SELECT l.* FROM live l JOIN p USING (target_type, target_value, key) WHERE op = 'set')
"""


def _remote(s):
    return Snapshot(s.remote, s.tomb_remote, None, s.entry_tombs.where("side = 'remote'"))


@query("m8_apply_snapshot", APPLY + f"SELECT {COLS} FROM after")
def apply(s):
    return M.apply_snapshot(s.local, _remote(s))


@query("m9_implicit_deletes", TOMBS + "SELECT DISTINCT target_type, target_value, key FROM {base} ANTI JOIN merged USING (target_type, target_value, key) ANTI JOIN tombs USING (target_type, target_value, key)")
def implicit(s):
    merged = M.merge3(s.base, s.local, s.remote)
    return M.implicit_deletes(s.base, merged, M.merge_tombstones(s.tomb_base, s.tomb_local, s.tomb_remote, merged))


@query("m10_fast_forward", APPLY + f"SELECT {COLS} FROM after WHERE NOT EXISTS (SELECT 1 FROM {{local}} o WHERE o.target_type = after.target_type AND o.target_value = after.target_value AND o.key = after.key) OR EXISTS (SELECT 1 FROM {{remote}} o WHERE o.target_type = after.target_type AND o.target_value = after.target_value AND o.key = after.key)")
def ff(s):
    return M.fast_forward(s.local, s.local, _remote(s))


@query("m11_materialise", TOMBS + f""", st AS (SELECT DISTINCT target_type, target_value, key FROM {{local}}),
after AS (SELECT {COLS} FROM merged UNION ALL SELECT l.* FROM {{local}} l ANTI JOIN merged USING (target_type, target_value, key) ANTI JOIN tombs USING (target_type, target_value, key))
SELECT {COLS} FROM after WHERE NOT EXISTS (SELECT 1 FROM {{base}} g WHERE g.target_type = after.target_type AND g.target_value = after.target_value AND g.key = after.key
  AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.target_type = g.target_type AND m.target_value = g.target_value AND m.key = g.key)
  AND NOT EXISTS (SELECT 1 FROM tombs m WHERE m.target_type = g.target_type AND m.target_value = g.target_value AND m.key = g.key))""")
def materialise(s):
    base, local, remote = Snapshot(s.base, s.tomb_base), Snapshot(s.local, s.tomb_local), Snapshot(s.remote, s.tomb_remote)
    return M.materialise(s.local, base, local, [("up-to-date", local), ("three-way", remote)])


@query("m12_plan_changes", APPLY + """SELECT target_type, target_value, key, op, CASE WHEN op = 'set' THEN t END AS value_type,
  CASE WHEN op = 'rm' THEN NULL WHEN t = 'string' THEN CASE WHEN length(v) <= 50 THEN v ELSE substr(v, 1, 47) || '...' END WHEN t = 'list' THEN '[list: ' || n || ' items]' ELSE '[set: ' || n || ' members]' END AS preview FROM p WHERE op IS NOT NULL""")
def dry_run(s):
    return M.plan_changes(s.local, _remote(s))


@query("m13_ff_delta", PER_KEY + "SELECT count(*) FILTER (l IS NULL AND r IS NOT NULL) AS added, count(*) FILTER (l <> r) AS changed, count(*) FILTER (l IS NOT NULL AND r IS NULL) AS removed FROM k")
def delta(s):
    return M.ff_delta(s.local, s.remote)


@query("m14_merge_breakdown", PER_KEY + """
SELECT count(*) FILTER (l = b AND r = b) AS unchanged, count(*) FILTER (l <> b AND r = b) AS local_changed, count(*) FILTER (l = b AND r <> b) AS remote_changed,
  count(*) FILTER (b IS NULL AND r IS NULL) AS new_local, count(*) FILTER (b IS NULL AND l IS NULL) AS new_remote, count(*) FILTER (b IS NULL AND l IS NOT NULL AND r IS NOT NULL) AS new_both,
  count(*) FILTER (l IS NULL AND r IS NULL) AS removed, count(*) FILTER (b IS NOT NULL AND (l <> b AND r <> b OR (l IS NULL) <> (r IS NULL))) AS conflicts FROM k""")
def breakdown(s):
    return M.merge_breakdown(s.base, s.local, s.remote)
