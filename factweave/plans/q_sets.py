"""Queries of orders, windows over writes and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import filters as P
from factweave.operators import merge as M
from factweave.operators import state as S
from factweave.operators import views as V
from factweave.operators.merge import K, Snapshot
from factweave.operators.ordering import first_two
from factweave.plans.registry import query

KC = "target_type, target_value, key"


@query("n2_increasing_times", f"""
WITH n AS (SELECT seq, target_type, target_value, key, ts, row_number() OVER (PARTITION BY {KC} ORDER BY seq) AS n FROM {{queue}} WHERE op = 'push')
SELECT seq, max(ts - n) OVER (PARTITION BY {KC} ORDER BY n) + n AS ts FROM n""")
def n2(s):
    return S.bumped(s.queue.where("op = 'push'"), [F.col("seq")]).select("seq", "ts")


@query("n3_last_op", f"SELECT {KC}, value, arg_max(op, seq) AS op FROM {{mut}} WHERE value_type = 'set' GROUP BY ALL")
def n3(s):
    return S.last_op(s.mut.where("value_type = 'set'"))


@query("o1_fact_order", f"SELECT {KC}, row_number() OVER (ORDER BY target_value, key, target_type) AS place FROM {{facts}} WHERE target_type = 'path'")
def o1(s):
    return V.fact_order(s.facts.where("target_type = 'path'"))


@query("o2_list_orders", f"""
WITH l AS (SELECT target_value, conv_id, turn * 7 % 13 * 10 AS ts, role FROM {{chat}}), e AS (SELECT *, ts || '-' || substr(sha1(role), 1, 5) AS name FROM l)
SELECT target_value, string_agg(name, ' ' ORDER BY ts, name) AS by_time, string_agg(name, ' ' ORDER BY name) AS by_name FROM e GROUP BY target_value""")
def o2(s):
    ts = F.col("turn") * 7 % 13 * 10
    return V.list_orders(s.chat.select("target_value", ts.alias("ts"), F.col("role").alias("value")), ["target_value"])


@query("o4_first_two", f"SELECT target_value, key FROM (SELECT target_value, key, row_number() OVER (PARTITION BY target_value ORDER BY key) AS n FROM {{facts}} WHERE target_type = 'path') x WHERE n <= 2")
def o4(s):
    return first_two(s.facts.where("target_type = 'path'").select("target_value", "key"), ["target_value"], "key")


@query("o5_newest_row", f"SELECT {KC}, max(seq) AS seq FROM (SELECT *, max(ts) OVER (PARTITION BY {KC}) AS m FROM {{mut}}) x WHERE ts = m GROUP BY ALL")
def o5(s):
    return S.last_per_key(s.mut).select(*K, "seq")


@query("x1_union_of_keys", f"SELECT {KC} FROM {{base}} UNION SELECT {KC} FROM {{local}} UNION SELECT {KC} FROM {{remote}} UNION SELECT {KC} FROM {{tomb_local}}")
def x1(s):
    return M.union_of_keys(s.base, s.local, s.remote, s.tomb_local)


@query("x2_union_of_entries", f"""
SELECT {KC}, value_type, id, arg_min(value, side) AS value FROM (SELECT *, 1 AS side FROM {{local}} UNION ALL SELECT *, 2 FROM {{remote}}) x WHERE value_type <> 'string' GROUP BY ALL""")
def x2(s):
    return M.union_of_entries(s.local, s.remote)


@query("x3_difference_of_keys", f"SELECT DISTINCT {KC} FROM {{remote}} ANTI JOIN {{base}} USING ({KC})")
def x3(s):
    return M.implicit_deletes(s.remote, s.base)


@query("x4_dropped_members", f"SELECT {KC}, id, value FROM {{base}} b ANTI JOIN {{remote}} USING ({KC}, id) WHERE value_type <> 'string'")
def x4(s):
    return M.dropped_members(s.base, s.remote)


@query("x5_distinct_keys", f"SELECT DISTINCT {KC} FROM {{facts}} WHERE NOT is_promised AND (key = 'doc' OR starts_with(key, 'doc:'))")
def x5(s):
    return V.all_keys(s.facts.where(P.key_prefix("doc")))


@query("x6_several_remotes", f"""
SELECT {KC}, value_type, id, value FROM {{local}} UNION ALL SELECT {KC}, value_type, id, value FROM {{base}} ANTI JOIN {{local}} USING ({KC})
UNION ALL SELECT {KC}, value_type, id, value FROM {{remote}} ANTI JOIN {{local}} USING ({KC}) ANTI JOIN {{base}} USING ({KC})""")
def x6(s):
    """Facts of two remotes without a common ancestor, one after the other; the local side wins."""
    none = s.tomb_local.where("false")
    remotes = [("two-way", Snapshot(s.remote, none)), ("two-way", Snapshot(s.base, none))]
    return M.materialise(s.local, None, Snapshot(s.local, none), remotes)
