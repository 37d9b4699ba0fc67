"""Merging snapshots.

A snapshot's values are a long table: target_type, target_value, key (together K), value_type, id,
value. A string has one row with an empty id; list entries and set members have a row each, with ids that
differ within a key. A side that repeats an id holds it once after a union, with one of its values.

Merges decide on digests. Each side of a key is summed up in one aggregation on K, before and after the
shuffle alike: how many items it has, and sums of two 64-bit hashes of them. No order of rows counts, no
list is gathered, and a key of any size is one row a task. Only the decided rows then meet the values of the sides
that are chosen; entries of lists and sets that are united are grouped by (K, id). Sides whose digests are
equal are taken as equal, as content ids are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars
from factweave.operators.shared import stored

K = ["target_type", "target_value", "key"]
VALUES = [*K, "value_type", "id", "value"]
KINDS = ("list", "set", "string")


@dataclass
class Snapshot:
    """values: VALUES; tombstones: K, ts, email; set_tombstones: K, id, value; list_tombstones: K, id, ts, email."""

    values: DataFrame
    tombstones: DataFrame | None = None
    set_tombstones: DataFrame | None = None
    list_tombstones: DataFrame | None = None


def per_key(**sides: DataFrame) -> DataFrame:
    """A row per K with ``<side>_type``, null where absent, and ``<side>_digest`` of the items."""
    whole = None
    for side, values in sides.items():
        rows = values.select(*K, F.array_position(F.array(*map(F.lit, KINDS)), F.col("value_type")).cast("int").alias("kind"), *_hashes(), F.lit(side).alias("side"))
        whole = rows if whole is None else whole.unionByName(rows)
    aggs = []
    for side in sides:
        here = F.col("side") == side
        aggs.append(F.max(F.when(here, F.col("kind"))).alias(f"{side}_kind"))
        aggs.append(F.count_if(here).alias(f"{side}_n"))
        aggs += [F.sum(F.when(here, half)).alias(f"{side}_{i}") for i, half in enumerate(_halves())]
    digest = lambda s: F.struct(F.col(f"{s}_n").alias("n"), *(F.col(f"{s}_{i}").alias(f"h{i}") for i in range(4))).alias(f"{s}_digest")
    return whole.groupBy(*K).agg(*aggs).select(*K, *(x for s in sides for x in (_kind_name(F.col(f"{s}_kind")).alias(f"{s}_type"), digest(s))))


def _hashes() -> tuple[Column, Column]:
    """Two hashes of an item; nulls are told from empty texts."""
    null = F.when(F.col("value").isNull(), 1).otherwise(0)
    return F.xxhash64(F.lit(1), null, "id", "value").alias("g"), F.xxhash64(F.lit(2), "value", "id", null).alias("h")


def _halves() -> list[Column]:
    """32 bits at a time, so that sums of billions of items fit a long."""
    low = F.lit(2**32 - 1)
    return [x for c in ("g", "h") for x in (F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(low))]


def _kind_name(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), code - 1)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}_type").eqNullSafe(F.col(f"{b}_type")) & F.col(f"{a}_digest").eqNullSafe(F.col(f"{b}_digest"))


def _has(side: str) -> Column:
    return F.col(f"{side}_type").isNotNull()


def decisions(base: DataFrame, local: DataFrame, remote: DataFrame, prefer: str = "local") -> DataFrame:
    """per_key rows with ``choice`` (base, local, remote, union or null for gone) and, for conflicts,
    ``reason``. Equal concurrent changes and adds count as conflicts."""
    rows = per_key(base=base, local=local, remote=remote)
    b, l, r = _has("base"), _has("local"), _has("remote")  # noqa: E741
    lc, rc = ~_same("local", "base"), ~_same("remote", "base")
    reason = (
        F.when(b & l & r & lc & rc, "both-changed").when(~b & l & r, "concurrent-add")
        .when(b & l & ~r & lc, "local-modified-remote-removed").when(b & ~l & r & rc, "remote-modified-local-removed")
    )
    both = F.col("local_type").eqNullSafe(F.col("remote_type")) & F.col("local_type").isin("list", "set")
    clash = reason.isin("both-changed", "concurrent-add")
    choice = (
        F.when(clash & both, "union").when(clash, prefer).when(b & l & r & lc, "local").when(b & l & r & rc, "remote").when(b & l & r, "base")
        .when(b & l & ~r & lc, "local").when(b & ~l & r & rc, "remote").when(~b & l & ~r, "local").when(~b & ~l & r, "remote")
    )
    return rows.withColumns({"reason": reason, "choice": choice})


def chosen_values(rows: DataFrame, **sides: DataFrame) -> DataFrame:
    """K, value_type, id, value and ``choice`` of the items that each key's choice names. A choice of
    base means that all sides are equal, so that the base itself isn't read."""
    choice = F.col("choice")
    values = None
    for n, (side, df) in enumerate(sides.items()):
        part = df.select(*VALUES, F.lit(n).alias("side"))
        values = part if values is None else values.unionByName(part)
    names = F.array(*map(F.lit, sides))
    mine = F.get(names, F.col("side")) == F.when(choice == "base", "local").otherwise(choice)
    chosen = rows.where("choice is not null").select(*K, "choice")
    plain = values.join(chosen, K).where(mine).select(*VALUES, "choice")
    if "remote" not in sides:
        return plain
    # strings, which hold most of the text, are never united
    united = values.where(~F.col("value_type").eqNullSafe(F.lit("string"))).join(chosen.where(choice == "union"), K).groupBy(*K, "value_type", "choice", "id").agg(F.min_by("value", "side").alias("value"))
    return plain.unionByName(united)


def merged_values(rows: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The values that ``decisions`` chose of three snapshots, with ``choice``."""
    return chosen_values(rows, local=local, remote=remote)


def merge3(base: DataFrame, local: DataFrame, remote: DataFrame, prefer: str = "local") -> DataFrame:
    """Merged values of three snapshots."""
    return merged_values(decisions(base, local, remote, prefer), local, remote).drop("choice")


def conflicts(base: DataFrame, local: DataFrame, remote: DataFrame, prefer: str = "local") -> DataFrame:
    """K, reason, resolution of every conflict."""
    return decisions(base, local, remote, prefer).where("reason is not null").select(*K, "reason", F.col("choice").alias("resolution"))


def merge_breakdown(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row of counts. A key that one side removed counts as a conflict even if unmodified."""
    b, l, r = _has("base"), _has("local"), _has("remote")  # noqa: E741
    lc, rc = ~_same("local", "base"), ~_same("remote", "base")
    n = lambda c, name: F.count_if(c).alias(name)
    return per_key(base=base, local=local, remote=remote).agg(
        n(b & l & r & ~lc & ~rc, "unchanged"), n(b & l & r & lc & ~rc, "local_changed"), n(b & l & r & ~lc & rc, "remote_changed"),
        n(~b & l & ~r, "new_local"), n(~b & ~l & r, "new_remote"), n(~b & l & r, "new_both"), n(b & ~l & ~r, "removed"),
        n(b & l & r & lc & rc | b & (l != r), "conflicts"),
    )


def ff_delta(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row: keys that a fast-forward adds, changes and removes."""
    l, r = _has("local"), _has("remote")  # noqa: E741
    rows = per_key(local=local, remote=remote)
    return rows.agg(F.count_if(~l & r).alias("added"), F.count_if(l & r & ~_same("local", "remote")).alias("changed"), F.count_if(l & ~r).alias("removed"))


def decisions2(local: Snapshot, remote: Snapshot, prefer: str = "local") -> DataFrame:
    """Without a common ancestor: K, ``choice`` (local or remote), kind (value or tombstone), ts and email
    of a tombstone, and ``conflict`` where the sides differ. A side's tombstone counts where it has no value."""
    rows = per_key(local=local.values, remote=remote.values)
    for side, snap in (("local", local), ("remote", remote)):
        dead = snap.tombstones.groupBy(*K).agg(F.max(F.struct(F.col("ts").cast("long").alias("ts"), "email")).alias(f"{side}_dead"))
        rows = rows.join(dead, K, "full")
    dead = lambda s: F.when(~_has(s), F.col(f"{s}_dead"))
    there = lambda s: _has(s) | F.col(f"{s}_dead").isNotNull()
    alike = (_has("local") == _has("remote")) & F.when(_has("local"), _same("local", "remote")).otherwise(dead("local").eqNullSafe(dead("remote")))
    other = "remote" if prefer == "local" else "local"
    picked = lambda f: F.when(there(prefer), f(prefer)).otherwise(f(other))
    out = rows.select(*K, picked(F.lit).alias("choice"), picked(_has).alias("live"), picked(dead).alias("dead"), (there("local") & there("remote") & ~alike).alias("conflict"))
    return out.select(*K, "choice", F.when(F.col("live"), "value").otherwise("tombstone").alias("kind"), "dead.ts", "dead.email", "conflict")


def merge2(local: Snapshot, remote: Snapshot, prefer: str = "local") -> Snapshot:
    """The values and tombstones that a merge without a common ancestor selects."""
    rows = stored(decisions2(local, remote, prefer), "decided")
    values = chosen_values(rows.where("kind = 'value'"), local=local.values, remote=remote.values).drop("choice")
    return Snapshot(values, rows.where("kind = 'tombstone'").select(*K, "ts", "email"))


def merge_tombstones(base: DataFrame, local: DataFrame, remote: DataFrame, merged: DataFrame) -> DataFrame:
    """Whole-key tombstones by the three-way rules, local first; none where ``merged`` holds K."""
    rows = None
    for side, t in (("base", base), ("local", local), ("remote", remote)):
        part = t.select(*K, F.struct("ts", "email").alias("t"), F.lit(side).alias("side"))
        rows = part if rows is None else rows.unionByName(part)
    pick = lambda s: F.first(F.when(F.col("side") == s, F.col("t")), True).alias(s)
    r = rows.groupBy(*K).agg(pick("base"), pick("local"), pick("remote"))
    b, l, m = (F.col(s).isNotNull() for s in ("base", "local", "remote"))  # noqa: E741
    lc, rc = ~F.col("local").eqNullSafe(F.col("base")), ~F.col("remote").eqNullSafe(F.col("base"))
    choice = (
        F.when(b & l & m, F.when(lc, F.col("local")).when(rc, F.col("remote")).otherwise(F.col("base"))).when(b & l, F.when(lc, F.col("local")))
        .when(b & m, F.when(rc, F.col("remote"))).when(b, F.lit(None)).otherwise(F.coalesce("local", "remote"))
    )
    return r.withColumn("t", choice).where("t is not null").join(merged.select(*K).distinct(), K, "left_anti").select(*K, "t.ts", "t.email")


def merge_set_tombstones(local: DataFrame, remote: DataFrame, merged: DataFrame) -> DataFrame:
    """K, id, value: both sides' member tombstones, local first; none for members that live."""
    rows = local.select(*K, "id", "value", F.lit(1).alias("p")).unionByName(remote.select(*K, "id", "value", F.lit(0).alias("p")))
    one = rows.groupBy(*K, "id").agg(F.max_by("value", "p").alias("value"))
    return one.join(merged.where("value_type = 'set'").select(*K, "id"), [*K, "id"], "left_anti")


def merge_list_tombstones(local: DataFrame, remote: DataFrame, merged: DataFrame) -> DataFrame:
    """K, id, ts, email: both sides' entry tombstones, the later one (of equals the remote); none for entries that live."""
    rows = local.select(*K, "id", "ts", "email", F.lit(0).alias("p")).unionByName(remote.select(*K, "id", "ts", "email", F.lit(1).alias("p")))
    one = rows.groupBy(*K, "id").agg(F.max_by(F.struct("ts", "email"), F.struct("ts", "p")).alias("t"))
    return one.join(merged.where("value_type = 'list'").select(*K, "id"), [*K, "id"], "left_anti").select(*K, "id", "t.ts", "t.email")


def live_values(snap: Snapshot) -> DataFrame:
    """A snapshot's values without the entries and members that its tombstones name."""
    values = snap.values
    for t, kind in ((snap.set_tombstones, "set"), (snap.list_tombstones, "list")):
        if t is not None:
            values = values.join(t.select(*K, F.lit(kind).alias("value_type"), "id").distinct(), [*K, "value_type", "id"], "left_anti")
    return values.select(*VALUES)


def planned(state: DataFrame, snap: Snapshot) -> DataFrame:
    """per_key rows of ``now`` and ``new`` with ``op``: set where the value differs, rm where a
    tombstone names a key that has no new value, else null."""
    rows = per_key(now=state, new=live_values(snap))
    op = F.when(_has("new") & ~_same("now", "new"), "set")
    if snap.tombstones is not None:
        dead = snap.tombstones.select(*K).distinct().withColumn("dead", F.lit(True))
        return rows.join(dead, K, "left").withColumn("op", op.when(~_has("new") & _has("now") & F.col("dead"), "rm")).drop("dead")
    return rows.withColumn("op", op)


def apply_snapshot(state: DataFrame, snap: Snapshot, gone: DataFrame | None = None) -> DataFrame:
    """The state after a merged snapshot: only keys that differ are written, tombstoned ones go, and those (K) in
    ``gone``. They are taken from the decided rows, not from the values, which are shuffled once."""
    rows = planned(state, snap).withColumn("choice", F.when(F.col("op") == "rm", F.lit(None)).when(F.col("op") == "set", "new").otherwise("now"))
    if gone is not None:
        rows = rows.select(*K, "choice").join(gone, K, "left_anti")
    return chosen_values(rows, now=state, new=live_values(snap)).drop("choice")


def plan_changes(state: DataFrame, snap: Snapshot, implicit: DataFrame | None = None) -> DataFrame:
    """Dry run: K, op, value_type and a preview of each change; nothing is written."""
    rows = planned(state, snap).where("op is not null").select(*K, "op", F.when(F.col("op") == "set", F.col("new_type")).alias("value_type"), F.col("new_digest.n").alias("n"))
    text = live_values(snap).where("value_type = 'string'").select(*K, F.lit("set").alias("op"), "value_type", scalars.truncate("value").alias("text"))
    size = F.when(F.col("value_type") == "list", F.format_string("[list: %d items]", "n")).when(F.col("value_type") == "set", F.format_string("[set: %d members]", "n"))
    plan = rows.join(text, [*K, "op", "value_type"], "left").select(*K, "op", "value_type", F.coalesce("text", size).alias("preview"))
    if implicit is not None:
        gone = implicit.select(*K).distinct().select(*K, F.lit("rm").alias("op"), F.lit(None).cast("string").alias("value_type"), F.lit(None).cast("string").alias("preview"))
        plan = plan.unionByName(gone).dropDuplicates([*K, "op"])
    return plan


def union_of_keys(*maps: DataFrame) -> DataFrame:
    """K of every map, each once."""
    keys = maps[0].select(*K)
    for m in maps[1:]:
        keys = keys.union(m.select(*K))
    return keys.distinct()


def union_of_entries(local: DataFrame, remote: DataFrame) -> DataFrame:
    """List and set entries of both sides by entry name; of one that both have, the local value."""
    rows = local.withColumn("side", F.lit(1)).unionByName(remote.withColumn("side", F.lit(2))).where("value_type <> 'string'")
    return rows.groupBy(*K, "value_type", "id").agg(F.min_by("value", "side").alias("value"))


def dropped_members(base: DataFrame, side: DataFrame) -> DataFrame:
    """K, id, value of list and set entries that ``side`` no longer has."""
    return base.where("value_type <> 'string'").join(side.select(*K, "id"), [*K, "id"], "left_anti").select(*K, "id", "value")


def implicit_deletes(before: DataFrame, values: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Keys of an older snapshot that the newer one names neither as value nor as tombstone."""
    known = values.select(*K) if tombstones is None else values.select(*K).unionByName(tombstones.select(*K))
    return before.select(*K).distinct().join(known.distinct(), K, "left_anti")


def fast_forward(state: DataFrame, old: DataFrame, snap: Snapshot, delete_missing: bool = True) -> DataFrame:
    """The state after taking over a descendant snapshot; keys that only the old one had are removed
    (switch off where the snapshot was pruned)."""
    return apply_snapshot(state, snap, implicit_deletes(old, snap.values) if delete_missing else None)


def three_way(state: DataFrame, base: Snapshot, local: Snapshot, remote: Snapshot) -> tuple[DataFrame, DataFrame]:
    """The state after a three-way merge, and the conflicts."""
    merged = stored(merge3(base.values, local.values, remote.values), "merged")
    tombs = stored(merge_tombstones(base.tombstones, local.tombstones, remote.tombstones, merged), "tombstones")
    after = apply_snapshot(state, Snapshot(merged, tombs), implicit_deletes(base.values, merged, tombs))
    return after, conflicts(base.values, local.values, remote.values)


def materialise(state: DataFrame, base: Snapshot | None, local: Snapshot, remotes: list[tuple[str, Snapshot]]) -> DataFrame:
    """Applies several remotes one after another by their strategies: up-to-date, fast-forward,
    three-way or two-way. The state is stored between remotes."""
    remotes = [r for r in remotes if r[0] != "up-to-date"]
    for n, (strategy, remote) in enumerate(remotes):
        state = stored(state, "state") if n else state
        if strategy == "fast-forward":
            state = fast_forward(state, local.values, remote)
        elif strategy == "three-way":
            state = three_way(state, base, local, remote)[0]
        elif strategy == "two-way":
            state = apply_snapshot(state, merge2(local, remote))
        else:
            raise ValueError(f"unknown strategy {strategy}")
    return state


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """path and A, M or D between two (path, content) snapshots, compared by content id."""
    x, y = a.select("path", F.sha1("content").alias("x")), b.select("path", F.sha1("content").alias("y"))
    status = F.when(F.col("x").isNull(), "A").when(F.col("y").isNull(), "D").when(F.col("x") != F.col("y"), "M")
    return x.join(y, "path", "full").select("path", status.alias("status")).where("status is not null")
