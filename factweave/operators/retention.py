"""Retention: rules, pruning of facts, snapshots and the local store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators import filters as P

K = ["target_type", "target_value", "key"]
RULE_KEYS = ("meta:prune:since", "meta:prune:max-keys", "meta:prune:max-size", "meta:prune:min-size")


def prune_rules(facts: DataFrame, now: int) -> dict | None:
    """cutoff, max_keys, max_size, min_size from the project's facts (four rows at most); None unless
    there is a window and a limit. A bad number raises ValueError."""
    rows = P.config(facts).where(F.col("key").isin(*RULE_KEYS)).select("key", "value", C.cutoff_ms("value", now).alias("ms"), C.size_bytes("value").alias("bytes")).limit(4).collect()
    got = {r["key"].rsplit(":", 1)[1]: r for r in rows}
    if "since" not in got or not ("max-keys" in got or "max-size" in got):
        return None
    out = {"cutoff": got["since"]["ms"]}
    for name, field in (("max-keys", "max_keys"), ("max-size", "max_size"), ("min-size", "min_size")):
        out[field] = got[name]["bytes"] if name in got else None
        if name in got and (out[field] is None or name == "max-keys" and not got[name]["value"].isdigit()):
            raise ValueError(f"{name}: {got[name]['value']!r} is no size")
    if out["cutoff"] is None:
        raise ValueError(f"since: {got['since']['value']!r} is no window")
    return out


def auto_prune(values: DataFrame, entries: DataFrame, tombstones: DataFrame, rules: DataFrame, cutoff: int | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, entries, tombstones) routed to main, without what is older than the cutoff; lists are
    trimmed entry by entry; project facts stay."""
    main = P.classify(values.select("key").union(entries.select("key")).union(tombstones.select("key")), rules).where(F.col("dest") == P.MAIN).select("key")
    pick = lambda df, ts: P.retain(df.join(main, "key", "left_semi"), cutoff, ts)
    return pick(values, "last_ts"), pick(entries, "ts"), pick(tombstones, "ts")


def prune_snapshot(values: DataFrame, since: int | Column, dry_run: bool = False) -> DataFrame:
    """Whole facts only. With ``dry_run``, one row: kept and dropped."""
    keep = (F.col("target_type") == "project") | (F.col("last_ts") >= since)
    return values.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped")) if dry_run else values.where(keep)


def prune_local(values: DataFrame, entries: DataFrame, tombstones: DataFrame, log: DataFrame, cutoff: int | Column, skip_date: bool = False) -> dict[str, DataFrame]:
    """Facts, their entries, entries of lists that stay, key and set tombstones and log rows before
    the cutoff go; list tombstones and everything of the project stay. ``skip_date`` drops all but
    the project's."""
    cut = F.lit(2**62) if skip_date else F.lit(cutoff)
    kept = P.retain(values, cut)
    heads = kept.select(*K)
    t = tombstones.where((F.col("tombstone_type") == "list_entry") | (F.col("target_type") == "project") | (F.col("ts") >= cut))
    return {"values": kept, "entries": P.retain(entries, cut, "ts").join(heads, K, "left_semi"), "tombstones": t, "log": P.retain(log, cut, "ts")}


def prune_files(files: DataFrame, cutoff: int, min_size: int = 0) -> DataFrame:
    """Snapshot files after pruning by size: a target type's files that are smaller than ``min_size``
    in all stay whole; else list entries and key tombstones before the cutoff go, strings and sets
    never."""
    kind = F.substring_index("path", "/", 1)
    size = F.broadcast(files.groupBy(kind.alias("kind")).agg(F.sum(F.octet_length("content").cast("long")).alias("bytes")))  # a row per target type
    last = F.element_at(F.split("path", "/"), -1)
    entry = F.col("path").rlike("/__list/[^/]*$") & (C.entry_ts(last) < cutoff)
    tomb = F.col("path").endswith("/__deleted") & (F.get_json_object("content", "$.timestamp").try_cast("long") < cutoff)
    old = F.coalesce(entry, F.lit(False)) | F.coalesce(tomb, F.lit(False))
    rows = files.withColumn("kind", kind).join(size, "kind")
    return rows.where((F.col("bytes") < min_size) | (F.col("kind") == "project") | ~old).select("path", "content")
