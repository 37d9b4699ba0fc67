"""Snapshots as (path, content) files: rendering facts, parsing files, incremental output, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators.merge import K, VALUES, Snapshot
from factweave.operators.versions import Store

MAX_CHANGES = 1000
TOMB = "struct<timestamp:bigint,email:string>"


def render_snapshot(snap: Snapshot) -> DataFrame:
    """path, content of every value and tombstone, and the target the file belongs to."""
    at = ("target_type", "target_value", "key")
    v = snap.values
    path = (
        F.when(v["value_type"] == "string", C.fact_path("value", *at)).when(v["value_type"] == "list", C.fact_path("list", *at, "id")).otherwise(C.fact_path("set", *at, "id"))
    )
    files = v.select("target_type", "target_value", path.alias("path"), F.col("value").alias("content"))
    blob = F.to_json(F.struct(F.col("ts").alias("timestamp"), "email"))
    for t, what, content in ((snap.tombstones, "tombstone", blob), (snap.list_tombstones, "list_tombstone", blob), (snap.set_tombstones, "set_tombstone", F.col("value"))):
        if t is not None:
            entry = "id" if what != "tombstone" else None
            files = files.unionByName(t.select("target_type", "target_value", C.fact_path(what, *at, entry).alias("path"), content.alias("content")))
    return files


def parsed(files: DataFrame) -> DataFrame:
    """K, shape (value, list, set, tombstone, set_tombstone, list_tombstone), id, content of every
    file with a valid path; others are left out. List tombstones are told before set tombstones."""
    p = F.col("p.parts")
    n = F.size(p)
    last, second, third = F.get(p, n - 1), F.get(p, n - 2), F.get(p, n - 3)
    shape = (
        F.when((F.get(p, F.lit(0)) == "__tombstones") & (n >= 3) & (last == "__deleted"), "tombstone")
        .when((n >= 4) & (third == "__list") & (second == "__tombstones"), "list_tombstone").when((n >= 3) & (second == "__tombstones"), "set_tombstone")
        .when((n >= 2) & (second == "__set"), "set").when((n >= 3) & (second == "__list") & C.is_entry_name(last), "list").when((n >= 2) & (last == "__value"), "value")
    )
    cut = F.when(F.col("shape") == "list_tombstone", n - 3).when(F.col("shape") == "value", n - 1).otherwise(n - 2)
    segments = F.when(F.col("shape") == "tombstone", F.slice(p, 2, F.greatest(n - 2, F.lit(0)))).otherwise(F.slice(p, 1, F.greatest(cut, F.lit(0))))
    key = F.array_join(segments, ":")
    # explode of one element keeps the optimizer from copying the parse into every use of it
    rows = files.select("content", F.explode(F.array(C.parse_path("path"))).alias("p")).where("p is not null")
    rows = rows.select("content", "p", F.explode(F.array(shape)).alias("shape")).where("shape is not null")
    fields = F.struct(F.col("p.type").alias("target_type"), F.col("p.value").alias("target_value"), key.alias("key"), "shape", F.when(~F.col("shape").isin("value", "tombstone"), last).otherwise("").alias("id"), "content")
    rows = rows.select(F.explode(F.array(fields)).alias("f")).select("f.*")
    return rows.where(C.key_error("key").isNull())


def parse_snapshot(files: DataFrame) -> Snapshot:
    """Values and the three kinds of tombstones. Bad tombstone JSON is skipped, of repeated tombstones
    the latest counts, and a value beats its tombstone."""
    rows = parsed(files)
    kind = F.when(F.col("shape") == "value", "string").otherwise(F.col("shape"))
    values = rows.where("shape in ('value', 'list', 'set')").select(*K, kind.alias("value_type"), "id", F.col("content").alias("value"))
    blobs = rows.where("shape in ('tombstone', 'list_tombstone')").withColumn("t", F.from_json("content", TOMB)).where("t.timestamp is not null")

    def latest(shape: str, keys: list[str]) -> DataFrame:
        return blobs.where(F.col("shape") == shape).groupBy(*keys).agg(F.max_by("t", "t.timestamp").alias("t")).select(*keys, F.col("t.timestamp").alias("ts"), "t.email")

    tombs = latest("tombstone", K).join(values.select(*K).distinct(), K, "left_anti")
    of = lambda t: values.where(F.col("value_type") == t).select(*K, "id")
    entry = latest("list_tombstone", [*K, "id"]).join(of("list"), [*K, "id"], "left_anti")
    member = rows.where("shape = 'set_tombstone'").select(*K, "id", F.col("content").alias("value")).join(of("set"), [*K, "id"], "left_anti")
    return Snapshot(values, tombs, member, entry)


def export_incremental(store: Store, parent: str, version: str, snap: Snapshot, mutations: DataFrame, since: int) -> list[int]:
    """A version after ``parent`` with the targets touched after ``since`` as ``snap`` has them. Only these
    are rendered, and only their buckets read and written; returns the buckets that changed, and makes
    no version if none did."""
    dirty = mutations.where(F.col("ts") > since).select(*store.of).distinct()
    of = lambda t: None if t is None else t.join(dirty, list(store.of), "left_semi")
    files = render_snapshot(Snapshot(of(snap.values), of(snap.tombstones), of(snap.set_tombstones), of(snap.list_tombstones)))
    return store.follow(parent, version, dirty, files)


def apply_changes(values: DataFrame, changes: DataFrame) -> DataFrame:
    """The values after the changes between two versions (path, status, content): new and changed files
    are set, gone ones removed, and a new tombstone removes what its key had. The cost follows the changes, but for
    one pass over the values."""
    item = [*K, "value_type", "id"]
    rows = parsed(changes.select("path", F.struct("status", "content").alias("content")))
    rows = rows.withColumn("value_type", F.when(F.col("shape") == "value", "string").otherwise(F.col("shape")))
    items = rows.where("shape in ('value', 'list', 'set')")
    new = items.where("content.status != 'D'").select(*item, F.col("content.content").alias("value"))
    dead = rows.where("shape = 'tombstone' and content.status = 'A'").select(*K).distinct()
    left = values.join(items.select(*item), item, "left_anti").join(dead, K, "left_anti")
    return left.select(*item, "value").unionByName(new)


def write_routed(files: DataFrame, path: str) -> None:
    """One folder per destination; destinations without files get none."""
    files.write.partitionBy("dest").parquet(path)


def change_rows(mutations: DataFrame, since: int, has_previous: bool, by: list[str] | tuple = ()) -> DataFrame:
    """by, status (A, M, D), target, key of each change after ``since``."""
    status = F.when(F.col("op") == "rm", "D").when(F.col("op") == "set", "M" if has_previous else "A").otherwise("M")
    rows = mutations.where(F.col("ts") > since).select(*by, "target_type", "target_value", "key", "op").distinct()
    return rows.select(*by, status.alias("status"), C.target_label("target_type", "target_value").alias("target"), "key").distinct()


def change_manifests(mutations: DataFrame, since: int, has_previous: bool, by: list[str], most: int = MAX_CHANGES) -> DataFrame:
    """by, ``body``: ``change_manifest`` of each group that has changes. Lines are counted first, and
    gathered only where there are few enough."""
    rows = change_rows(mutations, since, has_previous, by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    few = rows.join(sizes.where(F.col("n") <= most), by).groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", "status", "target", "key"))), "\n").alias("body"))
    many = F.concat(F.lit("changes-omitted: true\ncount: "), F.col("n").cast("string"))
    return few.unionByName(sizes.where(F.col("n") > most).select(*by, many.alias("body")))


def change_manifest(mutations: DataFrame, since: int, has_previous: bool, facts: DataFrame | None = None, most: int = MAX_CHANGES) -> DataFrame:
    """One row, ``body``: the sorted change lines, or their number where there are more than ``most``.
    Without any change all ``facts`` count as added."""
    rows = change_rows(mutations, since, has_previous)
    if facts is not None and rows.isEmpty():
        rows = facts.select(F.lit("A").alias("status"), C.target_label("target_type", "target_value").alias("target"), "key").distinct()
    line = F.concat_ws("\t", "status", "target", "key")
    n = rows.count()
    if n > most:
        return rows.sparkSession.createDataFrame([(f"changes-omitted: true\ncount: {n}",)], "body string")
    return rows.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))  # `most` lines at most


PREFIXES = ("facts: update", "meta: update")


def parse_manifests(commits: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """id, status, target, key of the change lines in commit messages; messages without a body, with
    another prefix or with an omitted list have none; lines of fewer than three fields are skipped."""
    known = F.lit(False)
    for p in prefixes:
        known = known | F.col("message").startswith(p)
    body = F.get(F.split("message", "\n\n", 2), F.lit(1))
    rows = commits.where(known).select("id", body.alias("body")).where(~F.contains("body", F.lit("changes-omitted: true")))
    parts = rows.select("id", F.explode(F.split("body", "\n")).alias("line")).select("id", F.split("line", "\t", 3).alias("f")).where(F.size("f") == 3)
    return parts.select("id", F.col("f")[0].alias("status"), F.col("f")[1].alias("target"), F.col("f")[2].alias("key")).where("status in ('A', 'M', 'D')")


def externalise(values: DataFrame, limit: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(values, blobs): values of more than ``limit`` bytes become content ids."""
    big = F.octet_length("value") > limit
    out = values.withColumn("is_ref", big).withColumn("value", F.when(big, C.member_id("value")).otherwise(F.col("value")))
    blobs = values.where(big).select(C.member_id("value").alias("content_id"), F.col("value").alias("content")).dropDuplicates(["content_id"])
    return out, blobs


def resolve(values: DataFrame, blobs: DataFrame) -> DataFrame:
    """Values with content ids replaced by their contents; only references are shuffled."""
    refs = values.where("is_ref").join(blobs, values["value"] == blobs["content_id"], "left").withColumn("value", F.coalesce("content", "value")).drop("content_id", "content")
    return values.where("not is_ref").unionByName(refs)


def values_of(state: Snapshot) -> DataFrame:
    return state.values.select(*VALUES)


def transcript_to_list(rows: DataFrame, group: list[str], order: Column, ts: Column, text: str) -> DataFrame:
    """Ordered messages as list entries, each a millisecond after the one before it at least."""
    lists = rows.groupBy(*group).agg(F.min(ts).alias("t0"), F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(text).alias("v")))).alias("l"))
    each = lists.select(*group, "t0", F.posexplode("l").alias("pos", "i"))
    return each.select(*group, (F.col("t0") + F.col("pos")).alias("ts"), F.col("i.v").alias("value")).withColumn("id", C.entry_name("ts", "value"))
