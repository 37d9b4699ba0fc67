"""Read views: counts, histograms, authorship, logs, line annotation, nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators.ordering import numbered
from factweave.operators.shared import stored

K = ["target_type", "target_value", "key"]
SIZES = ((64, "<64B"), (1024, "64B–1KB"), (4096, "1KB–4KB"), (16384, "4KB–16KB"), (65536, "16KB–64KB"), (None, "64KB+"))


def stats_by_key(facts: DataFrame) -> DataFrame:
    return facts.groupBy("target_type", "key").count().orderBy("target_type", F.desc("count"), "key")


def size_histogram(values: DataFrame) -> DataFrame:
    """bucket, n for inline strings, empty buckets included, and 'references'."""
    size = F.octet_length("value")
    label = F.when(F.col("is_ref"), "references")
    for limit, name in SIZES:
        label = label.when(size < limit, name) if limit else label.otherwise(name)
    names = values.sparkSession.createDataFrame([(n,) for _, n in SIZES] + [("references",)], "bucket string")
    counts = values.where("value_type = 'string'").groupBy(label.alias("bucket")).count()
    return names.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n"))


def storage_counts(values: DataFrame) -> DataFrame:
    return values.agg(F.count_if(~F.col("is_ref")).alias("inline"), F.count_if(F.col("is_ref")).alias("external"))


def stats_by_shape(facts: DataFrame) -> DataFrame:
    """target_type, key, n: keys that differ by digits only are one shape where two at least share it."""
    keys = facts.groupBy("target_type", "key").count().withColumn("shape", C.key_shape("key"))
    shapes = keys.groupBy("target_type", "shape").agg(F.count(F.lit(1)).alias("keys"), F.min("key").alias("key"), F.sum("count").alias("n"))
    return shapes.select("target_type", F.when(F.col("keys") > 1, F.col("shape")).otherwise(F.col("key")).alias("key"), "n")


def overview(facts: DataFrame, approximate: bool = False) -> DataFrame:
    """Per type: keys, distinct targets, promised, total."""
    n = F.approx_count_distinct if approximate else F.count_distinct
    live = ~F.col("is_promised")
    return facts.groupBy("target_type").agg(
        F.count_if(live).alias("keys"), n(F.when(live, F.col("target_value"))).alias("targets"), F.count_if(~live).alias("promised"), F.count(F.lit(1)).alias("total"),
    )


def promised_by_type(facts: DataFrame) -> DataFrame:
    return facts.where("is_promised").groupBy("target_type").agg(F.count(F.lit(1)).alias("n"))


def timeline(rows: DataFrame, now: int, weeks: int = 20, ts: str = "last_ts") -> DataFrame:
    """week, n for the last ``weeks`` weeks, empty ones included; older rows are week -1, and what is
    not before ``now`` is left out."""
    week = 7 * 86_400_000
    start = now - weeks * week
    at = F.when(F.col(ts) < start, F.lit(-1)).otherwise(F.floor((F.col(ts) - start) / week)).cast("int")
    counts = rows.where(F.col(ts) < now).groupBy(at.alias("week")).count()
    every = rows.sparkSession.range(-1, weeks).select(F.col("id").cast("int").alias("week"))
    return every.join(F.broadcast(counts), "week", "left").select("week", F.coalesce("count", F.lit(0)).alias("n"))


def prune_counts(tables: dict[str, tuple[DataFrame, str]], cutoff: int) -> DataFrame:
    """table, before, remaining of each (rows, time column): project rows always remain."""
    out = None
    for name, (rows, ts) in tables.items():
        part = rows.agg(F.count(F.lit(1)).alias("before"), F.count_if((F.col("target_type") == "project") | (F.col(ts) >= cutoff)).alias("remaining")).select(F.lit(name).alias("table"), "before", "remaining")
        out = part if out is None else out.unionByName(part)
    return out


def snapshot_size(files: DataFrame) -> DataFrame:
    """keys (tombstones apart) and bytes of a snapshot."""
    key = F.regexp_replace("path", "/(__value|__list/[^/]*|__set/[^/]*)$", "")
    live = ~F.contains("path", F.lit("/__tombstones/"))
    return files.agg(F.count_distinct(F.when(live, key)).alias("keys"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


def should_prune(files: DataFrame, max_keys: int | None, max_size: int | None) -> DataFrame:
    over = lambda c, most: F.lit(False) if most is None else F.coalesce(F.col(c) > most, F.lit(False))
    return snapshot_size(files).withColumn("prune", over("keys", max_keys) | over("bytes", max_size))


def prune_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = (x.agg(F.count(F.lit(1)).alias(n)).withColumn("one", F.lit(1)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, "one").select("before", "after", F.greatest(F.col("before") - F.col("after"), F.lit(0)).alias("dropped"))


def all_keys(facts: DataFrame) -> DataFrame:
    return facts.where("not is_promised").select(*K).distinct()


def authorship(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Facts with author and timestamp of the newest log row of their key; unknown and 0 without one."""
    newest = log.groupBy(*K).agg(F.max_by(F.struct("email", "ts"), F.struct("ts", "seq")).alias("a"))
    return facts.join(newest, K, "left").withColumns({"author": F.coalesce("a.email", F.lit("unknown")), "timestamp": F.coalesce("a.ts", F.lit(0).cast("long"))}).drop("a")


def modified_since(log: DataFrame, values: DataFrame, since: int) -> DataFrame:
    """Distinct (K, op) after ``since`` with the current value, '' where there is none."""
    rows = log.where(F.col("ts") > since).select(*K, "op").distinct()
    return rows.join(values.select(*K, "value"), K, "left").withColumn("value", F.coalesce("value", F.lit("")))


def log_view(commits: DataFrame, facts: DataFrame, n: int, only_with_facts: bool = False) -> DataFrame:
    """The newest n commits with their facts as sorted text, the first four non-empty message lines and
    how many more there are."""
    own = facts.where("target_type = 'commit'")
    rows = commits.join(own.select(F.col("target_value").alias("id")).distinct(), "id", "left_semi") if only_with_facts else commits
    newest = rows.orderBy(F.desc("ts"), "id").limit(n)
    text = F.concat("key", F.lit("="), "value")
    each = own.join(newest.select(F.col("id").alias("target_value")), "target_value").groupBy(F.col("target_value").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(text)), ";").alias("facts"))
    lines = F.filter(F.split("message", "\n"), lambda x: F.trim(x) != "")
    return newest.join(each, "id", "left").select("id", "ts", F.coalesce("facts", F.lit("")).alias("facts"), F.array_join(F.slice(lines, 1, 4), "|").alias("head"), F.greatest(F.size(lines) - 4, F.lit(0)).alias("more"))


def show_view(commits: DataFrame, facts: DataFrame) -> DataFrame:
    """id, source, key, value: facts on each commit and on its change id."""
    on_commit = facts.where("target_type = 'commit'").join(commits.select(F.col("id").alias("target_value")), "target_value").select(F.col("target_value").alias("id"), F.lit("commit").alias("source"), "key", "value")
    change = commits.select("id", C.last_trailer("message", "Change-Id").alias("target_value")).where("target_value is not null")
    on_change = facts.where("target_type = 'change-id'").join(change, "target_value").select("id", F.lit("change-id").alias("source"), "key", "value")
    return on_commit.unionByName(on_change)


def annotate_lines(lines: DataFrame, facts: DataFrame, branch_facts: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Lines with their commit's branch and that branch's facts, a column for each of ``keys``."""
    branch = facts.where("target_type = 'commit' and key = 'branch-id'").select(F.col("target_value").alias("commit_id"), F.col("value").alias("branch"))
    rows = lines.join(branch, "commit_id", "left")
    if not keys:
        return rows
    wide = branch_facts.groupBy("branch").pivot("key", keys).agg(F.max("value"))
    return rows.join(wide, "branch", "left")


#: Lines of a file that one task puts in order.
BLOCK = 4096


def in_blocks(lines: DataFrame) -> DataFrame:
    """Lines dealt out by file and block of line numbers, ``__block``; ``line_groups`` takes them as they lie."""
    return lines.withColumn("__block", F.floor(F.col("line") / BLOCK)).repartition("file", "__block")


def line_groups(lines: DataFrame, identity: Column) -> DataFrame:
    """file, first, last, identity, commit_id: runs of neighbouring lines with one identity; a run ends
    at a change of identity or a gap in the line numbers, and carries its first line's commit. Runs are found within
    blocks of a file; only those that touch a block's end may go on in the next one, and are put together."""
    rows = (lines if "__block" in lines.columns else in_blocks(lines)).select("file", "__block", F.col("line").alias("first"), F.col("line").alias("last"), identity.alias("identity"), "commit_id")
    runs = _joined_runs(rows, ["file", "__block"])
    edge = (F.pmod("first", F.lit(BLOCK)) == 0) | (F.pmod("last", F.lit(BLOCK)) == BLOCK - 1)
    return runs.where(~edge).drop("__block").unionByName(_joined_runs(runs.where(edge), ["file"]))


def _joined_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs of one identity that follow each other without a gap as one."""
    w = W.partitionBy(*by).orderBy("first")
    cut = F.when((F.lag("identity").over(w) == F.col("identity")) & (F.lag("last").over(w) + 1 == F.col("first")), 0).otherwise(1)
    rows = runs.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w))
    return rows.groupBy(*by, "run").agg(F.min_by("identity", "first").alias("identity"), F.min_by("commit_id", "first").alias("commit_id"), F.min("first").alias("first"), F.max("last").alias("last")).select(*by, "first", "last", "identity", "commit_id")


def first_seen(rows: DataFrame, branch: str = "branch", ts: str = "ts") -> DataFrame:
    """branch and ``branch@first`` of the earliest time it was seen."""
    return rows.groupBy(branch).agg(F.min(ts).alias("first")).select(branch, F.concat(branch, F.lit("@"), F.col("first").cast("string")).alias("name"))


def fact_order(facts: DataFrame) -> DataFrame:
    """K and ``place``: the order of output, by target value, then key, then type."""
    return numbered(facts.select(*K), [F.col("target_value"), F.col("key"), F.col("target_type")])


def list_orders(entries: DataFrame, by: list[str]) -> DataFrame:
    """by, by_time, by_name: the names of a list's entries (ts, value) in both orders."""
    names = entries.select(*by, "ts", C.entry_name("ts", "value").alias("name")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ts", "name"))).alias("t"))
    return names.select(*by, F.array_join("t.name", " ").alias("by_time"), F.array_join(F.sort_array("t.name"), " ").alias("by_name"))


def entry_index(entries: DataFrame) -> DataFrame:
    return entries.withColumn("idx", F.row_number().over(W.partitionBy(*K).orderBy("ts", "value")) - 1)


def _member(name: Column, value: Column) -> Column:
    return F.concat(C.json_encode(name), F.lit(":"), value)


def to_nested_json(facts: DataFrame, depth: int | None = None, log: DataFrame | None = None, fragments: bool = False) -> DataFrame:
    """target_type, target_value, json: key segments as nested objects, rolled up from the deepest
    segment. A key that is leaf and parent keeps its value under __value. With ``log`` each leaf is
    an object of value, author and timestamp. Path targets nest as path, then whole key, in one object of
    all paths, or with ``fragments`` in one for each directory at the top, which is then in target_value."""
    rows = authorship(facts, log) if log is not None else facts
    leaf = C.json_encode("value")
    if log is not None:
        leaf = F.concat(F.lit('{"value":'), leaf, F.lit(',"author":'), C.json_encode("author"), F.lit(',"timestamp":'), F.col("timestamp").cast("string"), F.lit("}"))
    segments = F.when(F.col("target_type") == "path", F.array("target_value", "key")).otherwise(F.split("key", ":"))
    group = F.when(F.col("target_type") == "path", F.substring_index("target_value", "/", 1) if fragments else F.lit("")).otherwise(F.col("target_value"))
    at = ["target_type", "target_value"]
    done = rows.select("target_type", group.alias("target_value"), segments.alias("s"), leaf.alias("leaf"), F.lit(None).cast("string").alias("member"))
    depth = depth or rows.agg(F.max(F.size(segments))).first()[0] or 1
    for d in range(depth, 0, -1):  # one aggregation per level of nesting, each over the one before
        one = done.groupBy(*at, "s").agg(F.max("leaf").alias("leaf"), F.array_join(F.sort_array(F.collect_list("member")), ",").alias("node"))
        inner = F.when(F.col("node") == "", F.col("leaf")).when(F.col("leaf").isNull(), F.concat(F.lit("{"), "node", F.lit("}"))).otherwise(
            F.concat(F.lit('{"__value":'), "leaf", F.lit(","), "node", F.lit("}")))
        deep = F.size("s") == d  # only these have members: shorter ones wait with their leaves
        done = one.select(*at, F.when(deep, F.slice("s", 1, d - 1)).otherwise(F.col("s")).alias("s"), F.when(~deep, F.col("leaf")).alias("leaf"), F.when(deep, _member(F.element_at("s", -1), inner)).alias("member"))
    return done.groupBy(*at).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("member")), ","), F.lit("}")).alias("json"))


def write_nested_json(facts: DataFrame, path: str, log: DataFrame | None = None) -> None:
    """Nested JSON as text, a folder for each type of target: a line holds the members of one target, or of the
    paths of one directory at the top. ``{``, the lines of a type joined by commas and ``}`` are its object."""
    rows = to_nested_json(facts, log=log, fragments=True)
    inner = F.expr("substring(json, 2, length(json) - 2)")
    line = F.when(F.col("target_type") == "path", inner).otherwise(_member(F.col("target_value"), F.col("json")))
    rows.select("target_type", line.alias("value")).write.partitionBy("target_type").text(path)


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """target_type and a JSON object for each line of ``write_nested_json``."""
    return spark.read.text(path).select("target_type", F.concat(F.lit("{"), "value", F.lit("}")).alias("json"))


def flatten_json(rows: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """keep columns, key, value: nested objects as colon-joined keys, one round per level until nothing
    is nested; each round is written to the shared folder and reads the one before. An empty object
    has no keys and gives no row."""
    todo = rows.select(*keep, F.lit("").alias("prefix"), F.col(json_col).alias("j"))
    out = None
    while out is None or not todo.isEmpty():
        each = todo.select(*keep, "prefix", F.explode(F.from_json("j", "map<string,string>")).alias("k", "v"))
        name = F.concat("prefix", F.when(F.col("prefix") == "", "").otherwise(":"), "k")
        each = stored(each.select(*keep, name.alias("prefix"), F.col("v").alias("j"), F.coalesce(F.json_object_keys("v").isNotNull(), F.lit(False)).alias("nested")), "flat")
        leaves = each.where("not nested").drop("nested")
        out = leaves if out is None else out.unionByName(leaves)
        todo = each.where("nested").drop("nested")
    return out.select(*keep, F.col("prefix").alias("key"), F.col("j").alias("value"))


def branch_commit_stats(commits: DataFrame, branches: DataFrame) -> DataFrame:
    """branch, authors, times: distinct authors and author times of each branch's commits, sorted."""
    rows = branches.join(commits, "id")
    return rows.groupBy("branch").agg(F.array_join(F.sort_array(F.collect_set("author")), ",").alias("authors"), F.array_join(F.sort_array(F.collect_set("ts")).cast("array<string>"), ",").alias("times"))
