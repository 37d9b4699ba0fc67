"""Commit graphs and the history of snapshots. Ancestry goes by the chains of ``ancestry``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators.ancestry import Chains
from factweave.operators.ordering import with_previous
from factweave.operators.shared import stored
from factweave.operators.snapshot import PREFIXES, parse_manifests

K = ["target_type", "target_value", "key"]


def edges_of(commits: DataFrame) -> DataFrame:
    """id, parent for every parent."""
    return commits.select("id", F.explode("parents").alias("parent"))


def oldest_reaching(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """id, rank: the smallest rank of a source that reaches each commit. ``sources`` has id and rank."""
    return Chains.of(edges, sources).least_reaching(sources)


def release_of(commits: DataFrame, tags: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """commit_id, tag: commits reachable from a tag but not from an earlier one. Tags go by creation,
    then name; skipped tags give no facts but still take their commits."""
    rank = F.struct("created", "name")
    first = oldest_reaching(edges_of(commits), tags.select(F.col("commit_id").alias("id"), rank.alias("rank")))
    named = first.select(F.col("id").alias("commit_id"), F.col("rank.name").alias("tag"))
    return named if skip is None else named.join(skip.select(F.col("name").alias("tag")).distinct(), "tag", "left_anti").select("commit_id", "tag")


def previous_tags(tags: DataFrame) -> DataFrame:
    """name, previous: the tag created before each."""
    return with_previous(tags.select("name", "created"), "name", [F.col("created"), F.col("name")]).select("name", "previous")


def propagate_release(released: DataFrame, commits: DataFrame, facts: DataFrame) -> DataFrame:
    """target_type, target_value, tag: the commit's branch and its change id (a fact, else the
    trailer of its message) take the release too."""
    fact = lambda key: facts.where((F.col("target_type") == "commit") & (F.col("key") == key)).select(F.col("target_value").alias("commit_id"), F.col("value").alias(key.replace("-", "_")))
    rows = released.join(fact("branch-id"), "commit_id", "left").join(fact("change-id"), "commit_id", "left")
    rows = rows.join(commits.select(F.col("id").alias("commit_id"), C.last_trailer("message", "Change-Id").alias("trailer")), "commit_id", "left")
    targets = (("commit", F.col("commit_id")), ("branch", F.col("branch_id")), ("change-id", F.coalesce("change_id", "trailer")))
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("target_type"), col.alias("target_value")) for kind, col in targets))).alias("t"), "tag")
    return each.select("t.target_type", "t.target_value", "tag").where("target_value is not null").distinct()


def label_parts(rows: DataFrame) -> DataFrame:
    """target and key of manifest rows as K; rows with a target that isn't one are dropped."""
    return rows.select("*", C.parse_target("target").alias("parsed")).where("parsed.error is null").select(
        "id", "status", F.col("parsed.type").alias("target_type"), F.coalesce("parsed.value", F.lit("")).alias("target_value"), "key")


def history_index(commits: DataFrame, tip: str, known: DataFrame, snapshot_keys: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """K of all keys that history names and the state doesn't hold: from the change lists of all
    versions but the tip (deletions apart), and from the whole snapshot (``snapshot_keys``: id, K) of
    versions whose list was omitted or that have no parent."""
    old = commits.where(F.col("id") != tip)
    named = label_parts(parse_manifests(old, prefixes)).where("status <> 'D'").select(*K)
    whole = old.where((F.size("parents") == 0) | F.contains("message", F.lit("changes-omitted: true"))).select("id")
    full = snapshot_keys.join(whole, "id", "left_semi").select(*K)
    return named.unionByName(full).distinct().join(known.select(*K), K, "left_anti")


def index_summary(commits: DataFrame, tip: str, known: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """One row: versions, listed (with change lists), omitted, deletes, keys new and known already."""
    old = commits.where(F.col("id") != tip)
    rows = label_parts(parse_manifests(old, prefixes))
    at = old.agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.contains("message", F.lit("changes-omitted: true"))).alias("omitted")).withColumn("one", F.lit(1))
    keys = rows.where("status <> 'D'").select(*K).distinct().join(known.select(*K).distinct().withColumn("k", F.lit(True)), K, "left")
    a = rows.agg(F.count_distinct("id").alias("listed"), F.count_if(F.col("status") == "D").alias("deletes")).withColumn("one", F.lit(1))
    b = keys.agg(F.count_if(F.col("k").isNull()).alias("inserted"), F.count_if(F.col("k").isNotNull()).alias("already_known")).withColumn("one", F.lit(1))
    return at.join(a, "one").join(b, "one").drop("one")


def hydrate(promised: DataFrame, tip_values: DataFrame) -> DataFrame:
    """K, value_type, value, found: payloads of promised keys from the tip snapshot, string before
    list before set; keys without one are not found and to be dropped."""
    rank = F.when(F.col("value_type") == "string", 0).when(F.col("value_type") == "list", 1).otherwise(2)
    items = tip_values.groupBy(*K, "value_type").agg(F.array_join(F.sort_array(F.collect_list(F.struct("id", "value")))["value"], "|").alias("value"))
    best = items.groupBy(*K).agg(F.min_by(F.struct("value_type", "value"), rank).alias("b"))
    return promised.select(*K).distinct().join(best, K, "left").select(*K, "b.value_type", "b.value", F.col("b").isNotNull().alias("found"))


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, base for (pair, local, remote): the best common ancestor, which no other common ancestor
    reaches; of several the smallest id."""
    heads = pairs.select(F.explode(F.array("local", "remote")).alias("id")).where("id is not null")
    return Chains.of(edges, heads).best_common(pairs)


def merge_strategies(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, strategy, base for (pair, local, remote): up-to-date; fast-forward, also where there is no
    local head yet; three-way with the best common ancestor; or two-way. A remote that is behind gives
    three-way with the remote as base."""
    pairs = stored(pairs.select("pair", "local", "remote"), "pairs")
    apart = pairs.where("local is not null and local != remote")  # the others need no history
    rows = pairs.join(merge_bases(edges, apart), "pair", "left")
    strategy = (
        F.when(F.col("local").isNull(), "fast-forward").when(F.col("local") == F.col("remote"), "up-to-date").when(F.col("base") == F.col("local"), "fast-forward")
        .when(F.col("base").isNotNull(), "three-way").otherwise("two-way")
    )
    return rows.select("pair", strategy.alias("strategy"), F.when(strategy == "three-way", F.col("base")).alias("base"))


def new_versions(edges: DataFrame, old: str, new: str) -> DataFrame:
    """One row, n: versions that the new head reaches and the old one doesn't."""
    pair = edges.sparkSession.createDataFrame([(0, old, new)], "pair int, old string, new string")
    return new_versions_each(edges, pair).select("n")


def new_versions_each(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, n for (pair, old, new): versions that the new head reaches and the old one doesn't."""
    pairs = stored(pairs.select("pair", "old", "new"), "pairs")
    heads = pairs.select(F.explode(F.array("old", "new")).alias("id")).where("id is not null")
    return Chains.of(edges, heads, named=False).new_each(pairs)


def are_ancestors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, is_ancestor for (pair, old, new): whether the new head reaches the old one."""
    pairs = stored(pairs.select("pair", "old", "new"), "pairs")
    heads = pairs.select(F.explode(F.array("old", "new")).alias("id")).where("id is not null")
    return Chains.of(edges, heads, named=False).is_ancestor(pairs)
