"""Reads by target and key, and routing of keys by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators.ordering import scan, spread
from factweave.operators.shared import stored

LOCAL_PREFIX, MAIN = "meta:local:", "main"


def get(facts: DataFrame, kind: str, value: str, key: str) -> DataFrame:
    return facts.where((F.col("target_type") == kind) & (F.col("target_value") == value) & (F.col("key") == key))


def get_each(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """What ``get`` gives for every (target_type, target_value, key) asked for."""
    return facts.join(asked.select("target_type", "target_value", "key").distinct(), ["target_type", "target_value", "key"], "left_semi")


def key_prefix(prefix: str) -> Column:
    """The key itself or anything below it; nothing in the prefix is a wildcard."""
    return (F.col("key") == prefix) | F.col("key").startswith(prefix + ":")


def get_all(facts: DataFrame, kind: str, value: str, prefix: str | None = None) -> DataFrame:
    rows = facts.where((F.col("target_type") == kind) & (F.col("target_value") == value))
    return rows.where(key_prefix(prefix)) if prefix else rows


def get_subtree(facts: DataFrame, path: str, prefix: str | None = None) -> DataFrame:
    """Facts of a path and of all paths below it."""
    at = (F.col("target_value") == path) | F.col("target_value").startswith(path + "/")
    rows = facts.where((F.col("target_type") == "path") & at)
    return rows.where(key_prefix(prefix)) if prefix else rows


def visible(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("is_promised"))


def all_facts(facts: DataFrame) -> DataFrame:
    """What may be shared: everything but promised rows."""
    return visible(facts)


def tombstones_of(tombstones: DataFrame, kind: str) -> DataFrame:
    return tombstones.where(F.col("tombstone_type") == kind)


def fuzzy(facts: DataFrame, kind: str, term: str) -> DataFrame:
    """Facts whose target value, key or (of strings) value has the term's characters in order, any case.
    Each character is looked for once, from where the one before was found: nothing is tried again."""
    pattern = "^" + "".join(f"[^{c}]*+{c}" for c in (f"\\x{{{ord(c):x}}}" for c in term.lower()))
    has = lambda c: F.coalesce(F.lower(c).rlike(pattern), F.lit(False))
    in_value = has("value") & (F.col("value_type") == "string") if "value_type" in facts.columns else has("value")
    return facts.where((F.col("target_type") == kind) & (has("target_value") | has("key") | in_value))


def config(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("target_type") == "project").where(key_prefix("meta"))


def retain(rows: DataFrame, cutoff: int | Column, ts: str = "last_ts") -> DataFrame:
    """Project facts always stay; others from the cutoff on."""
    return rows.where((F.col("target_type") == "project") | (F.col(ts) >= cutoff))


def since_filter(rows: DataFrame, cutoff_s: int | Column, ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts) >= cutoff_s)


def parse_rules(rules: DataFrame) -> DataFrame:
    """n, action, pattern, dests, error; ``rules`` has n and rule, in order of precedence."""
    return rules.select("n", C.parse_rule("rule").alias("parsed_rule")).select("n", "parsed_rule.*")


#: Rounds of a walk that go into one plan.
ROUNDS = 8


def rule_trie(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, starts, ends) of the trie over the segments of all patterns. A node is what patterns share
    of their first segments. edges: node, label, to; a label is ``=`` and a segment, ``*`` for any segment, or
    ``$`` for the end of the key. Behind ``**`` a node stays at itself on any segment, and whatever gets
    to a node before ``**`` gets past it too. ends: node, action, dest."""
    names = F.concat(F.lit("root"), F.lit(":"), "pattern")
    rows = parsed.select("action", "dests", "pattern", F.split("pattern", ":").alias("segs"), F.split(names, ":").alias("path"))
    node = lambda i: F.concat(i.cast("string"), F.lit("|"), F.array_join(F.slice("path", 1, i + 1), ":"))
    seg = lambda i: F.get("segs", i)
    size = F.size("segs")
    # how many ``**`` follow each place at once
    stars = F.aggregate(F.reverse("segs"), F.array(F.lit(0)), lambda found, s: F.concat(F.array(F.when(s == "**", F.get(found, F.lit(0)) + 1).otherwise(0)), found))
    rows = rows.withColumn("stars", stars)
    past = lambda i: F.transform(F.sequence(i, i + F.get("stars", i)), node)
    step = lambda i: (
        F.when(seg(i) == "**", F.array(F.struct(node(i + 1).alias("node"), F.lit("*").alias("label"), node(i + 1).alias("to"))))
        .otherwise(F.transform(past(i + 1), lambda to: F.struct(node(i).alias("node"), F.when(seg(i) == "*", "*").otherwise(F.concat(F.lit("="), seg(i))).alias("label"), to.alias("to"))))
    )
    steps = rows.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), size - 1), step))).alias("e")).select("e.*")
    last = rows.select(node(size).alias("node"), "action", F.explode_outer("dests").alias("dest")).distinct()
    edges = steps.unionByName(last.select("node", F.lit("$").alias("label"), F.col("node").alias("to"))).distinct()
    return edges, rows.select(F.explode(past(F.lit(0))).alias("node")).distinct(), last


def classify(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """key, dest for each distinct key and destination; excluded keys have none. All keys walk down the
    trie of the rules at once, a segment a round: what a key costs goes by its segments and the places in the
    trie that it is at, not by the number of rules. The trie is broadcast where Spark finds it small enough."""
    parsed = stored(parse_rules(rules).where("error is null").select("n", "action", "dests", "pattern"), "rules")
    edges, starts, ends = rule_trie(parsed)
    edges = stored(edges, "trie")
    own = keys.select("key").distinct().where(~F.col("key").startswith(LOCAL_PREFIX)).withColumn("segs", F.split("key", ":"))
    own = stored(own, "keys")
    deepest = own.agg(F.max(F.size("segs"))).first()[0] or 0
    first = [r["node"] for r in starts.collect()]  # the root, and a node for each leading ``**``
    at = own.repartition("key").select("key", "segs", F.explode(F.array(*map(F.lit, first)) if first else F.array().cast("array<string>")).alias("node"))
    for turn in range(deepest + 1):
        here = F.get("segs", F.lit(turn))
        label = F.explode(F.when(here.isNull(), F.array(F.lit("$"))).otherwise(F.array(F.concat(F.lit("="), here), F.lit("*"))))
        asks = at.select("key", "segs", "node", label.alias("label"))
        at = asks.join(edges, ["node", "label"]).select("key", "segs", F.col("to").alias("node")).dropDuplicates(["key", "node"])
        at = stored(at, "walk").repartition("key") if turn % ROUNDS == ROUNDS - 1 else at
    hit = at.select("key", "node").join(ends, "node")
    sums = hit.groupBy("key").agg(F.max(F.col("action") == "exclude").alias("out"), F.collect_set(F.when(F.col("action") == "route", F.col("dest"))).alias("dests"))  # each destination once
    found = own.select("key").join(sums, "key", "left").where("not coalesce(out, false)")
    dests = F.when(F.size("dests") > 0, F.col("dests")).otherwise(F.array(F.lit(MAIN)))
    return found.select("key", F.explode(dests).alias("dest"))


#: Rows of a key beyond which they aren't gathered by it.
HOT = 10_000


def route(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows once for each destination of their key, which is in ``dest``. Keys of very many rows, one to ``HOT``
    rows at most, are broadcast with their destinations, so that these rows stay where they are."""
    dests = stored(classify(rows, rules), "dests")
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key")
    many = stored(many.where("key is not null"), "hot")
    return rows.join(F.broadcast(dests.join(many, "key", "left_semi")), "key").unionByName(rows.join(F.broadcast(many), "key", "left_anti").join(dests, "key"))


def expand_targets(facts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """kind, prefix, target_value, matches: the first two targets that start with each (kind, prefix);
    two mean that the prefix is ambiguous. In order, the targets of a prefix come right behind it: it is
    enough to know the next target of every row, and that one's next. Both come from a running minimum over
    parts of the order, so prefixes may be of any number and length, and a kind of any size."""
    asked = prefixes.select("kind", F.col("prefix").alias("text"), F.lit(0).alias("is_target")).distinct()
    targets = facts.select(F.col("target_type").alias("kind"), F.col("target_value").alias("text"), F.lit(1).alias("is_target")).distinct()
    by, order = ["kind"], [F.col("text"), F.col("is_target")]
    rows = spread(asked.unionByName(targets).where("kind is not null and text is not null"), by, order)
    own = lambda c: F.when(F.col("is_target") == 1, c)
    rows = scan(rows, by, order, own(F.col("text")), "after", "min", before=True, backward=True)
    rows = scan(rows, by, order, own(F.struct("text", "after")), "next", "min", before=True, backward=True)
    near = F.filter(F.array("next.text", "next.after"), lambda t: t.startswith(F.col("text")))
    met = rows.where("is_target = 0").select("kind", F.col("text").alias("prefix"), near.alias("near"))
    return met.select("kind", "prefix", F.explode("near").alias("target_value"), F.size("near").cast("long").alias("matches"))
