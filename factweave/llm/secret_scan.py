"""Secret scans by an incremental ledger of blobs; DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content, its blob. The ledger, two tables
in a folder, remembers which pairs of a blob and a rule's version were scanned and what was found. A call
scans only pairs that the ledger doesn't have: a content that a thousand paths hold, or that came back
after a year, is scanned once, and a rule that changes is run alone over the known blobs. Findings are
then joined back to all paths and versions that hold the blob.

Copies meet by blob after one of each was picked in every task, so a content that makes up a third of all
rows is one row a task there; the join back streams rows against findings, where Spark splits a hot blob
by itself. Of texts, only the blobs to be scanned are shuffled, once. Matches are found by
``regexp_extract_all``, and their places by ``split`` at the same pattern: lengths of pieces and matches
are added up by a window over the matches of one content and rule.

Semantics: per rule, matches are the leftmost ones that don't overlap; ``start`` and ``end`` count code
points, ``end`` is exclusive. A match whose ``group`` is shorter than ``least`` is dropped after matching,
so that what it spans isn't matched again. Nulls: a null content is the empty one; keys may be null. Every
input row gives a row, repeated rows too; an empty table gives none; further columns are ignored, whatever
their names. Findings are written before the pairs that they are of, and are read without repeats: a run
that dies in between leaves a ledger that scans these pairs again. Two runs at once on one ledger may scan
a pair twice, with the same findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import exists, scratch, stored
from factweave.llm.exact_dedup import may_be_in


@dataclass(frozen=True)
class Rule:
    """``needs``: a text that every match contains, looked for before the pattern is tried."""

    kind: str
    pattern: str
    version: int = 1
    needs: str = ""
    group: int = 0
    least: int = 0

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The three kinds every scan has, then public formats of keys and tokens. Patterns mean the
#: same to Java and to RE2. A run of 24 or more ends where the longest run ends, so ``{24,}`` drops just
#: the runs that are too short; likewise ``{16,}`` after AKIA.
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("github", "gh[opsru]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
)
SCANNED = "blob binary, pairs array<string>"
FINDINGS = "blob binary, kind string, version int, spans array<struct<start:long,end:long>>"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def of_kind(rules, value) -> Column:
    """``value(rule)`` of the row's kind."""
    first, *more = rules
    out = F.when(F.col("kind") == first.kind, value(first))
    for rule in more:
        out = out.when(F.col("kind") == rule.kind, value(rule))
    return out


def matches(blobs: DataFrame, rules) -> DataFrame:
    """FINDINGS of (blob, text, todo), for the rules whose pair is in ``todo``; blobs must be distinct.
    Rows that lie together by blob stay where they are."""

    def found(rule: Rule) -> Column:
        due = F.array_contains("todo", rule.pair)
        due = due & F.contains("text", F.lit(rule.needs)) if rule.needs else due
        hits = F.when(due, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))
        return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), hits.alias("hits"))

    rows = blobs.select("blob", "text", F.inline(F.array(*map(found, rules)))).where(F.size("hits") > 0)
    pieces = F.split("text", of_kind(rules, lambda r: F.lit(r.pattern)), -1)
    rows = rows.select("blob", "kind", "version", F.posexplode(F.arrays_zip("hits", F.slice(pieces, 1, F.size("hits")).alias("before"))).alias("nth", "x"))
    size = F.length("x.hits").cast("long")
    ends = F.sum(F.length("x.before") + size).over(Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    long_enough = of_kind(rules, lambda r: F.length(F.regexp_extract("x.hits", r.pattern, r.group)) >= r.least if r.least else F.lit(True))
    rows = rows.select("blob", "kind", "version", (ends - size).alias("start"), ends.alias("end"), long_enough.alias("ok")).where("ok")
    return rows.groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def scan(versions: DataFrame, ledger: str, keys=("doc_id",), content: str = "text", rules=RULES) -> DataFrame:
    """Brings the ledger up to date with all contents of ``versions`` (a row per path and version, named by
    ``keys``), and returns ``keys``, ``blob`` and ``found``, an array of (start, kind, end) by start, then
    by place of the kind in ``rules``; empty without findings."""
    spark, pairs = versions.sparkSession, F.array(*(F.lit(r.pair) for r in rules))
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    rows = versions.select(F.struct(*keys).alias("at"), text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    tree = stored(rows.select("at", "blob"), "tree")

    known = exists(spark, f"{ledger}/scanned")
    seen = table(spark, f"{ledger}/scanned", SCANNED).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("seen"))
    todo = tree.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(pairs, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    todo = stored(todo.where(F.size("todo") > 0), "todo")
    if known:  # few are new: other texts stay where they are
        blobs = may_be_in(rows, todo, "blob").groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    else:
        blobs = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", pairs)
    matches(blobs, rules).write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.col("todo").alias("pairs")).write.mode("append").parquet(f"{ledger}/scanned")

    found = table(spark, f"{ledger}/findings", FINDINGS).where(F.concat_ws("@", "kind", "version").isin([r.pair for r in rules])).dropDuplicates(["blob", "kind", "version"])
    nth = of_kind(list(rules), lambda r: F.lit(rules.index(r)))
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), nth.alias("nth"), F.col("kind").alias("kind"), s["end"].alias("end")))
    per_blob = found.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(one))).alias("all"))
    spans = F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:long,kind:string,end:long>>")
    return tree.join(per_blob, "blob", "left").select("at.*", "blob", F.coalesce(spans, none).alias("found"))


def digests(found: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = text(F.filter("found", lambda s: s["kind"].isin(base)))
    return found.select(*keys, *map(count, base), F.sha2(of_base, 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def secret_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """The scan of a table of documents, each of one version; without a ledger, one of its own."""
    return digests(scan(docs, ledger or scratch(docs.sparkSession, "secret-ledger")))
