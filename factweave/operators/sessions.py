"""Agent sessions and the commits that came out of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators.shared import stored, stored_counting


def summarise_sessions(messages: DataFrame) -> DataFrame:
    """A row per session of at least two messages: models, tools, token sums, messages, start, end,
    seconds. ``messages`` has session_id, ts (ms), model, tools (array), input_tokens, output_tokens, and
    may have n, how many messages a row counts as."""
    n = F.sum("n") if "n" in messages.columns else F.count(F.lit(1))
    models = F.filter(F.sort_array(F.collect_set("model")), lambda m: m != "<synthetic>")
    rows = messages.groupBy("session_id").agg(
        F.array_join(models, ",").alias("models"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("tools")))), ",").alias("tools"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), n.alias("messages"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
    )
    return rows.where("messages >= 2").withColumn("seconds", F.floor((F.col("end_ts") - F.col("start_ts")) / 1000))


def transcript_messages(lines: DataFrame) -> DataFrame:
    """Rows for ``summarise_sessions`` straight from ``read_transcripts``: of the assistant's lines the model,
    tokens, tools used, and a message for each text and tool; of the user's a message for each text. Other
    lines count for the time only."""
    texts = F.size(C.content_texts("content"))
    blocks = F.from_json("content", "array<struct<type:string,name:string>>")
    tools = F.when(F.ltrim("content").startswith("["), F.filter(blocks, lambda b: b["type"] == "tool_use"))
    said, by = F.coalesce(texts, F.lit(0)), F.col("type")
    of_assistant = lambda c: F.when(by == "assistant", c)
    names = F.filter(F.transform(tools, lambda b: b["name"]), lambda name: name.isNotNull())
    n = F.when(by == "assistant", said + F.coalesce(F.size(tools), F.lit(0))).when(by == "user", said).otherwise(0)
    return lines.select(
        "session_id", C.rfc3339_ms("timestamp").alias("ts"), of_assistant(F.col("model")).alias("model"), F.coalesce(of_assistant(names), F.array().cast("array<string>")).alias("tools"),
        F.coalesce(of_assistant(F.col("input_tokens")), F.lit(0)).alias("input_tokens"), F.coalesce(of_assistant(F.col("output_tokens")), F.lit(0)).alias("output_tokens"), n.alias("n"),
    )


def summarise_transcripts(lines: DataFrame) -> DataFrame:
    """``summarise_sessions`` of transcripts as ``read_transcripts`` gives them."""
    return summarise_sessions(transcript_messages(lines))


#: Cells of 2**HOUR units and more are what sessions and commits are dealt out by.
HOUR = 6
#: So many sessions of one such cell go to one task, and so many of its commits are one row.
CROWD, BLOCK = 100_000, 64
#: So many named commits a session carries.
MANY = 64


def dyadic_cells(lo: Column, hi: Column) -> Column:
    """array<struct<level, cell>>: the fewest cells [cell * 2**level, (cell + 1) * 2**level) that cover the
    whole numbers from lo up to but not hi: two a level at most."""
    lo, hi = lo.cast("long"), hi.cast("long")

    def at(level: Column) -> Column:
        a, b = -F.call_function("shiftright", -lo, level), F.call_function("shiftright", hi, level)
        cell = lambda odd, c: F.when((a < b) & (F.pmod(odd, F.lit(2)) == 1), F.struct(level.alias("level"), c.alias("cell")))
        return F.array(cell(a, a), cell(b, b - 1))

    top = F.floor(F.log2(F.greatest(hi - lo, F.lit(1)).cast("double"))).cast("int")
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), at)), lambda c: c.isNotNull())


def _parts(lo: Column, hi: Column) -> Column:
    """array<struct<wide, at>>: cells of level HOUR and higher that hold the whole numbers from lo up to but not hi: of
    level HOUR at either end, and between them the fewest."""
    part = lambda wide, at: F.struct(wide.cast("int").alias("wide"), at.cast("long").alias("at"))
    none = F.array().cast("array<struct<wide:int,at:bigint>>")
    a, b = F.shiftright(lo + ((1 << HOUR) - 1), HOUR), F.shiftright(hi, HOUR)  # the first and last full hour's start
    head = F.when(F.shiftleft(a, HOUR) > lo, F.array(part(F.lit(HOUR), a - 1))).otherwise(none)
    tail = F.when(F.shiftleft(b, HOUR) < hi, F.array(part(F.lit(HOUR), b))).otherwise(none)
    whole = F.transform(dyadic_cells(a, b), lambda c: part(c["level"] + HOUR, c["cell"]))
    return F.when(hi <= lo, none).when(a > b, tail).when(a == b, F.concat(head, tail)).otherwise(F.concat(head, whole, tail))


def _meet(spans: DataFrame, commits: DataFrame, unit_ms: int, within: tuple[str, ...], along: tuple[str, ...], only: bool = False) -> DataFrame:
    """``range_matches`` for spans of user_id, sid, lo, hi; with ``only`` user_id and sid of those that have any, once or
    a few times."""
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit = lambda ms: F.floor(F.col(ms) / unit_ms).cast("long")
    parts = spans.select("*", F.inline_outer(_parts(unit("lo"), unit("hi") + 1))).where("at IS NOT NULL")
    place = ["at", "wide", *within]
    held = stored(parts.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "held")
    used = sorted(r["wide"] for r in held.select("wide").distinct().collect())  # a row for each level at most
    crowds = F.broadcast(held.where(F.col("n") > CROWD).select(*place, F.ceil(F.col("n") / CROWD).cast("int").alias("tasks")))
    tasks = F.coalesce("tasks", F.lit(1))

    theirs = ["id", "ts", *(c for c in along if c not in spans.columns)]
    moments = commits.select(*theirs, F.coalesce("assisted", F.lit(False)).alias("assisted"), F.col("user_id").alias("author"), *within, F.explode(F.array(*map(F.lit, used)).cast("array<int>")).alias("wide"))
    moments = moments.withColumn("__unit", unit("ts")).withColumn("at", F.expr("shiftright(__unit, wide)")).drop("__unit")
    block = F.floor((F.row_number().over(W.partitionBy(*place).orderBy("ts")) - 1) / BLOCK)
    blocks = moments.where("assisted").withColumn("__block", block).groupBy(*place, "__block").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.collect_list(F.struct(*theirs, "author")).alias("items"))
    blocks = stored(blocks.drop("__block"), "blocks")

    dealt = [*place, "turn"]
    here = parts.join(crowds, place, "left").withColumn("turn", F.pmod(F.hash("user_id", "sid"), tasks)).drop("tasks")
    there = blocks.join(crowds, place, "left").withColumn("turn", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
    if not only:  # few rows may make very many pairs, so that their own size is no measure for tasks
        here, there = here.repartition(n, *dealt), there.repartition(n, *dealt)
    touched = here.join(there, dealt).where("since <= hi and until >= lo")
    own = parts.join(moments.where("not assisted").withColumn("user_id", F.col("author")), [*place, "user_id"])
    if only:
        some = touched.where(F.exists("items", lambda x: x["ts"].between(F.col("lo"), F.col("hi"))))
        return some.select("user_id", "sid").unionByName(own.where("ts between lo and hi").select("user_id", "sid"))
    anyone = touched.select("user_id", "sid", "lo", "hi", *(c for c in along if c in spans.columns), F.inline("items")).withColumn("assisted", F.lit(True))
    out = ("user_id", "sid", "id", "assisted", F.col("user_id").eqNullSafe(F.col("author")).alias("same_author"), "ts", *along)
    hit = lambda df: df.where("ts between lo and hi").select(*out)
    return hit(anyone).unionByName(hit(own))


def _spans(before_ms: int, after_ms: int) -> tuple[Column, Column]:
    return (F.col("start_ts") - before_ms).alias("lo"), (F.col("end_ts") + after_ms).alias("hi")


def range_matches(sessions: DataFrame, commits: DataFrame, before_ms: int = 60_000, after_ms: int = 300_000, unit_ms: int = 60_000, within: tuple[str, ...] = (), along: tuple[str, ...] = ()) -> DataFrame:
    """user_id, sid, id, assisted, same_author, ts: commits within a session's time, widened on both
    sides, that name an assistant, whoever wrote them, or that the session's user wrote. A session is covered by
    the few hours (64 units) and dyadic cells of hours that hold its time, a month by fewer than 64; a commit lies in one
    cell of each level in use. Both meet by equality, then by an exact test: commits that name an assistant as
    blocks of up to ``BLOCK`` that follow each other in time, so that a session is tested against blocks and only those it
    touches are opened; others with sessions of their own user. Sessions of a crowded hour are dealt to several tasks.
    ``within`` names columns of both, such as a project: rows that differ in them don't meet at all. ``along`` names
    further columns of either that go with a pair."""
    mine = [c for c in along if c in sessions.columns]
    spans = stored(sessions.select("user_id", "sid", *within, *mine, *_spans(before_ms, after_ms)), "spans")
    return _meet(spans, commits, unit_ms, within, along)


def _mentions(outputs: DataFrame, commits: DataFrame, key: list[str]) -> DataFrame:
    """``key``, id: runs of hex digits are joined by every seven-character piece's equality."""
    pieces = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 6), lambda i: F.substring(run, i, 7))
    runs = F.regexp_extract_all("result", F.lit("[0-9a-f]{7,}"), F.lit(0))
    shorts = outputs.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(runs, pieces)))).alias("short"))
    return shorts.join(commits.select("id", F.substring("id", 1, 7).alias("short")), "short").select(*key, "id").distinct()


def output_matches(outputs: DataFrame, commits: DataFrame) -> DataFrame:
    """out_id, id: commits whose id, or its first seven characters, occurs in a command's output."""
    return _mentions(outputs, commits, ["out_id"])


def session_outputs(outputs: DataFrame, commits: DataFrame) -> DataFrame:
    """user_id, sid, id: commits that a session's command output names, for ``outputs`` of user_id, sid,
    out_id, result."""
    return _mentions(outputs, commits, ["user_id", "sid"])


def find_commits(sessions: DataFrame, commits: DataFrame, outputs: DataFrame, along: tuple[str, ...] = ()) -> DataFrame:
    """user_id, sid, id, strategy, and the commit's columns ``along``: what the command outputs name, then assisted
    commits in the session's time, then its user's own; sessions without any get the user's first commit after
    them. Each pair comes once.

    Pairs in a session's time are as many as sessions and assisted commits that lie close, so they aren't shuffled
    again, and are made once. A session carries the commits that its outputs name, which it doesn't get a second time, and all
    others go straight out. Only sessions and commits that are listed twice, and sessions that name more than ``MANY``
    commits, are settled in ``by_priority``. Sessions with a commit after them are asked whether they have any by the
    first and last assisted commit of each minute."""
    key, before_ms, after_ms, unit_ms = ["user_id", "sid"], 60_000, 300_000, 60_000
    named = stored(session_outputs(outputs, commits), "named")
    some = named.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("id"))).where(F.col("n") <= MANY + 1)
    some = some.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.collect_list("id").alias("named"))
    same = F.col("user_id").eqNullSafe(F.col("__user_id")) & F.col("sid").eqNullSafe(F.col("__sid"))
    twice = F.count(F.lit(1)).over(W.partitionBy(*key)) > 1
    spans = sessions.select(*key, "start_ts", "end_ts", twice.alias("odd")).join(some, same, "left").select(*key, "end_ts", *_spans(before_ms, after_ms), "odd", "named")
    # in a time of under a minute the first and last commit of the minute may lie outside, and others in it
    spans = spans.withColumn("odd", F.col("odd") | F.coalesce(F.size("named") > MANY, F.lit(False)) | F.coalesce(F.col("hi") - F.col("lo") < unit_ms, F.lit(False)))
    spans, odd = stored_counting(spans, "sessions", "odd")
    again = F.count(F.lit(1)).over(W.partitionBy("id")) > 1
    at, repeated = stored_counting(commits.select("id", "user_id", "ts", F.coalesce("assisted", F.lit(False)).alias("assisted"), *along, again.alias("again")), "commits", "again")

    meet = lambda s, c, *more, only=False: _meet(s.select(*key, "lo", "hi", *(x for x in more if x == "named")), c, unit_ms, (), more, only)
    near = meet(spans.where("not odd"), at.where("not again"), "named", *along)
    once = near.where(~F.coalesce(F.array_contains("named", F.col("id")), F.lit(False))).select(*key, "id", F.when(F.col("assisted"), "assisted").otherwise("author").alias("strategy"), *along)
    of = at.select(F.col("id").alias("__id"), *along).distinct()
    carry = lambda df: df.join(of, F.col("id").eqNullSafe(F.col("__id")), "left").drop("__id") if along else df
    after = stored(asof_fallback(spans, at.select("id", "user_id", "ts")), "after")
    ends = at.where("assisted").groupBy(F.floor(F.col("ts") / unit_ms)).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    ends = ends.select(F.lit(None).cast("string").alias("id"), F.lit(True).alias("assisted"), F.explode(F.array_distinct(F.array("a", "b"))).alias("ts"))
    asked = stored(spans.where("not odd").select(*key, "lo", "hi").join(after.select(*key), key, "left_semi"), "asked")
    have = meet(asked, at.where("not assisted").unionByName(ends, allowMissingColumns=True), only=True).unionByName(named.select(*key))
    ranked = [("output", carry(named))]
    if odd or repeated:
        others = [meet(spans.where("odd"), at, *along)] * bool(odd) + [meet(spans.where("not odd"), at.where("again"), *along)] * bool(repeated)
        ranked += [(name, df.where(test)) for name, test in (("assisted", "assisted"), ("author", "same_author")) for df in others]
        have = reduce(DataFrame.unionByName, [df.select(*key).distinct() for df in others], have)
    return once.unionByName(by_priority(ranked, carry(after), have, along))


def asof_fallback(sessions: DataFrame, commits: DataFrame, within_ms: int = 3_600_000, bucket_ms: int = 3_600_000) -> DataFrame:
    """user_id, sid, id: the author's first commit at or after a session's end, under ``within_ms``
    later; of equals the smallest id."""
    spans = sessions.select("user_id", "sid", "end_ts").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("end_ts") / bucket_ms), F.floor((F.col("end_ts") + within_ms) / bucket_ms))))
    at = commits.withColumn("bucket", F.floor(F.col("ts") / bucket_ms))
    hit = spans.join(at, ["user_id", "bucket"]).where((F.col("ts") >= F.col("end_ts")) & (F.col("ts") - F.col("end_ts") < within_ms))
    return hit.groupBy("user_id", "sid").agg(F.min_by("id", F.struct("ts", "id")).alias("id"))


def by_priority(matches: list[tuple[str, DataFrame]], fallback: DataFrame, matched: DataFrame | None = None, along: tuple[str, ...] = ()) -> DataFrame:
    """user_id, sid, id, strategy, and columns ``along``: each pair once, by the first strategy that found it; the
    fallback only for sessions that no other strategy matched. ``matched`` has those sessions where they are known."""
    rows = None
    for n, (name, df) in enumerate(matches):
        part = df.select("user_id", "sid", "id", *along, F.struct(F.lit(n).alias("n"), F.lit(name).alias("name")).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("user_id", "sid", "id", *along).agg(F.min("s").alias("s")).select("user_id", "sid", "id", F.col("s.name").alias("strategy"), *along)
    rest = fallback.join(rows.select("user_id", "sid").distinct() if matched is None else matched, ["user_id", "sid"], "left_anti")
    return best.unionByName(rest.select("user_id", "sid", "id", F.lit("fallback").alias("strategy"), *along))


def attach(matches: DataFrame, change_ids: DataFrame, tagged: DataFrame) -> DataFrame:
    """target_type, target_value, user_id, sid: the commit's change id if it has one, else the commit;
    targets that are tagged already are skipped."""
    rows = matches.join(change_ids, "id", "left")
    rows = rows.select(F.when(F.col("change_id").isNotNull(), "change-id").otherwise("commit").alias("target_type"), F.coalesce("change_id", "id").alias("target_value"), "user_id", "sid").distinct()
    return rows.join(tagged.select("target_type", "target_value").distinct(), ["target_type", "target_value"], "left_anti")


def attach_found(sessions: DataFrame, commits: DataFrame, outputs: DataFrame, change_ids: DataFrame, tagged: DataFrame) -> DataFrame:
    """``attach`` for what ``find_commits`` finds. Targets are settled on the commits, before these meet sessions; only
    pairs of targets that stand for several commits are compared afterwards, if there are any."""
    target = ["target_type", "target_value"]
    rows = commits.join(change_ids.select("id", "change_id").distinct(), "id", "left")
    rows = rows.withColumns({"target_type": F.when(F.col("change_id").isNotNull(), "change-id").otherwise("commit"), "target_value": F.coalesce("change_id", "id")})
    several = F.min("id").over(W.partitionBy(*target)) != F.max("id").over(W.partitionBy(*target))
    rows = rows.withColumn("shared", F.col("target_value").isNull() | F.coalesce(several, F.lit(False)))
    rows = rows.join(tagged.select(*target).distinct().withColumn("tagged", F.lit(True)), target, "left").withColumn("open", F.col("tagged").isNull())
    rows, shared = stored_counting(rows.select("id", "user_id", "ts", "assisted", *target, "shared", "open"), "targets", "shared")
    found = find_commits(sessions, rows, outputs, along=(*target, "shared", "open")).where("open")
    pairs = lambda df: df.select(*target, "user_id", "sid")
    return pairs(found.where("not shared")).unionByName(pairs(found.where("shared")).distinct()) if shared else pairs(found)


def untagged(commits: DataFrame, facts: DataFrame, key: str, n: int) -> DataFrame:
    """The newest n commits without a fact of this key."""
    has = facts.where((F.col("target_type") == "commit") & (F.col("key") == key)).select(F.col("target_value").alias("id"))
    return commits.join(has, "id", "left_anti").orderBy(F.desc("ts"), "id").limit(n)


def not_imported(rows: DataFrame, facts: DataFrame, id_col: str, key: str, force: bool = False) -> DataFrame:
    """Rows whose id no fact of this key names yet; all with ``force``."""
    return rows if force else rows.join(facts.where(F.col("key") == key).select(F.col("value").alias(id_col)).distinct(), id_col, "left_anti")


def since_attachment(events: DataFrame, is_attachment: Column) -> DataFrame:
    """Rows with ``part``: the number of attachments of their session before them; an attachment
    closes the part that it ends."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("part", F.coalesce(F.sum(F.when(is_attachment, 1).otherwise(0)).over(w), F.lit(0)))
