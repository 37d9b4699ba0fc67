"""Importers: pull requests, session checkpoints, review trails and authorship notes become facts.

Each gives rows of target_type, target_value, key, value_type, value, ts in write order: the writes of
one source are put in one array, in order, so that a write's time is the source's time plus its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators.shared import stored

PR = (
    "number long, title string, body string, url string, headRefName string, baseRefName string, mergedAt string, "
    "mergeCommit struct<oid:string,messageHeadline:string>, commits array<struct<oid:string,messageHeadline:string>>, "
    "comments array<struct<author:struct<login:string,name:string>,body:string,url:string,createdAt:string>>, "
    "reviews array<struct<author:struct<login:string,name:string>,state:string,body:string,url:string,submittedAt:string>>, closingIssuesReferences array<struct<number:long,url:string>>"
)
#: Characters of pull requests that meet their commits in one task.
PART = 16 * 2**20
WRITE = "struct<target_type:string,target_value:string,key:string,value_type:string,value:string>"


def _write(kind: Column | str, target: Column, key: Column | str, value_type: str, value: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("target_type"), target.alias("target_value"), lit(key).alias("key"), F.lit(value_type).alias("value_type"), value.cast("string").alias("value"))


def _one(write: Column, when: Column | None = None) -> Column:
    none = F.array().cast(f"array<{WRITE}>")
    return F.array(write) if when is None else F.when(when, F.array(write)).otherwise(none)


def _each(items: Column, write) -> Column:
    return F.transform(F.coalesce(items, F.array()), write)


def _rows(df: DataFrame, writes: list[Column], ts: Column, keep: list[str]) -> DataFrame:
    every = F.concat(*(w.cast(f"array<{WRITE}>") for w in writes))
    rows = df.select(*keep, ts.alias("t0"), F.posexplode(every).alias("pos", "w")).where("w is not null")  # null: time that passes unused
    return rows.select(*keep, "w.*", (F.col("t0") + F.col("pos")).alias("ts"))


def _names(entries: Column) -> Column:
    who = F.transform(F.coalesce(entries, F.array()), lambda r: C.author_identity(r["author"]["login"], r["author"]["name"]))
    return F.array_sort(F.array_distinct(F.filter(who, lambda w: w.isNotNull())))


def _comments(entries: Column, kind: str, at: str) -> Column:
    """JSON of the entries that say anything."""
    said = F.filter(F.coalesce(entries, F.array()), lambda c: F.coalesce(F.trim(F.translate(c["body"], "\n\t\r", "")), F.lit("")) != "")
    return F.transform(said, lambda c: F.to_json(F.struct(
        F.lit(kind).alias("kind"), C.author_identity(c["author"]["login"], c["author"]["name"]).alias("author"), c["body"].alias("body"), c["url"].alias("url"), c[at].alias("created_at")), {"ignoreNullFields": "false"}))


def import_pull_requests(pulls: DataFrame, commits: DataFrame, repo: str) -> DataFrame:
    """``pulls`` has a json column; ``commits`` id, author, ts (seconds) of known commits. Commits that
    aren't known write nothing. Pull requests are parsed once and meet their commits in as many parts as their
    texts fill, so that a task's memory stays the same for any number of them."""
    seen = Observation()
    p = pulls.select(F.from_json("json", PR).alias("p"), F.length("json").cast("long").alias("size")).where("p.number is not null")
    p = stored(p.observe(seen, F.sum("size").alias("size")).select("p.*"), "pulls")
    parts = max(p.sparkSession.sparkContext.defaultParallelism, -(-(seen.get["size"] or 0) // PART))
    none = F.array().cast("array<struct<oid:string,messageHeadline:string>>")
    listed = F.coalesce("commits", none)
    extra = F.when(F.col("mergeCommit.oid").isNotNull() & ~F.array_contains(F.transform(listed, lambda c: c["oid"]), F.col("mergeCommit.oid")), F.array("mergeCommit")).otherwise(none)
    p = p.withColumns({"commits": F.concat(listed, extra), "headRefName": F.coalesce("headRefName", F.lit("unknown"))})
    each = p.select("number", F.posexplode("commits").alias("pos", "c")).select("number", "pos", F.col("c.oid").alias("id"), F.coalesce("c.messageHeadline", F.lit("")).alias("subject"))
    found = each.join(commits.select("id", "author", F.col("ts").alias("at")), "id")
    kept = found.repartition(parts, "number").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "subject", "author", "at"))).alias("found"))
    rows = p.repartition(parts, "number").join(kept, "number", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<pos:int,id:string,subject:string,author:string,at:bigint>>")))
    rows = rows.withColumns({"branch": C.branch_id("headRefName", "number"), "merged": F.coalesce(C.rfc3339_ms("mergedAt"), F.lit(0).cast("long"))})
    b, one, proj = F.col("branch"), F.lit("branch"), F.lit("")
    string = lambda key, v, when=None: _one(_write(one, b, key, "string", v), when)
    members = lambda key, items: _each(items, lambda x: _write(one, b, key, "set", x))
    refs = F.coalesce("closingIssuesReferences", F.array().cast("array<struct<number:bigint,url:string>>"))
    issues = F.array_sort(F.array_distinct(F.concat(F.transform(F.filter(refs, lambda r: r["number"].isNotNull()), lambda r: F.concat(F.lit("#"), r["number"].cast("string"))), C.closing_issues(F.coalesce("body", F.lit(""))))))
    approvals = F.filter(F.coalesce("reviews", F.array()), lambda r: F.upper(r["state"]) == "APPROVED")

    def of_commit(c: Column) -> Column:
        kind = C.conventional_type(c["subject"])
        return F.concat(
            F.array(_write("commit", c["id"], "branch-id", "string", b)), _one(_write("commit", c["id"], "conventional:type", "set", kind["type"]), kind["type"].isNotNull()),
            _one(_write("commit", c["id"], "conventional:type", "set", F.lit("breaking")), F.coalesce(kind["breaking"], F.lit(False))))

    writes = [
        string("title", F.col("title")), string("description", F.coalesce("body", F.lit(""))), string("review:number", F.col("number")), string("review:url", F.col("url")),
        string("github:head-ref", F.col("headRefName")), string("github:base-ref", F.col("baseRefName"), F.col("baseRefName").isNotNull()),
        members("issue:id", issues), members("issue:url", F.array_sort(F.array_distinct(F.filter(F.transform(refs, lambda r: r["url"]), lambda u: u.isNotNull())))), members("review:reviewed", _names(F.col("reviews"))), members("review:approved", _names(approvals)),
        _each(F.concat(_comments(F.col("comments"), "comment", "createdAt"), _comments(F.col("reviews"), "review", "submittedAt")), lambda c: _write(one, b, "review:comment", "list", c)),
        F.flatten(F.transform("found", of_commit)),
        members("commits:author", F.array_sort(F.array_distinct(F.col("found.author")))), members("commits:author-date", F.array_sort(F.array_distinct(F.col("found.at")))),
        _one(_write("project", proj, "github:repo", "string", F.lit(repo))), _one(_write("project", proj, "github:last-imported-merged-at", "string", F.col("merged"))), _one(_write("project", proj, "github:imported-pr", "set", F.col("number"))),
    ]
    return _rows(rows, writes, F.col("merged"), ["number"])


def imported_numbers(facts: DataFrame) -> DataFrame:
    """number of every pull request that the project's facts name as imported."""
    own = facts.where("target_type = 'project' and key = 'github:imported-pr'")
    return own.select(F.col("value").try_cast("long").alias("number")).where("number is not null").distinct()


def skipped_pull_requests(pulls: DataFrame, known: DataFrame | None = None, since_s: int | None = None, force: bool = False) -> DataFrame:
    """``pulls`` with ``number`` and ``skipped``: merged before ``since_s`` (a missing time is 0) or,
    unless ``force``, among the ``known`` numbers."""
    rows = pulls.withColumn("number", F.get_json_object("json", "$.number").try_cast("long"))
    merged = F.coalesce(C.rfc3339_ms(F.get_json_object("json", "$.mergedAt")), F.lit(0).cast("long"))
    early = F.lit(False) if since_s is None else merged < since_s * 1000
    if known is None or force:
        return rows.withColumn("skipped", early)
    return rows.join(known.select("number", F.lit(True).alias("known")), "number", "left").withColumn("skipped", early | F.col("known").isNotNull()).drop("known")


def import_summary(pulls: DataFrame, facts: DataFrame, commits: DataFrame, known: DataFrame | None = None, since_s: int | None = None, force: bool = False) -> DataFrame:
    """One row: fetched, skipped, imported, comments, missing commits, writes. ``facts`` are those that
    the pull requests wrote which weren't skipped."""
    each = skipped_pull_requests(pulls, known, since_s, force)
    named = each.where("not skipped").select(F.explode(F.from_json("json", PR)["commits"]["oid"]).alias("id"))
    parts = [
        each.agg(F.count(F.lit(1)).alias("fetched"), F.count_if("skipped").alias("skipped")), facts.agg(F.count_distinct("number").alias("imported"), F.count_if(F.col("key") == "review:comment").alias("comments"), F.count(F.lit(1)).alias("writes")),
        named.join(commits.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing_commits")),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for x in parts[1:]:
        out = out.join(x.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


#: Fields of a checkpoint's metadata and the keys they are kept under.
FIELDS = (("agent", "agent"), ("model", "model"), ("turnId", "turn-id"), ("turn_id", "turn-id"), ("sessionId", "session-id"), ("session_id", "session-id"),
          ("attribution", "attribution"), ("summary", "summary"), ("tokenUsage", "token-usage"), ("token_usage", "token-usage"))


def import_checkpoints(commits: DataFrame, files: DataFrame, trailer: str = "Entire-Checkpoint") -> DataFrame:
    """Checkpoint files of commits that name a checkpoint in a trailer. ``files`` has checkpoint,
    session (0 first), name, content. Keys lie under ``agent``, of later sessions under
    ``agent:session-N``; a task's checkpoint and its agents' lines under ``tasks`` and its name."""
    named = commits.select("id", (F.col("ts") * 1000).alias("ms"), F.explode(C.trailers("message", trailer)).alias("checkpoint"))
    wide = files.groupBy("checkpoint", "session").agg(*(F.max(F.when(F.col("name") == n, F.col("content"))).alias(a) for n, a in (("metadata.json", "meta"), ("prompt.txt", "prompt"), ("full.jsonl", "full"), ("content_hash.txt", "hash"))))
    part = F.regexp_extract("name", "^tasks/([^/]+)/(checkpoint\\.json|agent-[^/]*\\.jsonl)$", 2)
    task = F.regexp_extract("name", "^tasks/([^/]+)/", 1)
    tasks = files.where(F.col("name").startswith("tasks/")).select("checkpoint", "session", task.alias("task"), part.alias("part"), "content").where("part <> ''")
    point = F.col("part") == "checkpoint.json"
    lines = F.when(point, F.array("content")).otherwise(F.filter(F.split("content", "\r?\n"), lambda x: C.strip(x) != ""))
    tasks = tasks.select("checkpoint", "session", "task", (~point).alias("agents"), F.when(point, "checkpoint").otherwise(F.regexp_replace("part", "\\.jsonl$", "")).alias("part"), lines.alias("lines"))
    grouped = tasks.groupBy("checkpoint", "session").agg(F.sort_array(F.collect_list(F.struct("task", "agents", "part", "lines"))).alias("tasks"))
    rows = named.join(wide, "checkpoint").join(grouped, ["checkpoint", "session"], "left")
    prefix = F.when(F.col("session") == 0, "agent").otherwise(F.concat(F.lit("agent:session-"), F.col("session").cast("string")))
    rows = rows.withColumns({"prefix": prefix, "tasks": F.coalesce("tasks", F.array().cast("array<struct<task:string,agents:boolean,part:string,lines:array<string>>>"))})
    key = lambda name: F.concat("prefix", F.lit(f":{name}"))
    put = lambda name, v, when: _one(_write("commit", F.col("id"), key(name), "string", v), when)
    none = F.array().cast(f"array<{WRITE}>")

    def of_task(t: Column) -> Column:
        """Its checkpoint, then each agent's lines as a list, after which a moment passes."""
        at = F.concat("prefix", F.lit(":tasks:"), C.sanitise(t["task"]), F.lit(":"), C.sanitise(t["part"]))
        lines = lambda kind: F.transform(t["lines"], lambda x: _write("commit", F.col("id"), at, kind, x))
        gap = F.when(F.size(t["lines"]) > 0, F.array(F.lit(None).cast(WRITE))).otherwise(none)
        return F.when(t["agents"], F.concat(lines("list").cast(f"array<{WRITE}>"), gap)).otherwise(lines("string").cast(f"array<{WRITE}>"))

    writes = [put(name, F.get_json_object("meta", f"$.{field}"), F.get_json_object("meta", f"$.{field}").isNotNull()) for field, name in FIELDS]
    writes += [
        put("prompt", F.col("prompt"), F.col("prompt").isNotNull()), put("transcript", F.col("full"), F.coalesce(F.trim(F.translate("full", "\n", "")) != "", F.lit(False))), put("content-hash", F.trim("hash"), F.col("hash").isNotNull()),
        F.flatten(F.transform("tasks", of_task)),
    ]
    return _rows(rows, writes, F.col("ms"), ["checkpoint", "session"])


def import_trails(files: DataFrame, known: DataFrame, ts: int) -> DataFrame:
    """Branch facts of review trails; ``files`` has trail, name, content; trails that a fact names
    already are skipped. The branch's name ends in a hash of the trail id."""
    wide = files.groupBy("trail").agg(F.max(F.when(F.col("name") == "metadata.json", F.col("content"))).alias("meta"), F.max(F.when(F.col("name") == "checkpoints.json", F.col("content"))).alias("points"))
    rows = wide.where("meta is not null").join(known.where("key = 'review:trail-id'").select(F.col("value").alias("trail")), "trail", "left_anti")
    rows = rows.withColumn("branch", F.concat(F.coalesce(F.get_json_object("meta", "$.branch"), F.lit("unknown")), F.lit("-"), F.substring(F.sha1("trail"), 1, 8)))
    field = lambda f: F.get_json_object("meta", f"$.{f}")
    put = lambda key, v, when=None: _one(_write("branch", F.col("branch"), key, "string", v), when)
    writes = [put("review:trail-id", F.col("trail"))]
    writes += [put(f"review:{f}", field(f), field(f).isNotNull()) for f in ("title", "body", "status", "type", "author", "priority", "base", "assignees", "labels", "reviewers")]
    points = F.coalesce(F.from_json("points", "array<string>"), F.array().cast("array<string>"))
    writes.append(F.transform(points, lambda x: _write("branch", F.col("branch"), "review:checkpoints", "list", x)))
    return _rows(rows, writes, F.lit(ts).cast("long"), ["trail"])


def parse_note(text: Column | str) -> Column:
    """struct<blame, schema_version, tool_version, model> of ``blame, a line of ---, json``; null without
    the line or with JSON that doesn't parse."""
    t = F.col(text) if isinstance(text, str) else text
    at = F.instr(t, "\n---\n")
    start = t.startswith("---\n")
    body = F.when(start, F.substring(t, F.lit(5), F.length(t))).when(at > 0, F.substring(t, at + 5, F.length(t)))
    blame = F.when(start, F.lit("")).otherwise(F.regexp_replace(F.substring(t, F.lit(1), at - 1), "\\s+$", ""))
    prompts = F.from_json(F.get_json_object(body, "$.prompts"), "map<string,struct<agent_id:struct<tool:string,model:string>>>")
    who = F.filter(F.transform(F.map_values(prompts), lambda p: p["agent_id"]), lambda a: a.isNotNull())
    models = F.array_distinct(F.transform(who, lambda a: F.concat(F.coalesce(a["tool"], F.lit("unknown")), F.lit("/"), F.coalesce(a["model"], F.lit("unknown")))))
    model = F.when(F.coalesce(F.size(models), F.lit(0)) > 0, F.array_join(models, ", ")).otherwise("unknown")
    ok = body.isNotNull() & F.json_object_keys(body).isNotNull()
    return F.when(ok, F.struct(blame.alias("blame"), F.coalesce(F.get_json_object(body, "$.schema_version"), F.lit("unknown")).alias("schema_version"), F.get_json_object(body, "$.git_ai_version").alias("tool_version"), model.alias("model")))


def import_notes(notes: DataFrame, commits: DataFrame) -> DataFrame:
    """Facts of notes on known commits; the keys are one segment each."""
    rows = notes.join(commits.select("id", (F.col("ts") * 1000).alias("ms")), "id").select("id", "ms", F.explode(F.array(parse_note("text"))).alias("n")).where("n is not null")
    put = lambda key, v: _one(_write("commit", F.col("id"), key, "string", v), v.isNotNull())
    return _rows(rows, [put("agent.blame", F.col("n.blame")), put("agent.schema-version", F.col("n.schema_version")), put("agent.tool-version", F.col("n.tool_version")), put("agent.model", F.col("n.model"))], F.col("ms"), ["id"])
