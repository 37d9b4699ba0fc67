"""Queries of the streaming operators: each writes its rows as files, streams them through and returns
what came out."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators.shared import scratch
from factweave.plans.registry import query
from factweave.streaming import exchange as X
from factweave.streaming import watch as W

KC = "target_type, target_value, key"
FAR = 4_000_000_000_000


def _stream(s, df, parts: int = 2, per_batch: int = 1):
    """The rows as a stream of ``parts`` files, ``per_batch`` at a time."""
    path = scratch(s.spark, "in")
    df.repartition(parts).write.parquet(path)
    return s.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _with_end(s, df):
    """A row in the far future, in a file of its own, closes all sessions before it. All files of the
    table are one batch, so none of its rows is late."""
    path = scratch(s.spark, "in")
    df.repartition(4).write.parquet(path)
    _end(df).limit(1).write.mode("append").parquet(path)
    return s.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(path)


def _end(df, files: int = 4):
    """Rows of the far future, each in a file of its own."""
    far = {"at": F.timestamp_millis(F.lit(FAR)), "user_id": F.lit(-1).cast("long")}
    rows = df.sparkSession.range(0, files, 1, files)
    return rows.select(*(far[f.name].alias(f.name) if f.name in far else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))


@query("t1_tail", "SELECT 's' || conv_id AS session_id, role AS type, count(*) AS n FROM {chat} GROUP BY ALL")
def t1(s):
    """New transcript files, read as a stream; lines that don't parse have no session."""
    path = scratch(s.spark, "lines")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.col("text").alias("content")))
    s.chat.select(line.alias("value")).repartition(3).write.text(path)
    rows = W.run_once(W.tail(s.spark, path, 1).select(F.col("sessionId").alias("session_id"), "type"), "tail")
    return rows.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("t2_classify_lines", """
SELECT 's' || conv_id AS session_id, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'answer' ELSE 'turn-end' END AS kind, trim(text) AS text FROM {chat} WHERE role <> 'user' OR turn <> 4""")
def t2(s):
    rows = s.chat.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.col("role").alias("type"), F.lit("").alias("timestamp"), (F.col("turn") == 4).alias("isMeta"), "text")
    lines = rows.select("sessionId", "type", "timestamp", "isMeta", F.lit(None).cast("string").alias("content"), F.struct(F.col("text").alias("content")).alias("message"))
    return W.classify_lines(lines).drop("timestamp")


SESSIONS = "SELECT user_id, start_ts AS start_ms, end_ts AS end_ms, n FROM {sessions}"


@query("t3_idle_sessions", SESSIONS)
def t3(s):
    rows = s.ev.select("user_id", F.timestamp_millis("ts").alias("at"))
    return W.run_once(W.idle_sessions(_with_end(s, rows), "user_id", "at", "30 minutes"), "idle").where("user_id >= 0")


@query("t3_idle_sessions_batch", SESSIONS)
def t3b(s):
    return W.idle_sessions(s.ev.select("user_id", F.timestamp_millis("ts").alias("at")), "user_id", "at", "30 minutes")


@query("t4_session_transcripts", """
WITH e AS (SELECT user_id, s.sid, s.end_ts, string_agg(event_type || event_id, chr(10) ORDER BY ts, event_type || event_id) AS transcript FROM {ev} JOIN {sessions} s USING (user_id) WHERE ts BETWEEN s.start_ts AND s.end_ts GROUP BY ALL),
b AS (SELECT user_id, ts, 'b' || event_id % 5 AS branch FROM {purchases})
SELECT user_id, end_ts AS end_ms, transcript, (SELECT arg_max(branch, b.ts) FROM b WHERE b.user_id = e.user_id AND b.ts <= e.end_ts) AS branch FROM e""")
def t4(s):
    rows = s.ev.select("user_id", F.timestamp_millis("ts").alias("at"), F.concat("event_type", F.col("event_id").cast("string")).alias("line"))
    closed = W.run_once(W.session_transcripts(_with_end(s, rows), "user_id", "at", "line", "30 minutes"), "transcripts")
    branches = s.purchases.select("user_id", "ts", F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string")).alias("branch"))
    return W.to_last_branch(closed, branches, "user_id").where("user_id >= 0")


@query("t5_commits_once", "SELECT id, user_id FROM {purchases}")
def t5(s):
    rows = s.purchases.select("id", "user_id", F.timestamp_millis("ts").alias("at"))
    return W.run_once(W.commits_once(_stream(s, rows.unionByName(rows), 3, 3), late="400 days"), "once").select("id", "user_id")


@query("t6_prompts_to_commits", """
WITH e AS (SELECT user_id, event_id, ts, event_type, k, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM {ev} WHERE event_type IN ('purchase', 'view'))
SELECT CAST(user_id AS VARCHAR) AS session, max('c' || event_id) FILTER (event_type = 'purchase') AS commit_id, coalesce(string_agg('p' || event_id, '|' ORDER BY ts, event_id) FILTER (event_type = 'view'), '') AS prompts, CAST(count(*) FILTER (event_type = 'view') AS INT) AS n
FROM e GROUP BY user_id, part HAVING count(*) FILTER (event_type = 'purchase') > 0""")
def t6(s):
    kind = F.when(F.col("event_type") == "purchase", "commit").otherwise("prompt")
    rows = s.ev.where("event_type in ('purchase', 'view')").select(F.col("user_id").cast("string").alias("session"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.when(kind == "commit", "c").otherwise("p"), F.col("event_id").cast("string")).alias("text"))
    mid = rows.agg(F.percentile_approx("ts", 0.5)).first()[0] or 0
    path = scratch(s.spark, "in")
    rows.where(F.col("ts") <= mid).repartition(4).write.parquet(path)  # older rows first: files go by age, four to a batch
    rows.where(F.col("ts") > mid).repartition(4).write.mode("append").parquet(path)
    return W.run_once(W.prompts_to_commits(s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)), "prompts")


@query("t7_bursts", "SELECT user_id, count(*) AS n FROM {purchases} GROUP BY user_id")
def t7(s):
    """Bursts of announcements: one trigger takes all files there are, and commits count once."""
    rows = s.purchases.select("id", "user_id", F.timestamp_millis("ts").alias("at"))
    once = W.run_once(W.commits_once(_stream(s, rows.unionByName(rows), 4, 100), late="400 days"), "bursts")
    return once.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("t8_keep_current", f"SELECT {KC}, op, value FROM (SELECT *, row_number() OVER (PARTITION BY {KC} ORDER BY ts DESC, seq DESC) AS n FROM {{mut}}) x WHERE n = 1")
def t8(s):
    return W.keep_current(_stream(s, s.mut, 3), scratch(s.spark, "current")).select("target_type", "target_value", "key", "op", "value")


@query("t9_late_rows", """
WITH g AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {ev} WHERE event_id % 10 > 0),
x AS (SELECT user_id, ts, sum(CASE WHEN gap > 1800000 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS start_ms, max(ts) AS end_ms, count(*) AS n FROM x GROUP BY user_id, sid""")
def t9(s):
    """Rows that come after their session closed are dropped: the late batch holds every tenth event.
    Batches are four files each: rows in time, twice rows of the far future, late rows. Rows count as late by the
    watermark of the batch before theirs, so the second far batch closes all sessions, and no late row finds one open."""
    rows = s.ev.select("user_id", F.timestamp_millis("ts").alias("at"), "event_id")
    path = scratch(s.spark, "in")
    rows.where("event_id % 10 > 0").repartition(4).write.parquet(path)
    _end(rows).write.mode("append").parquet(path)
    _end(rows).write.mode("append").parquet(path)
    rows.where("event_id % 10 = 0").repartition(4).write.mode("append").parquet(path)
    stream = s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    return W.run_once(W.idle_sessions(stream, "user_id", "at", "30 minutes"), "late").where("user_id >= 0")


@query("m15_exchange", f"SELECT {KC}, value_type, id, value FROM {{base}} UNION ALL SELECT {KC}, value_type, id, value FROM {{remote}} ANTI JOIN {{base}} USING ({KC})")
def m15(s):
    """Two stores and a shared head: one pushes its snapshot, the other pulls, merges and pushes."""
    shared = X.Exchange(s.spark, scratch(s.spark, "exchange"))
    X.push(shared, s.base)
    return X.push(shared, s.remote.join(s.base.select("target_type", "target_value", "key").distinct(), ["target_type", "target_value", "key"], "left_anti"))


