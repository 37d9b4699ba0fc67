"""The watching side as Structured Streaming: tailing transcripts, closing idle sessions, commits once,
prompts to change ids, and facts kept current from the mutation stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from factweave.functions import scalars as C
from factweave.operators.shared import scratch, stored
from factweave.operators.state import K
from factweave.sources.tables import TRANSCRIPT

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def tail(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of new transcript files; what was read before is known from the checkpoint."""
    return spark.readStream.schema(TRANSCRIPT).option("maxFilesPerTrigger", files_per_batch).json(path)


def classify_lines(lines: DataFrame) -> DataFrame:
    """session_id, kind (prompt, answer, turn-end), text of lines that matter. Works on streams and tables."""
    texts = C.content_texts(F.coalesce("message.content", "content"))
    kind = (
        F.when((F.col("type") == "user") & ~F.coalesce("isMeta", F.lit(False)) & (F.size(texts) > 0), "prompt")
        .when((F.col("type") == "assistant") & (F.size(texts) > 0), "answer").when(F.col("type") == "system", "turn-end")
    )
    return lines.select(F.col("sessionId").alias("session_id"), "timestamp", kind.alias("kind"), F.array_join(texts, "\n").alias("text")).where("kind is not null")


def idle_sessions(rows: DataFrame, key: str, at: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """key, start, end, n of sessions that saw no row for ``gap``; on a stream each comes once, when the
    watermark has passed its end. Later rows are dropped and counted in the query's progress."""
    stream = rows.withWatermark(at, late) if rows.isStreaming else rows
    s = stream.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return s.select(key, F.unix_millis("first").alias("start_ms"), F.unix_millis("last").alias("end_ms"), "n")


def session_transcripts(rows: DataFrame, key: str, at: str, text: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """key, end_ms, transcript of closed sessions: their lines in order."""
    stream = rows.withWatermark(at, late) if rows.isStreaming else rows
    s = stream.groupBy(key, F.session_window(at, gap)).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("line")))).alias("l"), F.max(at).alias("last"))
    return s.select(key, F.unix_millis("last").alias("end_ms"), F.array_join(F.col("l.line"), "\n").alias("transcript"))


def to_last_branch(transcripts: DataFrame, branches: DataFrame, key: str) -> DataFrame:
    """Closed sessions with the branch that was last committed to before their end, null where there
    was none by then; ``branches`` has key, ts (ms), branch."""
    b = branches.select(F.col(key).alias("__key"), "ts", "branch")
    hit = transcripts.join(b, (F.col(key) == F.col("__key")) & (F.col("ts") <= F.col("end_ms")), "left")
    return hit.groupBy(key, "end_ms").agg(F.max_by("branch", "ts").alias("branch"), F.max("transcript").alias("transcript"))


def commits_once(commits: DataFrame, at: str = "at", late: str = "1 day") -> DataFrame:
    """Each commit once, however often it is announced within the watermark."""
    return commits.withWatermark(at, late).dropDuplicatesWithinWatermark(["id"]) if commits.isStreaming else commits.dropDuplicates(["id"])


PROMPTS = "session string, commit_id string, prompts string, n int"


class Gather(StatefulProcessor):
    """Open prompts of a session as a list state: a batch appends its own, and only its first commit, which takes
    them all, reads them. Rows come as they are: sessions have few in a batch, and a frame for each costs more."""

    def init(self, handle) -> None:
        self.open = handle.getListState("open", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        new: list[str] = []
        first = True
        for r in sorted(rows, key=lambda r: (r.ts is None, r.ts or 0, r.seq is None, r.seq or 0)):
            if r.kind == "prompt":
                new.append(r.text)
                continue
            if first and (held := [x[0] for x in self.open.get()]):
                new = held + new
                self.open.clear()
            yield Row(session=key[0], commit_id=r.text, prompts="|".join(new), n=len(new))
            new, first = [], False
        if new:
            self.open.appendList([(text,) for text in new])

    def close(self) -> None:
        pass


def prompts_to_commits(events: DataFrame) -> DataFrame:
    """session, commit_id, prompts, n: prompts since the session's commit before. ``events`` is a stream
    of session, ts, seq, kind (prompt or commit), text; ``run_once`` sets the state store that it needs."""
    return events.groupBy("session").transformWithState(Gather(), PROMPTS, "append", "none")


@contextmanager
def state_settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs all that is available into Parquet in the shared folder and returns that table."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    with state_settings(spark):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-checkpoint")).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def keep_current(mutations: DataFrame, store: str) -> DataFrame:
    """Folds a stream of mutations into the newest write of each key, K, op, value, ts, seq, and returns all
    of them. The writes are the stream's state, in RocksDB with its changes in the checkpoint under ``store``: a
    batch costs what it touches, and the state data source reads them back. A second call goes on where
    the first stopped."""
    spark = mutations.sparkSession
    # of equal (ts, seq) the larger op and value, so that a batch that runs again folds alike
    newest = mutations.groupBy(*K).agg(F.max(F.struct("ts", "seq", "op", "value")).alias("l"))
    with state_settings(spark):
        q = newest.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        state = spark.read.format("statestore").load(f"{store}/checkpoint")
        held = f"value.{state.schema['value'].dataType.fields[0].name}"
        return stored(state.select("key.*", F.col(f"{held}.op"), F.col(f"{held}.value"), F.col(f"{held}.ts"), F.col(f"{held}.seq")), "current")
