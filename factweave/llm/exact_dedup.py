"""Exact dedup as a stateful stream.

The documents folder is read as a stream of micro-batches; the state, one entry per digest of the
normalised text, never expires and lies in RocksDB on the executors' disks with its checkpoint in
the shared folder. An entry holds the stable identifier (the largest doc_id), the content locator
of that row (file and row in it) and the number of rows. Copies are pre-aggregated in each task
before they reach the state, so a text that makes up a third of the corpus is a few rows there.
On a hit (an entry of several rows) the full bytes of every row are compared with those at the
locator; digests that turn out to stand for different texts are grouped again by the texts. Only
texts whose digest may have a hit are shuffled for that, as a bitmap of the hits' digests tells.

Semantics: texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
largest doc_id stays; of rows that share it, the one that is last by locator. Nulls: a null text
is empty, a null id is smaller than every other (and comes back as null). Every input row gives a
row; an empty table gives none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import NULL_ID, lower_ascii, public_id, scratch, stored

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """(did, loc, norm, digest) of every row; loc is the row's file and number in it."""
    norm = lower_ascii(F.col(text_col).cast("string"))
    meta = df.metadataColumn("_metadata")  # even where the table has a column of that name
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
        F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias("loc"),
        norm.alias("norm"),
    ).withColumn("digest", digest(F.col("norm")))


def may_be_in(rows: DataFrame, keys: DataFrame, column: str, most_bits: int = 1 << 27) -> DataFrame:
    """All rows whose ``column`` is in ``keys``, and few others: two bits to a value in a bitmap of 16
    bits to a key, ``most_bits`` (16 MB) at most; the more keys beyond that, the more others pass."""
    bits = 1 << 16
    while bits < min(most_bits, 16 * keys.count()):
        bits *= 2
    spots = lambda h: (F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(h), F.lit(bits)))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda p: F.shiftright(p, 6).cast("int")
    words = keys.select(F.explode(F.array(*spots(F.xxhash64(column)))).alias("p")).groupBy(word(F.col("p")).alias("w")).agg(F.bit_or(bit(F.col("p"))).alias("b"))
    every = keys.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    dense = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("bitmap"))
    bitmap = stored(dense, "bitmap").scalar()
    there = lambda p: F.get(bitmap, word(p)).bitwiseAND(bit(p)) != 0
    # exploded, so that a costly column is worked out once, not at each mention of its hash
    hashed = rows.withColumn("__hash", F.explode(F.array(F.xxhash64(column))))
    one, two = spots(F.col("__hash"))
    return hashed.where(there(one) & there(two)).drop("__hash")


def keep_state(spark: SparkSession, path: str, checkpoint: str, id_col: str, text_col: str, digest, batch_bytes: int) -> DataFrame:
    """Runs all that is new under ``path`` through the state at ``checkpoint`` and returns the
    state: (digest, did, loc, n). A second call with the same checkpoint reads new files only."""
    schema = spark.read.parquet(path).schema
    whole = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"  # as a pattern, the path may be one file too
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(whole)
    best = F.max(F.struct("did", "loc")).alias("best")
    state = located(stream, id_col, text_col, digest).groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
    with settings(spark, ROCKS):
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        entries = spark.read.format("statestore").load(checkpoint)
        best_col, n_col = (f"value.{f.name}" for f in entries.schema["value"].dataType.fields)
        return stored(entries.select(F.col("key.digest").alias("digest"), F.col(f"{best_col}.did").alias("keep"), F.col(f"{best_col}.loc").alias("keep_loc"), F.col(n_col).alias("n")), "digests")


def dedup_exact(spark: SparkSession, path: str, checkpoint: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest=sha, batch_bytes: int = 64 << 30) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of the Parquet table at
    ``path``. With a ``checkpoint`` of an earlier call only files new since then enter the state."""
    checkpoint = checkpoint or scratch(spark, "exact-state")
    state = keep_state(spark, path, checkpoint, id_col, text_col, digest, batch_bytes)
    rows = located(spark.read.parquet(path), id_col, text_col, digest)
    out = ("did", "loc", "keep", "keep_loc", "n", "hash")
    hash_of = F.lower(F.hex("digest")) if digest is sha else F.sha2("norm", 256)

    # texts without a hit are told by their digests alone and stay where they are
    hits = stored(state.where("n > 1"), "hits")
    single = rows.select("did", "loc", "digest", hash_of.alias("hash")).join(hits.select("digest"), "digest", "left_anti")
    single = single.select("did", "loc", F.col("did").alias("keep"), F.col("loc").alias("keep_loc"), F.lit(1).cast("long").alias("n"), "hash")

    # hits: full bytes of each row against those at the locator
    near = stored(may_be_in(rows, hits, "digest"), "near")
    at = F.col("loc") == F.col("keep_loc")
    owners = near.withColumnRenamed("norm", "kept_norm").drop("did").join(hits.withColumn("loc", F.col("keep_loc")), ["digest", "loc"]).drop("loc")
    checked = near.join(stored(owners, "owners"), "digest").select(*out[:-1], hash_of.alias("hash"), "digest", (F.col("norm") == F.col("kept_norm")).alias("same"))
    checked = stored(checked, "checked")
    wrong = checked.where(~F.col("same")).select("digest").distinct()
    result = single.unionByName(checked.select(*out))
    if not wrong.isEmpty():  # one digest, different texts: group these by the texts themselves
        mixed = stored(near.join(wrong, "digest").select("did", "loc", "norm"), "mixed")
        group = mixed.groupBy("norm").agg(F.max(F.struct("did", "loc")).alias("best"), F.count(F.lit(1)).alias("n"))
        redone = mixed.join(group, "norm").select("did", "loc", F.col("best.did").alias("keep"), F.col("best.loc").alias("keep_loc"), "n", F.sha2("norm", 256).alias("hash"))
        result = single.unionByName(checked.join(wrong, "digest", "left_anti").select(*out)).unionByName(redone)
    return result.select(
        public_id(F.col("did")).alias("doc_id"), public_id(F.col("keep")).alias("keep_id"), F.col("n").alias("group_size"),
        at.alias("kept"), F.col("hash").alias("text_sha256"),
    )
