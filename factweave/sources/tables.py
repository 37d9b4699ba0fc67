"""The tables of a fact store, with declared schemas, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "target_type string, target_value string, key string"
SCHEMAS = {
    "mutations": f"seq long, {K}, op string, value string, value_type string, idx int, email string, ts long",
    "state_values": f"{K}, value_type string, value string, last_ts long, is_ref boolean, is_promised boolean",
    "state_list": f"{K}, entry_name string, value string, ts long",
    "state_set": f"{K}, member_id string, value string, ts long",
    "tombstones": f"tombstone_type string, {K}, entry_id string, value string, ts long, email string",
    "blobs": "content_id string, content string",
    "snapshot_files": "version string, dest string, path string, content string",
    "commits": "id string, parents array<string>, author_name string, author_email string, ts long, message string, version string",
}
TRANSCRIPT = "type string, role string, sessionId string, timestamp string, isMeta boolean, content string, message struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint>,content:string>, bad string"


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{store}/{name}")


def write_table(df: DataFrame, store: str, name: str, mode: str = "append") -> None:
    """Writes with the table's columns; values lie by target type, sorted for skipping."""
    names = [f.split()[0] for f in SCHEMAS[name].replace("array<string>", "array").split(", ")]
    out = df.select(*names)
    out.sortWithinPartitions(*[c for c in ("target_type", "target_value", "key") if c in names]).write.mode(mode).parquet(f"{store}/{name}")


def read_mutations(spark: SparkSession, store: str) -> DataFrame:
    return read_table(spark, store, "mutations")


def read_state(values: DataFrame, entries: DataFrame, members: DataFrame) -> DataFrame:
    """K, value_type, value, items: facts with their payloads by type; promised rows come bare."""
    key = ["target_type", "target_value", "key"]
    lists = entries.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("l"))
    sets = members.groupBy(*key).agg(F.sort_array(F.collect_set("value")).alias("s"))
    rows = values.join(lists, key, "left").join(sets, key, "left")
    items = F.when(F.col("is_promised"), F.lit(None)).when(F.col("value_type") == "list", F.col("l.value")).when(F.col("value_type") == "set", F.col("s"))
    return rows.select(*key, "value_type", "value", items.alias("items"), "is_promised")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSONL transcripts of two layouts; lines that don't parse are dropped."""
    rows = spark.read.schema(TRANSCRIPT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.where("bad is null").select(
        F.col("sessionId").alias("session_id"), F.coalesce("type", "role").alias("type"), "timestamp", F.coalesce("isMeta", F.lit(False)).alias("is_meta"),
        F.coalesce("message.content", "content").alias("content"), F.col("message.model").alias("model"),
        F.col("message.usage.input_tokens").alias("input_tokens"), F.col("message.usage.output_tokens").alias("output_tokens"),
    )
