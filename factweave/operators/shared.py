"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path there; a temporary folder only where none is set and all tasks run in one process
    (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='spark-facts-')}")
        top = _local[0]
    _written.append(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole table was written there."""
    fs, at = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = _at(spark, path)
        fs.delete(at, True)


def clear(spark: SparkSession, mark: int = 0) -> None:
    """Removes all that this process wrote there since ``len(_written)`` was ``mark``: call it when no
    frame that reads it is needed any more."""
    while len(_written) > mark:
        remove(spark, _written.pop())


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The frame written there and read back: cuts lineage, survives lost executors. ``by`` are columns
    to write in folders of their own, so that a filter on them reads no other."""
    schema = df.schema
    df.write.partitionBy(*by).parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(schema).parquet(path).select(*df.columns)


def stored_counting(df: DataFrame, name: str, condition: str = "true") -> tuple[DataFrame, int]:
    """``stored``, and how many of its rows meet the condition, counted as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name)
    return out, seen.get["n"]
