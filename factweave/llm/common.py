"""Helpers shared by the corpus operators: the shared folder, document keys, and the
numpy routines that walk whole Arrow batches of text without a Python object per token."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id sorts before every other id.
NULL_ID = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_local_dir: list[str] = []
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one only where none is set and all tasks run
    in one process (tests); on a cluster, executors couldn't see it."""
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return f"file://{_local_dir[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _run.get()) is not None:
        own.append(path)
    return path


@contextmanager
def scratch_run() -> Iterator[list[str]]:
    """A list of all paths that ``scratch`` gives inside, in this thread: what may be dropped when no frame
    that reads them is needed any more."""
    token = _run.set([])
    try:
        yield _run.get()
    finally:
        _run.reset(token)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole table was written there."""
    fs, at = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = _at(spark, path)
        fs.delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    df.write.parquet(path := scratch(spark, name))
    return spark.read.schema(schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> SparkSession:
    """Has this session hand rows to Python in batches of ``rows`` and ``size`` bytes at most from now
    on (a longer row comes alone). Plans read the setting when they run, so it stays set; every
    operator of this package that has Python read texts calls this itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def by_bytes(column, most: int = 1 << 20):
    """An Arrow column of texts in slices of about ``most`` bytes, one text at least."""
    step = max(1, int(len(column) * most / max(most, column.nbytes)))
    for at in range(0, len(column), step):
        yield column.slice(at, step)


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and what they keep
    is missing to the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, dig, text): rows with the same id and text are one document; a null id sorts
    first, a null text is empty. ``dig`` tells apart different texts under one id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("dig"), text.alias("text")
    )


def public_id(did: Column) -> Column:
    return F.when(did != F.lit(NULL_ID), did)


def learns(doc_id: Column) -> Column:
    """True for rows whose labels may be learned from: crc32 of the id's digits mod 5 is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def flat_text(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary column and its n+1 offsets, without copying."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def rolled(x: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every k neighbouring values: scrambled base-``base`` number, by doubling."""
    with np.errstate(over="ignore"):
        power, part, out, have, b = 1, x, None, 0, base
        while True:
            if k & power:
                if out is None:
                    out, have = part, power
                else:
                    n = min(len(out), len(part) - have)
                    out = out[:n] * np.uint64(b) + part[have : have + n]
                    have += power
            if power * 2 > k:
                return mixed(out)
            part = part[:-power] * np.uint64(b) + part[power:]
            b = b * b % 2**64
            power *= 2


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean array of length n, True inside any [start, end)."""
    if not len(starts):
        return np.zeros(n, bool)
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every piece, one piece after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lens > 0
    starts, lens = starts[keep], lens[keep]
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    out[at] = starts
    out[at[1:]] -= starts[:-1] + lens[:-1] - 1
    return np.cumsum(out)


def gathered(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, step: int = 4 << 20) -> np.ndarray:
    """The pieces of ``data``, one after the other; indices are made for ``step`` bytes at a time."""
    total = np.cumsum(lens)
    if not len(lens):
        return data[:0]
    out, at, done = np.empty(int(total[-1]), data.dtype), 0, 0
    while at < len(lens):
        to = max(at + 1, int(np.searchsorted(total, done + step, "right")))
        out[done : int(total[to - 1])] = data[ragged(starts[at:to], lens[at:to])]
        at, done = to, int(total[to - 1])
    return out


def minimiser_runs(grams: np.ndarray, width: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive valid windows that share their leftmost smallest gram:
    first window, number of windows, position of the gram. Which gram a window takes
    depends on the window's content only."""
    n = len(ok)
    at = np.uint64((1 << 24) - 1)
    low = sliding_min((grams & ~at) | np.arange(len(grams), dtype=np.uint64), width)[:n]
    pos = (low & at).astype(np.int64)
    cut = np.ones(n + 1, bool)
    cut[1:n] = (pos[1:] != pos[:-1]) | (ok[1:] != ok[:-1])
    at_cut = np.flatnonzero(cut)
    first, size = at_cut[:-1], np.diff(at_cut)
    live = ok[first]
    return first[live], size[live], pos[first[live]]


def multikey_groups(word, n: int, depth: int, first: np.ndarray) -> np.ndarray:
    """Multikey quicksort of n strings, a machine word at a time: strings are parted by
    ``first``, then by word 0, word 1, ...; a string that has no equal left is done. Returns
    a group number per string, the same for equal strings; strings found unique get -1.
    ``word(i, d)`` gives word d of the strings i as unsigned 64-bit values."""
    group = np.full(n, -1, np.int64)
    live = np.arange(n)
    _, part = np.unique(first, return_inverse=True)
    for d in range(depth + 1):
        size = np.bincount(part)
        stay = size[part] > 1
        live, part = live[stay], part[stay]
        if not len(live):
            return group
        if d == depth:
            break
        w = word(live, d)
        order = np.lexsort((w, part))
        p, v = part[order], w[order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
        live, part = live[order], np.cumsum(new) - 1
    group[live] = part
    return group
