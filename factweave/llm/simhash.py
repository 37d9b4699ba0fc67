"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: XXH64 (seed 42) of every 3-word shingle of the lower-cased text, a bit set where more
than half of the hashes have it. Equal fingerprints are one node, pre-aggregated before any shuffle.

Links (three differing bits or fewer): of four blocks of 16 bits, such a pair shares one, so each
fingerprint goes to four groups. A group sorts its fingerprints by Gray rank, so that neighbours
differ in few bits, and builds a tree over this order, four children to a node: a node holds the
bits that all fingerprints below it share and that no upper node holds yet. Pairs of nodes are
compared from the top; the differences of the shared bits accumulate on the way down and a pair is
pruned, with all below it, as soon as they exceed the distance. The groups' fingerprint counts (at
most 4 x 65536 numbers) pack small groups into buckets and part a group that is too large by four
12-bit blocks of the other bits, of which a pair must share one again. A bucket returns a spanning
set of links, never all pairs; components over all buckets are found by alternating large-star and
small-star joins, with tables cut in the shared folder between rounds.

Nulls: a null text has no words and fingerprint zero, which links like any other; a null doc_id is
smaller than every other id and comes back as null. A row that occurs twice gives two rows; an empty
table none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import NULL_ID, keyed, public_id, release_memory, stored, text_batches

LEAF = 8
FAN = 4
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ONE = np.uint64(1)


def shingle_hashes(raw: bytes, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every shingle of ``size`` words, joined by single spaces."""
    words = raw.translate(_FOLD).split()
    if not words:
        return []
    text = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(text, seed)]
    at = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], seed) for a, b in zip(at[:-size].tolist(), (at[size:] - 1).tolist(), strict=True)]


def fingerprint(raw: bytes, size: int = 3, seed: int = 42) -> int:
    hashes = shingle_hashes(raw, size, seed)
    if not hashes:
        return 0
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42, row_key: bool = False) -> DataFrame:
    """(did, fp), with ``row_key`` (did, dig, fp): fp holds the 64 bits as a signed number."""
    names = ["did", "dig"] if row_key else ["did"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_buffer().to_pybytes(), size, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.array(fp, np.uint64).view(np.int64))], [*names, "fp"])

    text_batches(docs.sparkSession)
    return keyed(docs, id_col, text_col).select(*names, "text").mapInArrow(run, "".join(f"{c} long, " for c in names) + "fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def tree(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of the index over sorted fingerprints, leaves' level first: (mask of the bits that all
    below share and no upper node holds, their values), a node per place. The last level is the root."""
    ones = [np.bitwise_and.reduceat(fps, np.arange(0, len(fps), LEAF))]
    zeros = [np.bitwise_and.reduceat(~fps, np.arange(0, len(fps), LEAF))]
    while len(ones[-1]) > 1:
        cut = np.arange(0, len(ones[-1]), FAN)
        ones.append(np.bitwise_and.reduceat(ones[-1], cut))
        zeros.append(np.bitwise_and.reduceat(zeros[-1], cut))
    levels = []
    for k in range(len(ones)):
        mask = ones[k] | zeros[k]
        if k + 1 < len(ones):
            up = np.arange(len(mask)) // FAN
            mask = mask & ~(ones[k + 1] | zeros[k + 1])[up]
        levels.append((mask, ones[k] & mask))
    return levels


def linked(fps: np.ndarray, distance: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i < j, of different fingerprints within ``distance``: the tree against itself.
    A spanning set: what is left of a pruned frontier is compared in steps and joined as it comes."""
    order = np.argsort(gray_rank(fps), kind="stable")
    x = fps[order]
    levels = tree(x)
    parent = np.arange(len(x))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int16))]
    while stack:
        k, a, b, acc = stack.pop()
        if len(a) > step:
            half = len(a) // 2
            stack += [(k, a[:half], b[:half], acc[:half]), (k, a[half:], b[half:], acc[half:])]
            continue
        if k == 0:  # leaves: the fingerprints themselves
            few = max(1, step // LEAF)  # a pair of leaves is LEAF * LEAF pairs of fingerprints
            for at in range(0, len(a), few):
                i = (a[at : at + few, None] * LEAF + np.arange(LEAF)).repeat(LEAF, 1)
                j = np.tile(b[at : at + few, None] * LEAF + np.arange(LEAF), (1, LEAF))
                i, j = i.ravel(), j.ravel()
                in_range = (i < j) & (j < len(x))
                i, j = i[in_range], j[in_range]
                near = np.bitwise_count(x[i] ^ x[j]) <= distance
                _join(parent, i[near], j[near])
            continue
        n = len(levels[k - 1][0])
        ca = (a[:, None] * FAN + np.arange(FAN)).repeat(FAN, 1).ravel()
        cb = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
        acc = acc.repeat(FAN * FAN)
        keep = (ca <= cb) & (cb < n)
        ca, cb, acc = ca[keep], cb[keep], acc[keep]
        mask, value = levels[k - 1]
        acc = acc + np.bitwise_count((value[ca] ^ value[cb]) & mask[ca] & mask[cb])
        keep = acc <= distance
        stack.append((k - 1, ca[keep], cb[keep], acc[keep]))
    root = _roots(parent)
    own = np.flatnonzero(root != np.arange(len(x)))
    return order[root[own]], order[own]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j: smallest root wins, repeated until all pairs agree."""
    while len(i):
        root = _roots(parent)
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _bucket(distance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in pdf.groupby(["key", "sub"], sort=False):
            if len(group) > 1:
                fps = group["fp"].to_numpy(np.int64)
                i, j = linked(fps.view(np.uint64), distance)
                out.append(pd.DataFrame({"a": np.minimum(fps[i], fps[j]), "b": np.maximum(fps[i], fps[j])}))
        release_memory()
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return run


def links(fps: DataFrame, distance: int = 3, bucket_rows: int = 25_000, hot_rows: int = 200_000) -> DataFrame:
    """(a, b): links that span the components of the distinct fingerprints in column fp."""
    if not 0 <= distance <= 3:
        raise ValueError("the four blocks of 16 bits find distances from 0 to 3")
    spark = fps.sparkSession
    block = lambda x, at, bits: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1))
    four = F.explode(F.array(*(F.lit(t * 65536) + block(F.col("fp"), 16 * t, 16) for t in range(4)))).alias("key")
    by_block = fps.select("fp", four.alias("key")).withColumn("key", F.col("key").cast("int"))
    size = by_block.groupBy("key").count().where("count > 1")  # 262,144 rows at most
    size = size.withColumn("hot", F.col("count") > hot_rows)
    total = fps.count() * 4
    buckets = max(1, -(-total // bucket_rows))
    # of a hot group, the 48 other bits in four blocks of 12: a pair shares one of these too
    table = F.floor(F.col("key") / 65536).cast("int")
    rest = F.when(table == 0, F.shiftrightunsigned("fp", 16))
    for t in (1, 2, 3):
        low = F.col("fp").bitwiseAND(F.lit((1 << 16 * t) - 1))
        high = F.shiftrightunsigned("fp", 16 * (t + 1)) if t < 3 else F.lit(0).cast("long")
        rest = rest.when(table == t, high * F.lit(1 << 16 * t) + low)
    parted = by_block.join(F.broadcast(size.select("key", "hot")), "key").withColumn("rest", rest)
    subs = F.when(F.col("hot"), F.array(*(F.lit(t * 4096) + block(F.col("rest"), 12 * t, 12) for t in range(4)))).otherwise(F.array(F.lit(-1).cast("long")))
    parted = parted.select("fp", "key", F.explode(subs).alias("sub"))
    bucket = F.pmod(F.xxhash64("key", "sub"), F.lit(buckets))
    # few bytes, much work: as many tasks as buckets, which the size of the rows would not give
    tasks = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets))
    return stored(parted.withColumn("bucket", bucket).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(_bucket(distance), "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (a, b): alternating large-star and small-star joins,
    the root being the smallest node."""
    edges = edges.where("a != b")
    while True:
        # large star: larger neighbours of u go to u's smallest neighbour
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("u"))).where("a != b").distinct()
        new = stored(small, "stars")
        sums = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (edges, new)]
        if sums[0] == sums[1]:
            return new.select(F.col("b").alias("node"), F.col("a").alias("root")).union(new.select("a", "a").distinct())
        edges = new


def labelled(rows: DataFrame, low: Column, distance: int, **how) -> DataFrame:
    """(fp, component): the smallest ``low`` in the component of every fingerprint of ``rows``."""
    own = stored(rows.groupBy("fp").agg(F.min(low).alias("low")), "distinct")
    roots = components(links(own.select("fp"), distance, **how))
    each = roots.join(own.select(F.col("fp").alias("node"), "low"), "node")
    group = each.groupBy("root").agg(F.min("low").alias("component"))
    named = roots.join(group, "root").select(F.col("node").alias("fp"), "component")
    # stored, so that both sides of the last join are exchanged anew and a fingerprint that a third
    # of the documents share can be split
    return stored(own.join(named, "fp", "left").select("fp", F.coalesce("component", "low").alias("component")), "labels")


def near_duplicates(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id linked, itself
    included) for every document."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    label = labelled(rows, F.col("did"), distance, **how)
    return rows.join(label, "fp").select(
        public_id(F.col("did")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), public_id(F.col("component")).alias("component_id")
    )


def one_of_each(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The row with the smallest id, then text hash, of every component, columns as they were. Rows
    are told apart by id and text, so that only members of one component replace each other."""
    rows = stored(fingerprints(docs, id_col, text_col, row_key=True), "fingerprints")
    key = F.struct("did", "dig")
    gone = rows.join(labelled(rows, key, distance, **how), "fp").where(key != F.col("component")).select("did", "dig").distinct()
    did, dig = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = docs.withColumns({"__did": did, "__dig": dig})
    left = own.join(gone, (F.col("__did") == gone["did"]) & (F.col("__dig") == gone["dig"]), "left_anti")
    # keys are tested without their texts; only where some repeat are texts shuffled once more
    if not rows.groupBy("did", "dig").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["__did", "__dig"])
    return left.select(*docs.columns)
