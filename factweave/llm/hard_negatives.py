"""Hard negatives by Kronecker-packed inner products.

Vectors are whole numbers here. The same component of several candidates goes into separate fields of one
wide integer: a bias makes it non-negative, and a field is as wide as any sum of products may get. An
anchor's component, biased likewise, is multiplied with that integer once, which adds its product for
every candidate in it; after the last component the fields are unpacked and the bias is taken off again, so
the inner products are exact. Fields share 62 bits where at least one fits, and Python's integers of any
width otherwise.

Anchors go over all candidates in blocks of a bounded number of bytes, each broadcast in turn. A task keeps
the best few of what it has seen for each anchor, so what is shuffled is that few for each anchor and
task, whatever a label's share of the rows; windows pick the best of these. First come each anchor's
positives, then, their scores known, the negatives of each pair. Candidates are stored once, quantised,
and blocks read them again from there; the results of every block are written before the next.

Semantics: the score of a row is its inner product with the anchor; higher scores come first, ties by
smaller id. An anchor's positives are its first ``positives`` other rows of its label; for each of them,
its negatives are the first ``negatives`` rows of another label whose score, as a percentage of the
positive's, lies from ``low`` to ``high`` (``low * positive <= 100 * score <= high * positive``, so that
a negative positive score has none). Fewer come where there are no more. Nulls: a row with a null label, a
null vector or a component that is null or not finite takes no part; a null id is smaller than every
other, comes back as null and is no anchor of the registered query. Vectors of unlike lengths are
filled up with zeros. Repeated rows, or rows that share an id, are rows of their own: each is an anchor,
and may be the positive of its copies. Components beyond 2**53 and scores beyond 2**56 count as these
bounds. An empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import NULL_ID, exists, public_id, scratch, stored

#: Bytes of an anchor block, and of candidates that are scored at once.
ANCHOR_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
LARGEST, HIGHEST = 2**53, 2**56
NO_SCORE = -(2**62)
BEST = "anchor long, nth int, score long, id long, row long"


def finite(vector: str | Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(whole, F.lit(False))


def quantised(vector: str | Column, scale: int, largest: int = LARGEST) -> Column:
    """floor(scale * x) of each component, ``x`` as double."""
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(largest))), F.lit(-float(largest)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width``, filled up with zeros."""
    size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int, size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of all batches in tables of about ``size`` bytes of whole numbers."""
    most, held, n = max(1, size // (8 * max(1, width))), [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            n += held[-1].num_rows
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed_scores(anchors: np.ndarray, candidates: np.ndarray, rows: int = 64) -> np.ndarray:
    """The inner product of each anchor with each candidate (rows of two matrices of whole numbers)."""
    n, width = candidates.shape
    if not n or not len(anchors) or not width:
        return np.zeros((len(anchors), n), np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    most = (int(anchors.max()) - low_a) * (int(candidates.max()) - low_c) * width
    bits = max(1, most.bit_length())
    kind = np.int64 if bits <= 62 else object
    fields = 62 // bits if kind is np.int64 else 4
    a, c = anchors.astype(kind) - low_a, candidates.astype(kind) - low_c
    words = -(-n // fields)
    wide = np.zeros((width, words), kind)  # field f of word w holds candidate f * words + w
    for f in range(fields):
        part = c[f * words : (f + 1) * words]
        wide[:, : len(part)] += (part << (bits * f)).T
    base = low_a * c.sum(axis=1) + width * low_a * low_c
    own, mask = low_c * a.sum(axis=1), (1 << bits) - 1
    out = np.empty((len(a), n), np.int64)
    step = max(1, (1 << 15) // words)
    for at in range(0, len(a), step):
        some = a[at : at + step]
        total = np.zeros((len(some), words), kind)
        for d in range(width):  # one multiplication an anchor's component and word
            total += some[:, d : d + 1] * wide[d]
        for f in range(fields):
            here = slice(f * words, min(n, (f + 1) * words))
            if here.start < n:
                score = ((total >> (bits * f)) & mask)[:, : here.stop - here.start] + base[here] + own[at : at + step, None]
                out[at : at + step, here] = np.clip(score, -HIGHEST, HIGHEST).astype(np.int64) if kind is object else score
    return np.clip(out, -HIGHEST, HIGHEST)


class Best:
    """For each of ``n`` searches the first ``k`` rows seen so far, by score and then id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), NO_SCORE), np.zeros((n, k), np.int64), np.full((n, k), -1)

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """A row of ``score``, ``ids`` and ``rows`` for each search; -1 as row is none."""
        score = np.concatenate((self.score[search], np.where(rows < 0, NO_SCORE, score)), axis=1)
        ids = np.concatenate((self.id[search], ids), axis=1)
        rows = np.concatenate((self.row[search], rows), axis=1)
        order = np.lexsort((ids, -score), axis=-1)[:, : self.k]
        for have, now in ((self.score, score), (self.id, ids), (self.row, rows)):
            have[search] = np.take_along_axis(now, order, axis=1)

    def batch(self, anchors: np.ndarray, nth: np.ndarray) -> pa.RecordBatch:
        at, col = np.nonzero(self.row >= 0)
        found = anchors[at], nth[at].astype(np.int32), self.score[at, col], self.id[at, col], self.row[at, col]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["anchor", "nth", "score", "id", "row"])


def first_of(score: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Of rows in order of their ids, the places of the first k by score, then id."""
    at = np.flatnonzero(ok)
    if len(at) > 4 * k:  # all that may be among them
        bar = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= bar]
    return at[np.argsort(-score[at], kind="stable")[:k]]


class Anchors:
    """A block of anchors, as tasks get it."""

    def __init__(self, frame: pd.DataFrame, width: int):
        self.row, self.label = frame["row"].to_numpy(np.int64), frame["label"].to_numpy(np.int64)
        self.vector = np.zeros((len(frame), width), np.int64)
        for n, v in enumerate(frame["v"]):
            self.vector[n, : len(v)] = v

    def over(self, batches: Iterator[pa.RecordBatch]):
        """(ids, rows, labels, vectors) of candidates by ids, a block at a time."""
        width = self.vector.shape[1]
        for block in blocks(batches, width):
            ids, row, label = (block.column(c).to_numpy() for c in ("id", "row", "label"))
            order = np.argsort(ids, kind="stable")
            yield ids[order], row[order], label[order], matrix(block.column("v").combine_chunks(), width)[order]

    def positives(self, k: int):
        """A function of batches: each anchor's first k other rows of its label."""

        def found(batches):
            best = Best(len(self.row), k)
            for ids, row, label, vector in self.over(batches):
                for one in np.intersect1d(self.label, label):
                    mine, theirs = np.flatnonzero(self.label == one), np.flatnonzero(label == one)
                    score = packed_scores(self.vector[mine], vector[theirs])
                    at = np.full((len(mine), k), -1)
                    for n, a in enumerate(mine):
                        first = first_of(score[n], row[theirs] != self.row[a], k)
                        at[n, : len(first)] = first
                    picked, none = theirs[at], at < 0
                    best.add(mine, np.take_along_axis(score, np.where(none, 0, at), 1), ids[picked], np.where(none, -1, row[picked]))
            yield best.batch(self.row, np.zeros(len(self.row)))

        return found

    def negatives(self, pairs: pd.DataFrame, k: int, low: int, high: int):
        """A function of batches: of each pair (anchor, nth, score) the first k rows of another label in
        the range of scores."""
        place = {row: n for n, row in enumerate(self.row)}
        pairs = pairs.assign(of=pairs["anchor"].map(place)).sort_values(["of", "nth"], ignore_index=True)
        of = pairs["of"].to_numpy(np.int64)
        held = lambda x: min(max(x, -(2**62)), 2**62)
        least = np.array([held(-(-low * int(s) // 100)) for s in pairs["score"]], np.int64)
        most = np.array([held(high * int(s) // 100) for s in pairs["score"]], np.int64)
        used, first = np.unique(of, return_index=True)
        end = np.append(first[1:], len(of))

        def found(batches):
            best = Best(len(of), k)
            for ids, row, label, vector in self.over(batches):
                at = np.full((len(of), k), -1)
                value = np.zeros((len(of), k), np.int64)
                for c in range(0, len(used), 64):
                    scores = packed_scores(self.vector[used[c : c + 64]], vector)
                    for s, a, lo, hi in zip(scores, used[c : c + 64], first[c : c + 64], end[c : c + 64], strict=True):
                        other = np.flatnonzero((label != self.label[a]) & (s >= least[lo:hi].min()) & (s <= most[lo:hi].max()))
                        near = s[other]
                        for p in range(lo, hi):
                            got = other[first_of(near, (near >= least[p]) & (near <= most[p]), k)]
                            at[p, : len(got)], value[p, : len(got)] = got, s[got]
                best.add(np.arange(len(of)), value, ids[at], np.where(at < 0, -1, row[at]))
            yield best.batch(pairs["anchor"].to_numpy(np.int64), pairs["nth"].to_numpy(np.int64))

        return found


def ranked(best: DataFrame, k: int) -> DataFrame:
    """The first k of each (anchor, nth) with their rank; tasks drop the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id", "row"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchor`` tells which
    rows are anchors, by their id, vector and label."""
    spark = vectors.sparkSession
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    whole = vectors.where(F.col(label_col).isNotNull() & finite(vector_col))
    prepared = whole.select(ids.alias("id"), F.col(label_col).cast("long").alias("label"), quantised(vector_col, scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    every = stored(prepared.withColumn("row", F.monotonically_increasing_id()), "vectors")
    width, asking = every.agg(F.max(F.size("v")), F.count_if("asks")).first()
    parts = max(1, -(-asking * 8 * max(1, width or 1) // anchor_bytes))
    out = scratch(spark, "negatives")
    queries = every.where("asks").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    for part in range(parts if asking else 0):  # a bounded block of anchors at a time, against all rows
        frame = queries.where(F.col("part") == part).select("row", "label", "v", "id").toPandas()
        if frame.empty:
            continue
        block = spark.sparkContext.broadcast(Anchors(frame, width))
        found = every.select("id", "row", "label", "v").mapInArrow(lambda batches, k=positives, block=block: block.value.positives(k)(batches), BEST)
        pairs = ranked(found, positives).select("anchor", F.col("rank").alias("nth"), "score", F.col("id").alias("positive"), F.col("row").alias("positive_row"))
        pairs = stored(pairs, "pairs")
        known = spark.sparkContext.broadcast(pairs.select("anchor", "nth", "score").toPandas())
        found = every.select("id", "row", "label", "v").mapInArrow(lambda batches, block=block, known=known: block.value.negatives(known.value, negatives, low, high)(batches), BEST)
        found = ranked(found, negatives).select("anchor", "nth", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
        own = spark.createDataFrame(frame[["row", "id"]], "anchor long, anchor_id long")
        rows = found.join(F.broadcast(pairs), ["anchor", "nth"]).join(F.broadcast(own), "anchor")
        rows.select("anchor_id", "positive", "rank", "negative", F.col("score").alias("positive_score"), "negative_score").write.mode("append").parquet(out)
        known.unpersist()
        block.unpersist()
    schema = "anchor_id long, positive long, rank int, negative long, positive_score long, negative_score long"
    rows = spark.read.schema(schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], schema)
    return rows.select(public_id(F.col("anchor_id")).alias("anchor_id"), public_id(F.col("positive")).alias("positive_id"), "rank", public_id(F.col("negative")).alias("negative_id"), "positive_score", "negative_score")
