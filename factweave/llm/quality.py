"""Quality classifier: random Fourier features over document statistics.

Every text gives a row of statistics (sizes, shares of character classes, repetition of words and
lines). Standardised, they pass through random Fourier features, which approximate a Gaussian
kernel; each partition sums its normal equations, the sums are added in two steps, and the ridge
solution is found on the driver from one D x D matrix, whatever the corpus size. Isotonic
calibration (pool adjacent violators over a histogram of at most ``BINS`` scores) makes the score a
probability. Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0.

Nulls: a null text is empty and gets a score like any other; labels without an id or a value are
ignored, of repeated labels the largest counts; without any usable label every score is 1. A row
that occurs twice gives two rows; an empty table none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import flat_text, learns, mixed, release_memory, stored, text_batches
from factweave.llm.superkmer_dedup import Words

FEATURES, WIDTH, SEED, BINS = 256, 4.0, 11, 1000
_MARKS = [ord(c) for c in "$%&#*!|?,.;:-_=<>{}()/\\\"'@"]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(column) -> np.ndarray:
    """A row of statistics for every text of an Arrow column."""
    flat, offs = flat_text(column)
    n = len(offs) - 1
    if not n:
        return np.zeros((0, 23 + len(_MARKS)))
    size = np.diff(offs)
    hist = np.bincount(np.repeat(np.arange(n) * 256, size) + flat, minlength=256 * n).reshape(n, 256)
    words = Words(flat, offs)
    count = np.diff(words.of)
    doc = np.repeat(np.arange(n), count)
    total = lambda x: np.bincount(doc, x, n)
    upper, lower, digit = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1), hist[:, 48:58].sum(1)
    high, space = hist[:, 128:].sum(1), hist[:, [9, 10, 11, 12, 13, 32]].sum(1)
    tail = words.data[np.maximum(words.start + words.size - 1, 0)] if len(doc) else np.zeros(0, np.uint8)
    mark = np.isin(tail, [ord(c) for c in "$%&#*!|@^~"])
    same = np.zeros(len(doc), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    owner = (key[at] >> np.uint64(40)).astype(np.int64)
    runs = np.diff(np.append(at, len(key)))
    distinct = np.bincount(owner, minlength=n)
    most, seen_twice = np.zeros(n), np.bincount(owner, runs >= 3, n)
    np.maximum.at(most, owner, runs)
    # lines: by the sum of their scrambled word hashes
    new_line = np.flatnonzero(flat == 10)
    line_of = np.searchsorted(new_line, _word_bytes(words, flat, offs)) if len(doc) else np.zeros(0, np.int64)
    cut = np.ones(len(doc), bool)
    cut[1:] = (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(cut)
    sums = np.add.reduceat(mixed(words.hash), starts) if len(starts) else np.zeros(0, np.uint64)
    line_doc = doc[starts]
    lkey = np.sort((line_doc.astype(np.uint64) << np.uint64(40)) | (mixed(sums) >> np.uint64(24)))
    lfirst = np.ones(len(lkey), bool)
    lfirst[1:] = lkey[1:] != lkey[:-1]
    lines = np.bincount(line_doc, minlength=n)
    kinds = np.bincount((lkey[lfirst] >> np.uint64(40)).astype(np.int64), minlength=n)
    mean = _ratio(total(words.size), count)
    spread = np.sqrt(np.maximum(0, _ratio(total(words.size.astype(float) ** 2), count) - mean**2))
    cols = [
        np.log1p(size), np.log1p(count), mean, spread, _ratio(total(words.size > 15), count), _ratio(total(words.size <= 2), count),
        _ratio(upper, size), _ratio(lower, size), _ratio(digit, size), _ratio(high, size), _ratio(space, size), _ratio(upper, upper + lower),
        _ratio(total(mark), count), _ratio(total(same), count), _ratio(distinct, count), _ratio(most, count), _ratio(seen_twice, distinct),
        np.log1p(lines), _ratio(kinds, lines), _ratio(count, lines), _ratio(distinct, np.sqrt(np.maximum(count, 1))),
        _ratio(hist[:, 10], size), (hist > 0).sum(1) / 64.0, *(_ratio(hist[:, m], count) for m in _MARKS),
    ]
    return np.stack(cols, 1).astype(np.float64)


def _word_bytes(words: Words, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where every word begins in the batch's bytes."""
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    before = np.ones(len(flat) + 1, bool)
    before[1:] = space
    before[offs] = True
    return np.flatnonzero(~space & before[:-1])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.shift)), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weight) or not len(x):
            return np.ones(len(x))
        return np.clip(np.interp(self.expand(x) @ self.weight, self.raw, self.level), 0.0, 1.0)


def scored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step := _step(batch)):
                piece = batch.slice(at, step)
                x = statistics(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["doc_id", "x"])
        release_memory()

    text_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, x array<float>")


def _step(batch: pa.RecordBatch, most: int = 1 << 20) -> int:
    return max(1, int(len(batch) * most / max(most, batch.nbytes)))


def _stack(values) -> np.ndarray:
    return np.stack(values.to_numpy()) if len(values) else np.zeros((0, 23 + len(_MARKS)))


def pooled(raw: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: mean score and level of each block."""
    blocks: list[list[float]] = []
    for x, h, m in zip(raw, hits, n, strict=True):
        blocks.append([x * m, h, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality", ridge: float = 1e-2) -> Model:
    """Learns from the labelled rows that may be learned from."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    train = stored(features.join(y.where(learns(F.col("doc_id"))), "doc_id").select("x", "y"), "labelled")

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, 0.0, 0.0
        for p in parts:
            x = _stack(p["x"]).astype(float)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            yield pd.DataFrame({"n": [np.array([float(n)]).tobytes()], "s": [s.tobytes()], "q": [q.tobytes()]})

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for p in parts:
            for row in p.itertuples(index=False):
                row = [np.frombuffer(v) for v in row]
                sums = row if sums is None else [a + b for a, b in zip(sums, row, strict=True)]
        if sums is not None:
            yield pd.DataFrame([[s.tobytes() for s in sums]], columns=["n", "s", "q"])

    binary = "n binary, s binary, q binary"

    def two_steps(sums_of) -> list[list[np.ndarray]]:
        """Sums of each partition, added up in four tasks; one Python worker to a task in both steps."""
        added_up = train.mapInPandas(sums_of, binary).repartition(4).mapInPandas(added, binary)
        return [[np.frombuffer(v) for v in r] for r in added_up.collect()]  # 4 rows at most

    got = two_steps(moments)
    empty = np.zeros(0)
    if not got:
        return Model(*([empty] * 7))
    n, s, q = (sum(x) for x in zip(*got, strict=True))
    mean = s / n
    scale = np.sqrt(np.maximum(q / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    turn = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
    model = Model(mean, scale, turn, rng.uniform(0, 2 * np.pi, FEATURES), empty, empty, empty)

    def equations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, a, b = 0, 0.0, 0.0
        for p in parts:
            for at in range(0, len(p), 2000):
                z, v = model.expand(_stack(p["x"][at : at + 2000]).astype(float)), p["y"].to_numpy(float)[at : at + 2000]
                n, a, b = n + len(z), a + z.T @ z, b + z.T @ v
        if n:
            yield pd.DataFrame({"n": [np.array([float(n)]).tobytes()], "s": [a.tobytes()], "q": [b.tobytes()]})

    n, a, b = (sum(x) for x in zip(*two_steps(equations), strict=True))
    d = len(b)
    model.weight = np.linalg.solve(a.reshape(d, d) + ridge * n[0] / FEATURES * np.eye(d), b)

    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            raw = model.expand(_stack(p["x"]).astype(float)) @ model.weight
            yield pd.DataFrame({"bin": np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32), "y": p["y"]})

    rows = train.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("hits"), F.count("y").alias("n")).toPandas().sort_values("bin")
    raw, level = pooled((rows["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, rows["hits"].to_numpy(float), rows["n"].to_numpy(float))
    model.raw, model.level = raw, level + np.arange(len(level)) * 1e-9
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    features = stored(scored_features(docs, id_col, text_col), "statistics")
    model = fit(features, labels, label_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "score": model.score(_stack(p["x"]).astype(float))})

    return _decided(features.mapInPandas(run, "doc_id long, score double"), threshold)


def _decided(scores: DataFrame, threshold: float) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, all columns kept; texts aren't shuffled."""
    model = fit(scored_features(docs, id_col, text_col), labels, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step := _step(batch)):
                piece = batch.slice(at, step)
                text = piece.column(piece.schema.get_field_index(text_col)).cast(pa.string()).fill_null("")
                yield piece.filter(pa.array(model.score(statistics(text).astype(np.float32).astype(float)) >= threshold))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
