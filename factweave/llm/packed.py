"""Packed records: a run of windows that share an anchor travels as one byte string.

Used by the suffix and the super-k-mer operators. A record is (document key, position of its
first window, number of windows, anchor offset, bytes). Records bound for one bucket are laid
out column by column and compressed, so that a shuffle moves few, large, compressed rows.

Buckets are solved one after another from rows sorted by bucket, so a task holds one bucket at a
time. A bucket that turns out to hold more than ``limit`` bytes, because of an anchor that very many
different windows share, isn't solved there: its windows go on one by one, dealt by their own content
over ``FAN`` buckets, in another round. Equal windows still meet, and what is equal within a task goes
on once only, so each round shrinks or parts what is left. Nothing is sampled or capped for this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import gathered, release_memory, stored

FIELDS = ("did", "dig", "pos", "nwin", "aoff", "size")
KINDS = {"did": np.int64, "dig": np.int64, "pos": np.int64, "nwin": np.int32, "aoff": np.int32, "size": np.int32}
#: Rows between the steps: packed records bound for a bucket, or, without a blob, a span that is settled.
OUT = "bucket int, blob binary, did long, dig long, lo long, hi long, digest binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("did", pa.int64()), ("dig", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.binary())])
FAN, MOST_TASKS = 1024, 100_000


@dataclass
class Records:
    """Columns of records; ``data`` holds their bytes one after the other."""

    did: np.ndarray
    dig: np.ndarray
    pos: np.ndarray
    nwin: np.ndarray
    aoff: np.ndarray
    size: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.did)

    @property
    def start(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.size, dtype=np.int64)))[: len(self)]

    def take(self, index: np.ndarray) -> "Records":
        data = gathered(self.data, self.start[index], self.size[index].astype(np.int64))
        return Records(*(getattr(self, f)[index] for f in FIELDS), data)

    def pack(self) -> bytes:
        head = np.int64(len(self)).tobytes()
        body = b"".join(np.ascontiguousarray(getattr(self, f), KINDS[f]).tobytes() for f in FIELDS) + self.data.tobytes()
        return head + zstandard.ZstdCompressor(level=3).compress(body)

    @staticmethod
    def unpack(blob: bytes) -> "Records":
        n, body, at, cols = int(np.frombuffer(blob[:8], np.int64)[0]), zstandard.ZstdDecompressor().decompress(blob[8:]), 0, []
        for f in FIELDS:
            cols.append(np.frombuffer(body, KINDS[f], n, at))
            at += cols[-1].nbytes
        return Records(*cols, np.frombuffer(body, np.uint8, offset=at))

    @staticmethod
    def joined(parts: list["Records"]) -> "Records":
        return Records(*(np.concatenate([getattr(p, f) for p in parts]) for f in (*FIELDS, "data")))

    def ordered(self) -> np.ndarray:
        """Record numbers by document key, then position."""
        return np.lexsort((self.pos, self.dig, self.did))

    def later_equals(self) -> tuple[np.ndarray, np.ndarray]:
        """For every record, whether its bytes stay (the earliest of equal ones) and, of those
        that go, whether they repeat an earlier place (not the same place read twice)."""
        stays, repeats = np.ones(len(self), bool), np.zeros(len(self), bool)
        raw, start = self.data.tobytes(), self.start
        order = self.ordered()
        seen: dict[bytes, int] = {}
        for i, a, b in zip(order.tolist(), start[order].tolist(), (start + self.size)[order].tolist(), strict=True):
            j = seen.setdefault(raw[a:b], i)
            if j != i:
                stays[i] = False
                repeats[i] = self.pos[i] != self.pos[j] or self.did[i] != self.did[j] or self.dig[i] != self.dig[j]
        return stays, repeats


def by_bucket(records: Records, bucket: np.ndarray):
    """(bucket, blob) for every bucket that gets records."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for piece in np.split(order, cuts) if len(order) else ():
        yield int(bucket[piece[0]]), records.take(piece).pack()


def fused(did, dig, lo, hi):
    """Spans of one document that touch or overlap become one; order is by document and place."""
    if not len(lo):
        return did, dig, lo, hi
    o = np.lexsort((lo, dig, did))
    did, dig, lo, hi = did[o], dig[o], lo[o], hi[o]
    new = np.ones(len(o), bool)
    same = (did[1:] == did[:-1]) & (dig[1:] == dig[:-1])
    doc = np.concatenate(([0], np.cumsum(~same)))
    # running maximum of the ends, kept apart by document through an offset
    step = int(hi.max()) + 1
    far = np.maximum.accumulate(hi + doc * step) - doc * step
    new[1:] = ~same | (lo[1:] > far[:-1])
    first = np.flatnonzero(new)
    return did[first], dig[first], lo[first], np.maximum.reduceat(far, first)


def blob_row(bucket: int, blob: bytes) -> pa.RecordBatch:
    zero = [0]  # not null: pandas would turn nullable 64-bit keys into floats
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([bucket], [blob], zero, zero, zero, zero, [None]), SCHEMA, strict=True)], schema=SCHEMA)


def span_rows(bucket, did, dig, lo, hi, digest=None, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    n = len(lo)
    bucket = np.broadcast_to(np.asarray(bucket, np.int32), n)
    for at in range(0, n, step):
        k = slice(at, at + step)
        size = len(lo[k])
        cols = (bucket[k], pa.nulls(size, pa.binary()), did[k], dig[k], lo[k], hi[k], pa.nulls(size, pa.binary()) if digest is None else digest[k])
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)


def raw_bytes(blob) -> int:
    """How large the records of a blob are; reads its head only."""
    return zstandard.frame_content_size(blob[8:64].to_pybytes())


def _solve(solve: Callable, split: Callable, spans_of: Callable, limit: int, round_: int):
    """Solves bucket after bucket of sorted rows; see the module's head."""

    def spill(bucket: int, blobs: list) -> Iterator[pa.RecordBatch]:
        one = split(Records.joined([Records.unpack(b) for b in blobs]))
        stays, repeats = one.later_equals()
        yield from span_rows(0, *fused(*spans_of(one, repeats)))
        one = one.take(np.flatnonzero(stays))
        raw, start = one.data.tobytes(), one.start
        hashes = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + one.size).tolist(), strict=True)], np.uint64)
        sub = (hashes >> np.uint64(10 * round_ % 60)) % np.uint64(FAN)
        to = np.array([xxhash.xxh32_intdigest(f"{round_}/{bucket}/{k}") >> 1 for k in range(FAN)], np.int64)[sub.astype(np.int64)]
        for b, blob in by_bucket(one, to):
            yield blob_row(b, blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, size, over, ready = None, [], 0, False, []

        def done() -> Iterator[pa.RecordBatch]:
            if over and blobs:
                yield from spill(bucket, blobs)
            elif blobs:
                yield from solve([Records.unpack(b) for b in blobs], ready)
            if ready and (over or not blobs):
                yield from span_rows(0, *fused(*(np.concatenate(x) for x in zip(*ready, strict=True))))

        for batch in batches:
            keys, blank = batch.column("bucket").to_numpy(), np.asarray(batch.column("blob").is_null())
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if keys[a] != bucket:
                    yield from done()
                    bucket, blobs, size, over, ready = int(keys[a]), [], 0, False, []
                at = a + np.flatnonzero(blank[a:b])
                if len(at):
                    ready.append(tuple(batch.column(c).to_numpy()[at] for c in ("did", "dig", "lo", "hi")))
                for i in (a + np.flatnonzero(~blank[a:b])).tolist():
                    blob = batch.column("blob")[i].as_buffer()
                    blobs.append(blob.to_pybytes())
                    size += raw_bytes(blob)
                    if size > limit and len(blobs) > 1:  # two at least, so that each round has fewer copies
                        over = True
                        yield from spill(bucket, blobs)
                        blobs, size = [], 0
        yield from done()
        release_memory()

    return run


def solved(packed: DataFrame, buckets: int, solve: Callable, split: Callable, spans_of: Callable, limit: int, name: str) -> DataFrame:
    """Spans (rows of OUT without a blob) of packed rows. ``solve(records, ready)`` gives the rows of a
    bucket's records and settled spans, ``split(records)`` their windows one by one, ``spans_of(records,
    which)`` the spans that records cover. Tasks grow with the number of buckets, which part evenly."""
    least, out, round_ = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), None, 0
    while True:
        n = min(MOST_TASKS, max(least, buckets if round_ == 0 else least))
        dealt = packed.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int")).sortWithinPartitions("bucket")
        found = stored(dealt.mapInArrow(_solve(solve, split, spans_of, limit, round_), OUT), name)
        spans = found.where("blob is null").drop("bucket", "blob")
        out = spans if out is None else out.unionByName(spans)
        packed = found.where("blob is not null")
        if packed.isEmpty():
            return out
        round_ += 1
