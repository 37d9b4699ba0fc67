"""Substring dedup over words by super-k-mers.

A k-mer is a window of ``window`` words; its minimiser is the leftmost smallest ``gram``-word
sequence in it by hash. Consecutive windows that share a minimiser travel as one packed string,
each word followed by a space, to the bucket of the minimiser. There equal strings are counted
first, then the windows of strings that share a minimiser are sorted word by word, so each window
is counted exactly once per place. A bucket that a frequent minimiser fills beyond its bytes passes
its windows on one by one, to buckets of their own content (see ``packed``): equal windows still meet,
and different ones spread.

Semantics: a word goes if a window over it also starts earlier (smaller id, or same document and
earlier start), judged on the input. Words are runs without space and \\t to \\r, taken unchanged.
Nulls: a null text has no words, a null id is smaller than every other. Rows with the same id and
text are one document read twice. Rows with one id and different texts are ordered by a hash of
their text. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import covered, flat_text, gathered, keyed, minimiser_runs, mixed, multikey_groups, public_id, ragged, rolled, text_batches
from factweave.llm.packed import OUT, Records, blob_row, by_bucket, fused, solved, span_rows
from factweave.llm.suffix_dedup import remove_spans

SPACE = 32
#: Words that windows are found in at once: positions among them take 24 bits.
CHUNK = 1 << 22


def is_space(flat: np.ndarray) -> np.ndarray:
    return (flat == SPACE) | ((flat >= 9) & (flat <= 13))


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 200_000) -> np.ndarray:
    """A 64-bit hash of every word; words are pieces of ``data`` in order, none empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power = np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(power)
        out = np.empty(len(start), np.uint64)
        for k in range(0, len(start), step):
            n, begin = size[k : k + step], start[k : k + step]
            at = np.concatenate(([0], np.cumsum(n)[:-1]))
            nth = np.arange(int(n.sum())) - np.repeat(at, n)
            out[k : k + step] = np.add.reduceat((data[ragged(begin, n)].astype(np.uint64) + np.uint64(1)) * power[nth], at)
        return mixed(out)


class Words:
    """The words of all documents of a batch, each followed by one space."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray):
        space = is_space(flat)
        before = np.ones(len(flat) + 1, bool)
        before[1:] = space
        before[offs] = True  # a document begins here
        begin = np.flatnonzero(~space & before[:-1])
        after = np.ones(len(flat) + 1, bool)
        after[:-1] = space
        after[offs] = True
        end = np.flatnonzero(~space & after[1:]) + 1
        self.size = end - begin
        self.start = np.concatenate(([0], np.cumsum(self.size + 1)))[:-1]
        self.data = gathered(np.append(flat, np.uint8(SPACE)), begin, self.size + 1)
        self.data[self.start + self.size] = SPACE
        self.hash = word_hashes(self.data, self.start, self.size)
        self.of = np.searchsorted(begin, offs)  # first word of each document; the end of the last


def super_kmers(words: Words, window: int, gram: int, chunk: int = CHUNK):
    """(first window, number of windows, minimiser's word, its hash), ``chunk`` windows at a time."""
    n, found = len(words.hash), []
    ends = np.repeat(words.of[1:], np.diff(words.of))
    for c in range(0, max(0, n - window + 1), chunk):
        grams = rolled(words.hash[c : c + chunk + window - 1], gram)
        at = np.arange(c, min(c + chunk, n - window + 1))
        ok = at + window <= ends[at]
        if ok.any():
            first, size, pos = minimiser_runs(grams, window - gram + 1, ok)
            found.append((first + c, size, pos + c, grams[pos]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _records(batch: pa.RecordBatch, window: int, gram: int, buckets: int) -> tuple[Records, np.ndarray]:
    flat, offs = flat_text(batch.column("text"))
    words = Words(flat, offs)
    first, size, pos, key = super_kmers(words, window, gram)
    doc = np.searchsorted(words.of, first, "right") - 1
    did, dig = (np.asarray(batch.column(c)) for c in ("did", "dig"))
    last = first + size + window - 2
    lo, hi = words.start[first], words.start[last] + words.size[last] + 1
    bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
    return Records(did[doc], dig[doc], first - words.of[doc], size, pos - first, hi - lo, gathered(words.data, lo, hi - lo)), bucket


def _map(window: int, gram: int, buckets: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, goals, size = [], [], 0

        def emit():
            nonlocal held, goals, size
            if not held:
                return
            rec, bucket = Records.joined(held), np.concatenate(goals)
            held, goals, size = [], [], 0
            stays, repeats = rec.later_equals()
            did, dig, lo, hi = fused(*_spans(rec, repeats, window))
            for b, blob in by_bucket(rec.take(np.flatnonzero(stays)), bucket[stays]):
                yield blob_row(b, blob)
            # what is settled here travels along, in the same exchange
            yield from span_rows((mixed(did.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), did, dig, lo, hi)

        for batch in batches:
            step = max(1, int(len(batch) * flush / max(flush, batch.column("text").nbytes)))
            for at in range(0, len(batch), step):
                rec, bucket = _records(batch.slice(at, step), window, gram, buckets)
                held.append(rec)
                goals.append(bucket)
                size += len(rec.data)
                if size >= 12 * flush:
                    yield from emit()
        yield from emit()

    return run


def _spans(rec: Records, which: np.ndarray, window: int):
    return rec.did[which], rec.dig[which], rec.pos[which], rec.pos[which] + rec.nwin[which] + window - 1


def repeated_windows(rec: Records, window: int, gram: int):
    """Windows of ``rec`` that also start earlier within ``rec``, as (record, window) numbers."""
    end = np.flatnonzero(rec.data == SPACE)
    begin = np.concatenate(([0], end + 1))[: len(end)]
    first = np.searchsorted(begin, rec.start)
    token = word_hashes(rec.data, begin, end - begin)
    anchor = first + rec.aoff
    group = multikey_groups(lambda i, d: token[anchor[i] + d], len(rec), gram, np.zeros(len(rec), np.int8))
    live = np.flatnonzero(group >= 0)
    part, group = rec.take(live), group[live]
    # exact from here on: each different word gets a number of its own
    number: dict[bytes, int] = {}
    token = np.array([number.setdefault(w, len(number)) for w in part.data.tobytes().split(b" ")[:-1]], np.uint64)
    nwords = part.nwin.astype(np.int64) + window - 1
    begin = np.concatenate(([0], np.cumsum(nwords)))[:-1]
    owner = np.repeat(np.arange(len(part)), part.nwin)
    nth = ragged(np.zeros(len(part), np.int64), part.nwin.astype(np.int64))
    at = begin[owner] + nth
    place = group[owner] * (window + 1) + (part.aoff[owner] - nth)
    same = multikey_groups(lambda i, d: token[at[i] + d], len(owner), window, place)
    keep = np.flatnonzero(same >= 0)
    owner, nth, same = owner[keep], nth[keep], same[keep]
    order = np.lexsort((part.pos[owner] + nth, part.dig[owner], part.did[owner], same))
    owner, nth, same = owner[order], nth[order], same[order]
    head = np.ones(len(same), bool)
    head[1:] = same[1:] != same[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(same)), 0))
    a, b = owner[lead], nth[lead]
    other = (part.did[owner] != part.did[a]) | (part.dig[owner] != part.dig[a]) | (part.pos[owner] + nth != part.pos[a] + b)
    return live[owner[other]], nth[other]


def _split(rec: Records, window: int) -> Records:
    """Every window as a record of its own."""
    end = np.flatnonzero(rec.data == SPACE)
    begin = np.concatenate(([0], end + 1))[: len(end)]
    owner = np.repeat(np.arange(len(rec)), rec.nwin)
    nth = ragged(np.zeros(len(rec), np.int64), rec.nwin.astype(np.int64))
    word = np.searchsorted(begin, rec.start)[owner] + nth
    lo = begin[word]
    size = end[word + window - 1] + 1 - lo
    return Records(rec.did[owner], rec.dig[owner], rec.pos[owner] + nth, np.ones(len(owner), np.int32), rec.aoff[owner] - nth, size, gathered(rec.data, lo, size))


def _bucket(window: int, gram: int):
    def run(records: list[Records], ready: list[tuple]) -> Iterator[pa.RecordBatch]:
        rec, parts = Records.joined(records), list(ready)
        stays, repeats = rec.later_equals()
        parts.append(_spans(rec, repeats, window))
        rec = rec.take(np.flatnonzero(stays))
        owner, nth = repeated_windows(rec, window, gram)
        at = rec.pos[owner] + nth
        parts.append((rec.did[owner], rec.dig[owner], at, at + window))
        yield from span_rows(0, *fused(*(np.concatenate(x) for x in zip(*parts, strict=True))))

    return run


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 5, bucket_bytes: int = 8 << 20, limit: int = 96 << 20) -> DataFrame:
    """(did, dig, lo, hi): word spans of keyed documents that repeat earlier text. ``limit`` is what a
    bucket may hold in memory."""
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(4, -(-total // bucket_bytes))
    packed = docs.mapInArrow(_map(window, gram, buckets, 2 << 20), OUT)
    spans_of = lambda r, which: _spans(r, which, window)
    return solved(packed, buckets, _bucket(window, gram), lambda r: _split(r, window), spans_of, limit, "word-spans").drop("digest")


def _cut(batches):
    for batch in batches:
        out = {"did": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for did, text, spans in zip(batch.column("did").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
            words, removed = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(), 0
            kept = words
            if spans.is_valid:
                gone = covered(len(words), *(spans.values.field(k).to_numpy() for k in (0, 1)))
                removed = int(gone.sum())
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept = b" ".join(kept)
            for k, v in zip(out, (did, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out), schema=_CUT, preserve_index=False)


_CUT = pa.schema([("did", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def dedup_word_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the words kept, a row for every document."""
    text_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    cut = remove_spans(own, repeated_spans(own, window, **how), _cut, "did long, n_words long, n_removed long, kept_sha256 string, kept string")
    return cut.select(public_id(F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")
