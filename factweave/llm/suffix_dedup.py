"""Suffix-array dedup over bytes.

Every 100-byte window holds the suffix of its own anchor: the leftmost smallest 16-byte gram in
it (by a hash), so equal windows hold equal anchors. Anchored suffixes are range-partitioned by
their leading eight bytes at splitters sampled from the corpus, ``RANGES`` ranges at most, so that the
sample and the splitters are of bounded size whatever the corpus; a range of more than a bucket is dealt
over buckets by the whole anchor. A bucket sorts its suffixes by multikey quicksort, eight bytes at a
time; only suffixes whose gram has company go on, and their windows are sorted the same way until each
is alone or known equal to an earlier one. A leading value that would fill more than a range covers
several equal splitters: its suffixes are dealt over these neighbours and compared across the
boundaries by a second exchange on the digests of whole windows, where equal windows are pre-aggregated
and so can't be a hot key. A bucket that is still too large passes its windows on one by one (see
``packed``).

Semantics: a byte goes if a ``window``-byte string over it also starts earlier (smaller id, or
same document and earlier start), judged on the input. Nulls: a null text is empty, a null id is
smaller than every other. Rows with the same id and text are one document read twice: both get
its result. Rows with one id and different texts are ordered by a hash of their text. An empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import covered, flat_text, gathered, keyed, minimiser_runs, mixed, multikey_groups, public_id, ragged, spans_of, text_batches
from factweave.llm.packed import OUT, Records, blob_row, by_bucket, fused, solved, span_rows

GRAM = 16
CHUNK = 1 << 20
RANGES = 1024


def eights(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number (zeros after the end)."""
    x = np.zeros(len(flat) + 8, np.uint64)
    x[: len(flat)] = flat
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        x = (x[:-step] << np.uint64(bits)) | x[step:]
    return x[: len(flat)]


def eight_at(data: np.ndarray, at: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The eight bytes from each of these places on, as ``eights`` has them; all lie in ``data``."""
    out = np.empty(len(at), np.uint64)
    for k in range(0, len(at), step):
        out[k : k + step] = data[at[k : k + step, None] + np.arange(8)].view(">u8").ravel()
    return out


def anchored(flat: np.ndarray, offs: np.ndarray, window: int):
    """(first window, number of windows, anchor position, leading eight bytes, hash of the anchor),
    batch-wide."""
    n, found = len(flat), []
    ends = np.repeat(offs[1:], np.diff(offs))
    for c in range(0, n, CHUNK):
        piece = flat[c : c + CHUNK + window]
        lead = eights(piece)
        grams = mixed(mixed(lead[:-8]) ^ lead[8:])[: max(0, len(piece) - GRAM + 1)]
        at = np.arange(c, min(c + CHUNK, n))
        ok = (at + window <= ends[at])[: max(0, len(grams) - (window - GRAM))]
        if not ok.any():
            continue
        first, size, pos = minimiser_runs(grams, window - GRAM + 1, ok)
        found.append((first + c, size, pos + c, lead[pos], grams[pos]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def records_of(batch: pa.RecordBatch, window: int) -> tuple[Records, np.ndarray, np.ndarray]:
    flat, offs = flat_text(batch.column("text"))
    first, size, pos, lead, gram = anchored(flat, offs, window)
    doc = np.searchsorted(offs, first, "right") - 1
    did, dig = (np.asarray(batch.column(c)) for c in ("did", "dig"))
    nbytes = size + window - 1
    return Records(did[doc], dig[doc], first - offs[doc], size, pos - first, nbytes, gathered(flat, first, nbytes)), lead, gram


def window_digests(rec: Records, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record number, window number in it and 16-byte digest of every window."""
    owner = np.repeat(np.arange(len(rec)), rec.nwin)
    nth = ragged(np.zeros(len(rec), np.int64), rec.nwin.astype(np.int64))
    raw = rec.data.tobytes()
    digest = xxhash.xxh3_128_digest
    return owner, nth, np.array([digest(raw[a : a + window]) for a in (rec.start[owner] + nth).tolist()], object)


def repeated_windows(rec: Records, window: int):
    """Windows of ``rec`` that also start earlier within ``rec``, as (record, window) numbers."""
    start = rec.start
    anchor = start + rec.aoff
    gram = multikey_groups(lambda i, d: eight_at(rec.data, anchor[i] + 8 * d), len(rec), GRAM // 8, np.zeros(len(rec), np.int8))
    live = np.flatnonzero(gram >= 0)
    owner = np.repeat(live, rec.nwin[live])
    nth = ragged(np.zeros(len(live), np.int64), rec.nwin[live].astype(np.int64))
    begin = start[owner] + nth
    # equal windows have equal grams at equal offsets
    place = gram[owner] * (window + 1) + (rec.aoff[owner] - nth)
    steps = [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]
    group = multikey_groups(lambda i, d: eight_at(rec.data, begin[i] + steps[d]), len(owner), len(steps), place)
    keep = np.flatnonzero(group >= 0)
    owner, nth, group = owner[keep], nth[keep], group[keep]
    order = np.lexsort((rec.pos[owner] + nth, rec.dig[owner], rec.did[owner], group))
    owner, nth, group = owner[order], nth[order], group[order]
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    lead_at = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    a, b = owner[lead_at], nth[lead_at]
    other = (rec.did[owner] != rec.did[a]) | (rec.dig[owner] != rec.dig[a]) | (rec.pos[owner] + nth != rec.pos[a] + b)
    return owner[other], nth[other]


def _map(window: int, splitters: np.ndarray, parts: int, flush: int):
    """``parts`` buckets to each range between splitters."""
    hot = np.unique(splitters[1:][splitters[1:] == splitters[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        held, size, salt = [], 0, pyspark.TaskContext.get().partitionId()

        def emit():
            nonlocal held, size
            if not held:
                return
            rec, (lead, gram) = Records.joined([h[0] for h in held]), (np.concatenate([h[k] for h in held]) for k in (1, 2))
            held, size = [], 0
            stays, repeats = rec.later_equals()
            did, dig, lo, hi = fused(*_spans(rec, repeats, window))
            lead, gram = lead[stays], gram[stays]
            reach = np.searchsorted(splitters, lead, "right")
            if len(hot):  # deal a value that covers several splitters over its ranges
                left = np.searchsorted(splitters, lead, "left")
                spread = left + (salt + np.arange(len(reach))) % np.maximum(1, reach - left)
                reach = np.where(np.isin(lead, hot), spread, reach)
            bucket = reach * parts + (mixed(gram) % np.uint64(parts)).astype(np.int64)
            for b, blob in by_bucket(rec.take(np.flatnonzero(stays)), bucket):
                yield blob_row(b, blob)
            # what is settled here travels along, in the same exchange
            yield from span_rows(np.abs(did) % ((len(splitters) + 1) * parts), did, dig, lo, hi)

        for batch in batches:
            step = max(1, int(len(batch) * flush / max(flush, batch.column("text").nbytes)))
            for at in range(0, len(batch), step):
                held.append(records_of(batch.slice(at, step), window))
                size += len(held[-1][0].data)
                if size >= 12 * flush:
                    yield from emit()
        yield from emit()

    return run


def _spans(rec: Records, which: np.ndarray, window: int):
    return rec.did[which], rec.dig[which], rec.pos[which], rec.pos[which] + rec.nwin[which] + window - 1


def _split(rec: Records, window: int) -> Records:
    """Every window as a record of its own."""
    owner = np.repeat(np.arange(len(rec)), rec.nwin)
    nth = ragged(np.zeros(len(rec), np.int64), rec.nwin.astype(np.int64))
    size = np.full(len(owner), window, np.int64)
    return Records(rec.did[owner], rec.dig[owner], rec.pos[owner] + nth, np.ones(len(owner), np.int32), rec.aoff[owner] - nth, size, gathered(rec.data, rec.start[owner] + nth, size))


def _bucket(window: int, hot: np.ndarray):
    def run(records: list[Records], ready: list[tuple]) -> Iterator[pa.RecordBatch]:
        rec, parts = Records.joined(records), list(ready)
        stays, repeats = rec.later_equals()
        parts.append(_spans(rec, repeats, window))
        rec = rec.take(np.flatnonzero(stays))
        owner, nth = repeated_windows(rec, window)
        at = rec.pos[owner] + nth
        parts.append((rec.did[owner], rec.dig[owner], at, at + window))
        yield from span_rows(0, *fused(*(np.concatenate(x) for x in zip(*parts, strict=True))))
        if len(hot):  # windows of values that lie across bucket boundaries: their first place here
            much = np.isin(eight_at(rec.data, rec.start + rec.aoff), hot)
            over = rec.take(np.flatnonzero(much))
            own, n, digest = window_digests(over, window)
            far = pd.DataFrame({"did": over.did[own], "dig": over.dig[own], "lo": over.pos[own] + n, "hi": over.pos[own] + n + window, "digest": digest})
            far = far.sort_values(["did", "dig", "lo"]).drop_duplicates("digest")
            yield from span_rows(0, *(far[c].to_numpy() for c in ("did", "dig", "lo", "hi", "digest")))

    return run


def sample_splitters(docs: DataFrame, total: int, ranges: int, window: int, per_range: int) -> np.ndarray:
    """Splitters from the anchored suffixes of a random share of documents, chosen so that about
    ``per_range`` suffixes stand for each range; they only route, and never decide. The driver gets
    ``4 * RANGES * per_range`` numbers at most."""
    want = ranges * per_range
    # of each sampled document one anchor in `thin` is taken, so that many documents have a say
    thin = 8
    share = min(1.0, want * window * thin / max(1, total) + 1e-9)

    def run(batches):
        for batch in batches:
            _, _, pos, lead, _ = anchored(*flat_text(batch.column("text")), window)
            lead = lead[(mixed(pos.astype(np.uint64)) % np.uint64(thin)) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64))], ["lead"])

    rows = docs.sample(share, seed=7).select("text").mapInArrow(run, "lead long").orderBy(F.xxhash64("lead", F.lit(1)), "lead").limit(4 * want).toPandas()
    lead = np.sort(rows["lead"].to_numpy(np.int64).view(np.uint64))
    return lead[np.linspace(0, len(lead), ranges + 1)[1:-1].astype(np.int64)] if len(lead) >= ranges else lead[:0]


def repeated_spans(docs: DataFrame, window: int = 100, bucket_bytes: int = 8 << 20, splitters: np.ndarray | None = None, limit: int = 96 << 20) -> DataFrame:
    """(did, dig, lo, hi): byte spans of keyed documents that repeat earlier text. ``limit`` is what a
    bucket may hold in memory."""
    if window < 2 * GRAM:
        raise ValueError(f"window must be {2 * GRAM} bytes at least")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(4, -(-total // bucket_bytes))
    if splitters is None:
        splitters = sample_splitters(docs, total, min(RANGES, buckets), window, 200)
    ranges = len(splitters) + 1
    parts = -(-buckets // ranges)
    hot = np.unique(splitters[1:][splitters[1:] == splitters[:-1]])
    packed = docs.mapInArrow(_map(window, splitters, parts, 2 << 20), OUT)
    found = solved(packed, ranges * parts, _bucket(window, hot), lambda r: _split(r, window), lambda r, which: _spans(r, which, window), limit, "suffix-spans")
    spans = found.where(F.col("digest").isNull()).drop("digest")
    if len(hot):
        place = F.struct("did", "dig", "lo")
        far = found.where(F.col("digest").isNotNull())
        first = far.groupBy("digest").agg(F.min(place).alias("first"))
        spans = spans.unionByName(far.join(first, "digest").where(place != F.col("first")).select("did", "dig", "lo", "hi"))
    return spans


def remove_spans(docs: DataFrame, spans: DataFrame, map_rows, schema: str) -> DataFrame:
    """Joins each document with all its spans and hands both to ``map_rows``."""
    each = spans.groupBy("did", "dig").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(each, ["did", "dig"], "left").mapInArrow(map_rows, schema)


def _cut(batches):
    for batch in batches:
        out = {"did": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for did, text, spans in zip(batch.column("did").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            kept, removed, n = raw, 0, 0
            if spans.is_valid:
                lo, hi = (spans.values.field(k).to_numpy() for k in (0, 1))
                gone = covered(len(raw), lo, hi)
                removed, n = int(gone.sum()), len(spans_of(gone)[0])
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for k, v in zip(out, (did, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out), schema=_CUT, preserve_index=False)


_CUT = pa.schema([("did", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def dedup_substrings(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept, a row for every document."""
    text_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    cut = remove_spans(own, repeated_spans(own, window, **how), _cut, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut.select(public_id(F.col("did")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
