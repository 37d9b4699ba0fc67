"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised (A-Z lower-cased, words of letters, digits and all that
is not ASCII, one space between) and cut into windows of ten words; an item of fewer words is one
window. All windows go into one automaton, each with a space at both ends so that only whole words
match. Each document is normalised the same way and scanned once, overlapping occurrences included;
matches are mapped back to character offsets of the original text.

The windows are broadcast and each worker builds the automaton from them. Windows of more than
``block_bytes`` are dealt into several automata, which the driver holds and broadcasts one at a time:
documents are scanned once for each, what it finds is written to the shared folder before the next, and
all of it is merged by document, so that the benchmark may grow too. An automaton takes some 33 bytes for a byte
of windows: 0.4 GB in a worker for a whole block. An item longer than a block goes into several, cut so
that every window is in one.

Nulls: a null text has no words; items without an id or without words match nothing; a null doc_id
is a document like any other. Items that share an id are one item. Every document gives a row, a
row that occurs twice two; empty tables are fine; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import covered, keyed, public_id, spans_of, stored, text_batches

#: Windows in one automaton, in bytes.
BLOCK_BYTES = 12 << 20
#: Bytes that end a word: ASCII without digits and letters.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def windows_of(items: list[tuple[str, str]], width: int) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Window, as Latin-1 text with a space at both ends -> (words in it, ids of its items)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text.encode())
        for at in range(max(1, len(words) - width + 1) if words else 0):
            part = words[at : at + width]
            found.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), set()))[1].add(item)
    return {k: (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


_built: dict[int, tuple] = {}


def automaton(windows: dict, key: int):
    """Built once in each worker."""
    if key not in _built:
        machine = ahocorasick.Automaton()
        for window, value in windows.items():
            machine.add_word(window, value)
        if windows:
            machine.make_automaton()
        _built.clear()
        _built[key] = machine
    return _built[key]


def scan(raw: bytes, machine) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, which of them are hit, and the items that occur."""
    words = words_of(raw)
    if not len(machine):
        return len(words), np.zeros(len(words), bool), set()
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ends, sizes, items = [], [], set()
    for end, (n, ids) in machine.iter(text):
        ends.append(end)
        sizes.append(n)
        items.update(ids)
    if not ends:
        return len(words), np.zeros(len(words), bool), items
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, ends)
    return len(words), covered(len(words), last - np.array(sizes), last), items


def original(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of word spans."""
    if not len(lo):
        return []
    at = [m.span() for m in _WORD.finditer(raw)]
    chars = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


_SCAN = "did long, dig long, n_words long, words array<struct<lo:long,hi:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def _shared(docs: DataFrame, windows: dict):
    """The windows as a broadcast variable, and a key that tells them from others."""
    return docs.sparkSession.sparkContext.broadcast(windows), hash(frozenset(windows))


def _scan_map(shared, key: int):
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
    schema = pa.schema([("did", pa.int64()), ("dig", pa.int64()), ("n_words", pa.int64()), ("words", pair("lo", "hi")), ("spans", pair("start", "end")), ("items", pa.list_(pa.string()))])

    def run(batches):
        machine = automaton(shared.value, key)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, hit, items = scan(raw, machine)
                lo, hi = spans_of(hit) if items else (np.zeros(0, int),) * 2
                spans = original(raw, lo, hi)
                row = (n, [{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi, strict=True)], [{"start": a, "end": b} for a, b in spans], sorted(items))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("dig"), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True))], schema=schema)

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """What several automata found in one document."""
    first = pdf.iloc[0]
    n = int(first["n_words"])
    lo, hi = ([w[k] for ws in pdf["words"] for w in ws] for k in ("lo", "hi"))
    a, b = spans_of(covered(n, np.array(lo, int), np.array(hi, int)))
    ends = {w["lo"]: s["start"] for ws, ss in zip(pdf["words"], pdf["spans"], strict=True) for w, s in zip(ws, ss, strict=True)}
    stops = {w["hi"]: s["end"] for ws, ss in zip(pdf["words"], pdf["spans"], strict=True) for w, s in zip(ws, ss, strict=True)}
    return pd.DataFrame([{
        "did": first["did"], "dig": first["dig"], "n_words": n, "words": [{"lo": int(x), "hi": int(y)} for x, y in zip(a, b, strict=True)],
        "spans": [{"start": ends[x], "end": stops[y]} for x, y in zip(a.tolist(), b.tolist(), strict=True)], "items": sorted({i for x in pdf["items"] for i in x}),
    }])


def pieces(text: str, width: int, block_bytes: int) -> Iterator[str]:
    """The text itself, or where its windows are more than a block, parts of it that have them all."""
    if len(text) * width <= block_bytes:
        yield text
        return
    words, at = words_of(text.encode()), 0
    while at == 0 or at + width <= len(words):
        to, size = at + width, width * sum(map(len, words[at : at + width]))
        while to < len(words) and size < block_bytes:
            size += width * (len(words[to]) + 1)
            to += 1
        yield b" ".join(words[at:to]).decode()
        at = to - width + 1


def benchmark_blocks(bench: DataFrame, width: int, block_bytes: int, item_col: str, text_col: str) -> Iterator[dict]:
    """Windows of the benchmark, in dictionaries of about ``block_bytes`` at most, one after another;
    items are read one partition at a time."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna().orderBy("item", "text")
    held, size, any_yet = [], 0, False
    for row in items.toLocalIterator():
        for piece in pieces(row["text"], width, block_bytes):
            held.append((row["item"], piece))
            size += len(piece.encode()) * width
            if size > block_bytes:
                yield windows_of(held, width)
                held, size, any_yet = [], 0, True
    if held or not any_yet:
        yield windows_of(held, width)


def find_contamination(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated and spans (character
    offsets in the original text) for every document."""
    text_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    blocks = benchmark_blocks(bench, width, block_bytes, item_col, bench_text_col)
    shared, key = _shared(docs, next(blocks))
    found = own.mapInArrow(_scan_map(shared, key), _SCAN)
    block = next(blocks, None)
    if block is not None:
        found = stored(found, "scanned")
        shared.unpersist()
        hits = found.where(F.size("items") > 0)
        while block is not None:
            shared, key = _shared(docs, block)
            hits = hits.unionByName(stored(own.mapInArrow(_scan_map(shared, key), _SCAN).where(F.size("items") > 0), "scanned"))
            shared.unpersist()
            block = next(blocks, None)
        merged = hits.groupBy("did", "dig").applyInPandas(_merge, _SCAN).drop("n_words")
        none = {"words": "array<struct<lo:long,hi:long>>", "spans": "array<struct<start:long,end:long>>", "items": "array<string>"}
        found = found.select("did", "dig", "n_words").join(merged, ["did", "dig"], "left").withColumns({k: F.coalesce(k, F.array().cast(t)) for k, t in none.items()})
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w["hi"] - w["lo"])
    return found.select(
        public_id(F.col("did")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "dig",
    )


def decontaminated(docs: DataFrame, bench: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, all columns kept: a pass for each automaton, no shuffle."""

    def clean(shared, key: int):
        def run(batches):
            machine = automaton(shared.value, key)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([not (t.is_valid and scan(t.as_buffer().to_pybytes(), machine)[2]) for t in texts], pa.bool_()))

        return run

    text_batches(docs.sparkSession)
    blocks = benchmark_blocks(bench, width, block_bytes, item_col, bench_text_col)
    block, out = next(blocks), None
    while block is not None:
        shared, key = _shared(docs, block)
        out = (docs if out is None else out).mapInArrow(clean(shared, key), docs.schema)
        block = next(blocks, None)
        if block is not None:
            out = stored(out, "clean")
            shared.unpersist()
    return out
