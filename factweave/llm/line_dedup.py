"""Line dedup by winnowing over line hashes.

A document is its sequence of lines, trimmed; blank lines don't count. A line goes if it lies in a run of
lines that also starts earlier (in any document: smaller doc_id, then text hash, or before in its own) and
has ``window`` lines or ``least`` bytes, trimmed, or more; runs are judged on the input, and no other line goes.

Such runs consist of windows: the shortest ones from a line on, and the shortest ones up to a line, that have
``window`` lines or ``least`` bytes. Each window selects the smallest of its 128-bit line hashes (the rightmost
of equals). Which one that is hangs on the window's lines alone, so two places with the same lines select
the same line: a run that repeats shares a fingerprint, at the same place in it. Only selected positions
are joined, and matches are extended from them both ways, over the lines of the windows that chose the position:

* Positions with equal fingerprints and equal lines on both sides are a class, and one row of it goes on, its
  earliest position; all others repeat that one to the ends on both sides. The reduction begins in each task, so
  a passage that a third of all documents share costs a row a task.
* The earliest positions of classes that share a fingerprint, but not all lines around, are extended to the left and
  to the right window by window: a window repeats if another class has it earlier.

Fingerprints that stand in one class only are never extended, and what is deleted is every run, whichever documents
hold it earlier. With ``window=1`` every line is a run, so each stays at its earliest place only; with ``least=None`` runs
count by their lines alone. Lines are compared by their hashes.

Nulls: a null text has no lines; a null id is smaller than every other. Rows with the same id and
text are one document read twice. An empty table gives an empty result; further columns are ignored.
A line of any length is one line; a text without a run to delete is kept byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import covered, keyed, public_id, release_memory, stored, text_batches


def lines_of(raw: bytes) -> list[bytes]:
    return [x for x in (line.strip() for line in raw.split(b"\n")) if x]


def windows_of(sizes: np.ndarray, window: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs from each line on, and up to each line, that have
    ``window`` lines or ``least`` bytes."""
    n = len(sizes)
    edge = np.arange(n + 1)
    starts, ends = edge[:n], edge[:n] + window
    froms, tos = edge[1:] - window, edge[1:]
    if least is not None:
        total = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.minimum(ends, np.searchsorted(total, total[:n] + least))
        froms = np.maximum(froms, np.searchsorted(total, total[1:] - least, "right") - 1)
    whole, back = ends <= n, froms >= 0
    start, end = np.concatenate((starts[whole], froms[back])), np.concatenate((ends[whole], tos[back]))
    code = np.unique(start * (window + 1) + end - start)
    return code // (window + 1), code // (window + 1) + code % (window + 1)


def selected(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of every window's smallest hash, the rightmost of equals."""
    at, best = start.copy(), hashes[start]
    for k in range(1, int((end - start).max(initial=1))):
        here = np.minimum(start + k, end - 1)
        lower = hashes[here] <= best
        at, best = np.where(lower, here, at), np.where(lower, hashes[here], best)
    return at


def seed_code(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """A position and the lines around it that its windows span, as one number, in the order of positions."""
    return 2 * ((at * (window + 1) + at - lo) * (window + 1) + hi - at)


def window_code(lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    return 2 * (lo * (window + 1) + hi - lo) + 1


def spans(codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what seed and window codes span."""
    seed, (half, last) = codes % 2 == 0, np.divmod(codes // 2, window + 1)
    at, before = np.divmod(half, window + 1)
    lo = np.where(seed, at - before, half)
    return lo, np.where(seed, at, half) + last


def seeds(raw: bytes, window: int, least: int | None) -> tuple[list, list, list, list, list]:
    """Of every selected position: fingerprint, hash of the lines around it, code, and the hashes and codes of
    the windows that chose it."""
    lines = lines_of(raw)
    start, end = windows_of(np.fromiter(map(len, lines), np.int64, len(lines)), window, least)
    if not len(start):
        return [], [], [], [], []
    digest = xxhash.xxh3_128_digest
    flat = b"".join(map(digest, lines))
    at = selected(np.frombuffer(flat, ">u8")[::2], start, end)
    order = np.lexsort((start, at))
    start, end, at = start[order], end[order], at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    place, lo, hi = at[first], np.minimum.reduceat(start, first), np.maximum.reduceat(end, first)
    around = [digest(b"%d:" % (p - a) + flat[16 * a : 16 * b]) for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    wins = [digest(flat[16 * a : 16 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    codes = window_code(start, end, window).tolist()
    edge = [*first.tolist(), len(start)]
    own = list(zip(edge[:-1], edge[1:], strict=True))
    prints = [flat[16 * p : 16 * p + 16] for p in place.tolist()]
    return prints, around, seed_code(place, lo, hi, window).tolist(), [wins[a:b] for a, b in own], [codes[a:b] for a, b in own]


_SEEDS = pa.schema([("did", pa.int64()), ("dig", pa.int64()), ("fp", pa.binary()), ("around", pa.binary()), ("code", pa.int64()), ("wins", pa.list_(pa.binary())), ("codes", pa.list_(pa.int64()))])


def _select(window: int, least: int | None, step: int = 1 << 15):
    """A row for every selected position of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], ([], [], [], [], [])
            for k, t in enumerate(batch.column("text")):
                found = seeds(t.as_buffer().to_pybytes(), window, least)
                rows.append(np.full(len(found[0]), k))
                for c, v in zip(cols, found, strict=True):
                    c += v
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            did, dig = (np.asarray(batch.column(c))[row] for c in ("did", "dig"))
            for lo in range(0, len(row), step):
                part = slice(lo, lo + step)
                yield pa.RecordBatch.from_arrays([pa.array(x[part], f.type) for x, f in zip((did, dig, *cols), _SEEDS, strict=True)], schema=_SEEDS)
        release_memory()

    return run


def selected_positions(docs: DataFrame, window: int, least: int | None) -> DataFrame:
    """A row for each selected position of keyed documents: did, dig, fp, around, code, wins, codes."""
    kinds = "did long, dig long, fp binary, around binary, code long, wins array<binary>, codes array<long>"
    return docs.mapInArrow(_select(window, least), kinds)


def repeated_spans(docs: DataFrame, window: int, least: int | None) -> DataFrame:
    """(did, dig, codes): of keyed documents, the spans of lines that also start earlier."""
    places = stored(selected_positions(docs, window, least), "line-places")
    earliest = F.min(F.struct("did", "dig", "code")).alias("o")
    # stored, so that both sides of the join are exchanged anew and a fingerprint with very many classes can be split
    classes = stored(places.groupBy("fp", "around").agg(earliest).select("fp", "o.*"), "line-classes")
    several = stored(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "line-several")
    extend = classes.join(several, "fp").select("did", "dig", "code")
    wins = extend.join(places.select("did", "dig", "code", "wins", "codes"), ["did", "dig", "code"])
    wins = stored(wins.select("did", "dig", F.explode(F.arrays_zip("wins", "codes")).alias("w")).select("did", "dig", "w.wins", F.col("w.codes").alias("code")), "line-windows")
    first = classes.select("did", "dig", "code").unionByName(wins.groupBy("wins").agg(earliest).select("o.*"))
    every = places.select("did", "dig", "code").unionByName(wins.select("did", "dig", "code"))
    both = every.withColumn("every", F.lit(True)).unionByName(first.withColumn("every", F.lit(False)))
    codes = lambda which: F.collect_set(F.when(which, F.col("code")))
    own = both.groupBy("did", "dig").agg(codes(F.col("every")).alias("every"), codes(~F.col("every")).alias("first"))
    return own.select("did", "dig", F.array_except("every", "first").alias("codes")).where(F.size("codes") > 0)


_CUT = pa.schema([("did", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(window: int):
    """Deletes the lines of all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"did": [], "n_lines": [], "n_removed": [], "kept": []}
            for did, text, codes in zip(batch.column("did").to_pylist(), batch.column("text"), batch.column("codes"), strict=True):
                raw = text.as_buffer().to_pybytes()
                rows = raw.split(b"\n")
                solid = [i for i, r in enumerate(rows) if r.strip()]
                gone = covered(len(solid), *spans(codes.values.to_numpy() if codes.is_valid else np.zeros(0, np.int64), window))
                drop = {solid[i] for i in np.flatnonzero(gone).tolist()}
                kept = b"\n".join(r for i, r in enumerate(rows) if i not in drop) if drop else raw
                for k, v in zip(out, (did, len(solid), len(drop), kept.decode()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out), schema=_CUT, preserve_index=False)
        release_memory()

    return run


def dedup_lines(docs: DataFrame, window: int = 4, least: int | None = 240, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the text kept, a row for every document."""
    if window < 1 or (least is not None and least < 1):
        raise ValueError("window and least are 1 at least")
    text_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    marks = repeated_spans(own, window, least)
    cut = own.join(marks, ["did", "dig"], "left").mapInArrow(_cut(window), "did long, n_lines long, n_removed long, kept string")
    return cut.select(public_id(F.col("did")).alias("doc_id"), "n_lines", "n_removed", "kept")
