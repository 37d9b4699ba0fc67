"""Vector code compression: product quantisation with norm-of-sum bounds.

Vectors are cut into ``parts`` equal parts, and each part is coded by the nearest of the ``entries`` of its
codebook. Codebooks are fitted by rounds of assigning all parts and moving each entry to the mean of its
parts. A row keeps for each part the squared distances to its own entry and to the next one, and for
each of the two the round in which it was measured, its stamp. All codebooks so far are kept. How far an entry
can have come since a stamp is the norm of the sum of its moves, i.e. of its true net displacement,
which is never more than the sum of the moves' norms and often far less, as entries turn back. Where
the own distance plus its entry's displacement stays below the next distance minus the largest
displacement of the other entries, the code can't have changed and nothing is computed; otherwise the own
distance is measured anew, and only if that doesn't settle it, all entries are rescanned.

Distances are exact whole numbers; bounds are widened by more than floating point can be wrong, and a code
is kept only where they differ strictly, so ties go to the lower index as in a full scan. A round is one
pass over all rows, without a shuffle: the rows' new codes and bounds are written together with sums of parts,
a row of sums for every block of rows, and the next round starts from these files. Only sums of bounded
size (``parts`` * ``entries`` * length of a part numbers) meet on the driver. Of two rounds' files the older is
removed. The codebooks start from the rows with the smallest ids, and are then fitted on all rows.

Semantics: nearest is by squared Euclidean distance, ties to the lower index; a mean is
floor(sum / count), and an entry without parts stays. A row with a null id gives a first
entry after all others only; rows with one id come by their vectors. With fewer rows than entries there are as many entries as
rows. Vectors of unlike lengths, or of a length that ``parts`` doesn't divide, are filled up with zeros.
Nulls: rows whose vector is null or holds a null or non-finite component are dropped; a null id comes
back as null, null labels are one label. Every kept row gives a row, repeated ones too. Components beyond
2**53 count as that; where distances might not fit 62 bits, they are computed in integers of any width
and without bounds, and an error beyond a long is the largest long. An empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import drop, flat_text, scratch
from factweave.llm.hard_negatives import blocks, finite, matrix, quantised

#: Relative slack of bounds in floating point.
SLACK = 1e-9
MOST = 2**63 - 1
STATE = "vec_id long, label {label}, v array<long>, code binary, near binary, next binary, near_at binary, next_at binary, sums array<string>"


def largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Codebooks:
    """The codebooks of all rounds so far: each ``parts`` x ``entries`` x length of a part."""

    def __init__(self, history: list[np.ndarray]):
        self.history = history
        self.now = history[-1]
        self.width = self.now.shape[0] * self.now.shape[2]
        self.largest = max(largest(h) for h in history)
        if self.narrow(self.largest):
            net = np.array([((self.now - h) ** 2).sum(axis=2) for h in history])  # stamp, part, entry
            self.moved = np.sqrt(net.astype(np.float64)) * (1 + SLACK)
            #: the largest displacement of the other entries
            n = self.moved.shape[2]
            others = np.where(np.eye(n, dtype=bool), 0.0, self.moved[:, :, None, :])
            self.others_moved = others.max(axis=3, initial=0.0)

    def narrow(self, most: int) -> bool:
        """Whether squared distances to vectors with components up to ``most`` fit 62 bits."""
        return (most + self.largest) ** 2 * self.width < 2**62

    def distances(self, part: int, rows: np.ndarray) -> np.ndarray:
        return ((rows[:, None, :] - self.now[part][None]) ** 2).sum(axis=2)

    def own(self, part: int, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        return ((rows - self.now[part][code]) ** 2).sum(axis=1)


class Rows:
    """A block of rows: vectors by part, and their codes, squared distances and stamps."""

    def __init__(self, v: np.ndarray, parts: int):
        self.n, self.parts = len(v), parts
        self.v = v.reshape(len(v), parts, v.shape[1] // parts)
        self.code, self.near_at, self.next_at = (np.zeros((self.n, parts), np.uint8) for _ in range(3))
        self.near, self.next = np.zeros((self.n, parts), np.int64), np.full((self.n, parts), -1)
        self.scanned = 0

    def load(self, table: pa.Table) -> Rows:
        for name in ("code", "near", "next", "near_at", "next_at"):
            have = getattr(self, name)
            setattr(self, name, flat_text(table.column(name))[0].view(have.dtype).reshape(have.shape).copy())
        return self

    def columns(self) -> list[pa.Array]:
        out = []
        for have in (self.code, self.near, self.next, self.near_at, self.next_at):
            offsets = np.arange(self.n + 1, dtype=np.int32) * np.int32(self.parts * have.itemsize)
            out.append(pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(have))]))
        return out

    def assign(self, books: Codebooks) -> None:
        """The nearest entry of every part by the present codebooks."""
        narrow = books.narrow(largest(self.v))
        stamp = len(books.history) - 1
        for p in range(self.parts):
            rows = self.v[:, p] if narrow else self.v[:, p].astype(object)
            todo = np.arange(self.n)
            if narrow and stamp:
                todo = todo[~self.settled(books, p, todo)]
                if len(todo):
                    self.near[todo, p] = books.own(p, rows[todo], self.code[todo, p])
                    self.near_at[todo, p] = stamp
                    todo = todo[~self.settled(books, p, todo)]
            if not len(todo):
                continue
            self.scanned += len(todo)
            d = books.distances(p, rows[todo])
            at = np.arange(len(todo))
            self.code[todo, p] = code = np.argmin(d, axis=1)
            if not narrow:
                self.next[todo, p] = -1
            else:
                self.near[todo, p], self.near_at[todo, p] = d[at, code], stamp
                d[at, code] = MOST
                self.next[todo, p], self.next_at[todo, p] = d.min(axis=1), stamp

    def settled(self, books: Codebooks, p: int, of: np.ndarray) -> np.ndarray:
        """Where the bounds tell that the code can't have changed."""
        code, nxt = self.code[of, p], self.next[of, p]
        upper = np.sqrt(self.near[of, p].astype(np.float64)) * (1 + SLACK) + books.moved[self.near_at[of, p], p, code]
        lower = np.sqrt(np.maximum(nxt, 0).astype(np.float64)) * (1 - SLACK) - books.others_moved[self.next_at[of, p], p, code]
        return (nxt >= 0) & (upper * (1 + SLACK) < lower * (1 - SLACK))

    def sums(self, entries: int) -> list[str]:
        """Number and componentwise sum of the parts of each entry, and how many parts were rescanned."""
        out = []
        wide = self.n * largest(self.v) >= 2**62
        for p in range(self.parts):
            for e in range(entries):
                mine = self.v[self.code[:, p] == e, p]
                out += [len(mine), *(mine.astype(object) if wide else mine).sum(axis=0)]
        return [str(int(x)) for x in [*out, self.scanned]]

    def errors(self, books: Codebooks) -> np.ndarray:
        narrow = books.narrow(largest(self.v))
        total = np.zeros(self.n, np.int64 if narrow else object)
        for p in range(self.parts):
            total += books.own(p, self.v[:, p] if narrow else self.v[:, p].astype(object), self.code[:, p])
        return np.array([min(int(x), MOST) for x in total], np.int64)


def coded(batches: Iterator[pa.RecordBatch], books: Codebooks, width: int) -> Iterator[pa.RecordBatch]:
    """A round over a task's rows; each block of them is followed by a row of its sums."""
    parts, entries = books.now.shape[:2]
    for table in blocks(batches, width):
        v = table.column("v").combine_chunks()
        rows = Rows(matrix(v, width), parts)
        if table.column("code").null_count == 0:
            rows.load(table)
        rows.assign(books)
        table = table.combine_chunks()
        n = table.num_rows
        ids, labels = table.column("vec_id"), table.column("label")
        none = pa.nulls(n, pa.list_(pa.string()))
        cols = [ids.combine_chunks(), labels.combine_chunks(), v, *rows.columns(), none]
        names = ["vec_id", "label", "v", "code", "near", "next", "near_at", "next_at", "sums"]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=names)
        tail = [pa.nulls(1, c.type) for c in cols[:-1]] + [pa.array([rows.sums(entries)], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(tail, names=names)


def measured(batches: Iterator[pa.RecordBatch], books: Codebooks, width: int) -> Iterator[pa.RecordBatch]:
    """vec_id, label, code and error of coded rows."""
    for table in blocks(batches, width):
        rows = Rows(matrix(table.column("v").combine_chunks(), width), books.now.shape[0]).load(table)
        code = pa.array([x.tobytes().hex() for x in rows.code], pa.string())
        cols = [table.column("vec_id").combine_chunks(), table.column("label").combine_chunks(), code, pa.array(rows.errors(books))]
        yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error"])


def moved_entries(state: DataFrame, book: np.ndarray) -> tuple[np.ndarray, int]:
    """The means of the parts of each entry, and the number of rescanned parts."""
    each = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x"))
    total = {r["at"]: int(r["x"]) for r in each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    parts, entries, size = book.shape
    out, at = book.copy(), 0
    for p in range(parts):
        for e in range(entries):
            if count := total.get(at, 0):
                out[p, e] = [total[at + 1 + i] // count for i in range(size)]
            at += 1 + size
    return out, total.get(at, 0)


def fitted_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame | None, Codebooks | None, list[int]]:
    """(vec_id, label, code, error) of all rows, the codebooks, and the number of parts that each round
    rescanned; None without rows."""
    spark = vectors.sparkSession
    label_type = vectors.select(label_col).schema[0].dataType.simpleString()
    schema = STATE.format(label=label_type)
    whole = vectors.where(finite(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), quantised(vector_col, scale).alias("v"))
    blank = [F.lit(None).cast("binary").alias(c) for c in ("code", "near", "next", "near_at", "next_at")]
    path = scratch(spark, "codes")
    whole.select("vec_id", "label", "v", *blank, F.lit(None).cast("array<string>").alias("sums")).write.parquet(path)
    state = spark.read.schema(schema).parquet(path)
    longest = state.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None, None, []
    width = -(-longest // parts) * parts
    first = [r["v"] + [0] * (width - len(r["v"])) for r in state.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    history, scans = [np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()], []
    for turn in range(rounds + 1):
        held = spark.sparkContext.broadcast(Codebooks(history))
        after = scratch(spark, "codes")
        state.where("sums IS NULL").mapInArrow(lambda batches, held=held: coded(batches, held.value, width), schema).write.parquet(after)
        drop(spark, path)
        path, state = after, spark.read.schema(schema).parquet(after)
        book, scanned = moved_entries(state, history[-1])
        scans.append(scanned)
        if turn < rounds:
            history.append(book)
    books = Codebooks(history)
    held = spark.sparkContext.broadcast(books)
    rows = state.where("sums IS NULL").mapInArrow(lambda batches: measured(batches, held.value, width), f"vec_id long, label {label_type}, code string, error long")
    return rows, books, scans


def vector_codes(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256."""
    rows, books, _ = fitted_codes(vectors, **how)
    if rows is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    text = ",".join(str(int(x)) for x in books.now.ravel())
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
