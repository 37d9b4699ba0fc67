"""Token-ID files: Parquet with a list column of ids.

Documents are range-partitioned by id, tokenised in order and written by Spark's Parquet writer:
one file per partition of ``file_bytes`` of text or so, ids delta-encoded (writer version 2) or dictionary-encoded, row groups and
pages of a stated size, page indexes for skipping. Each row carries the number of its partition and
the ids before it there, so the place of a document in the whole stream of ids follows from the
per-partition totals alone, and metadata can be read without any id.

``encode_texts`` encodes by chunks between ASCII white space, each different chunk once per worker:
the tokenizer's pre-tokenizer never joins over white space, so the ids are the same as for the text
in one piece, at a fraction of the time. Plain chunks, Latin letters with signs after them, go to
the tokenizer's model piece by piece where a probe shows that this is the same; tests compare both
ways on whole tables and on odd texts.

Nulls: a null text is empty and yields the end id alone; a null doc_id sorts first. Rows that share
an id, or have none, stand in the order of the first 16 characters of their texts, then of the texts' 64-bit hashes,
over as many files as they need; equal texts under one id are dealt over files by their place in the input,
which makes no difference to what is read. An empty table writes files without rows. Further columns
of the input are not written.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import ragged, release_memory, text_batches

ROW = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
_ROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
#: Chunks that a worker keeps the ids of (twice as many for a while), chunks encoded at once, and rows
#: and bytes of text encoded at once: the more, the fewer times a word is looked up.
CACHE, SLICE, ROWS, PIECE = 100_000, 5_000, 4_000, 16 << 20
_BLANK = re.compile(rb"[ \t-\r]")

#: Chunks of letters, then signs: what the tokenizer's rules cut into these two pieces at most.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    """A tokenizer with the ids of the chunks it has met lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.chunks: dict[bytes, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.old_chunks: dict[bytes, bytes] = {}
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytewise = {c: bytewise.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}  # how the model spells them
        probe = "word Übel, été... a-b"
        same = self.whole.encode(probe, add_special_tokens=False).ids == np.frombuffer(b"".join(self._by_pieces(c) or self._whole(c) for c in probe.split()), np.int32).tolist()
        self.by_pieces = same  # else every chunk goes through the whole tokenizer

    def _whole(self, chunk: str) -> bytes:
        return packed(self.whole.encode(chunk, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        text = word if word.isascii() else word.translate(self.bytewise)
        return array("i", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _signs(self, signs: str) -> bytes:
        if signs not in self.signs:
            self.signs[signs] = self._word(signs)
            if len(self.signs) > 10_000:
                self.signs.clear()
                return self._word(signs)
        return self.signs[signs]

    def _by_pieces(self, chunk: str) -> bytes | None:
        """Letters (ASCII, Latin-1) and signs after them, each through the model alone; None for
        chunks of another form."""
        m = _PLAIN.fullmatch(chunk)
        if m is None or "<|" in chunk:
            return None
        word, signs = m.groups()
        return (self._word(word.lower()) if word else b"") + (self._signs(signs) if signs else b"")

    def forget(self) -> None:
        self.chunks, self.old_chunks = {}, {}
        release_memory()

    def learn(self, chunks: set[bytes]) -> None:
        """Makes the ids of all these chunks known. A full table becomes the old one; what is met
        again moves on from there, the rest is forgotten with the next change."""
        if len(self.chunks) + len(chunks) > CACHE:
            self.old_chunks, self.chunks = self.chunks, {}
        known, old, odd = self.chunks, self.old_chunks, []
        for raw in chunks.difference(known):
            ids = old.get(raw)
            if ids is None and self.by_pieces:
                if raw.isalpha():  # ASCII letters alone
                    ids = self._word(raw.decode("ascii").lower())
                elif raw[:-1].isalpha() and raw[-1] in b".,;:!?":
                    ids = self._word(raw[:-1].decode("ascii").lower()) + self._signs(chr(raw[-1]))
                else:
                    ids = self._by_pieces(raw.decode())
            if ids is None:
                odd.append(raw)
            else:
                known[raw] = ids
        for at in range(0, len(odd), SLICE):  # an encoding is far larger than its ids
            part = odd[at : at + SLICE]
            for raw, e in zip(part, self.whole.encode_batch([c.decode() for c in part], add_special_tokens=False), strict=True):
                known[raw] = packed(e.ids)


_encoders: dict[str, Encoder] = {}


def encode_column(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of an Arrow column, one text after the other, ``end_id`` after each, and the
    n+1 offsets of the texts in them. Python sees each different chunk of the column once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = lists.flatten().dictionary_encode()
    chunks = words.dictionary.cast(pa.binary()).to_pylist()
    encoder.learn(set(chunks))
    ids = [*map(encoder.chunks.__getitem__, chunks), packed([end_id])]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    start = np.cumsum(size) - size
    order = np.insert(words.indices.to_numpy(), bounds[1:], len(chunks))  # the end id is the last piece
    tokens = np.frombuffer(b"".join(ids), np.int32)[ragged(start[order], size[order])]
    ends = np.cumsum(size[order])[bounds[1:] + np.arange(len(texts))]
    return tokens, np.concatenate(([0], ends))


def encode_texts(path: str, texts: list[str], end_id: int) -> list[np.ndarray]:
    """Ids of every text, ``end_id`` appended."""
    tokens, at = encode_column(path, pa.array(texts, pa.string()), end_id)
    return [tokens[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def cut_text(raw: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes, cut where white space begins; what has none stays whole."""
    at = 0
    while len(raw) - at > most:
        blank = _BLANK.search(raw, at + most)
        if blank is None:
            break
        yield raw[at : blank.start()]
        at = blank.start()
    yield raw[at:]


def encode_long(path: str, raw: bytes, end_id: int, most: int = PIECE) -> np.ndarray:
    """Ids of one text of any length; only a piece of it is in work at a time."""
    parts = [encode_column(path, pa.array([x], pa.binary()).cast(pa.string()), end_id)[0][:-1] for x in cut_text(raw, most)]
    return np.concatenate([*parts, np.array([end_id], np.int32)])


def _encode_map(path: str, end_id: int, most: int = PIECE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = pyspark.TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column("text")
            step = max(1, int(len(batch) * most / max(most, text.nbytes)))
            for at in range(0, len(batch), step):
                piece = text.slice(at, step)
                if len(piece) == 1 and piece.nbytes > most:
                    tokens = encode_long(path, piece[0].as_buffer().to_pybytes(), end_id, most)
                    bounds = np.array([0, len(tokens)])
                else:
                    tokens, bounds = encode_column(path, piece, end_id)
                size = np.diff(bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, step), pa.array(np.full(len(size), part, np.int32)), pa.array(before + bounds[:-1]), pa.array(size), lists], schema=_ROW)
                before += int(bounds[-1])
                del tokens, lists
        if path in _encoders:
            _encoders[path].forget()  # workers live on; other tasks may need the memory

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, partitions: int | None = None, file_bytes: int = 256 << 20, encoding: str = "delta", row_group_bytes: int = 64 << 20, page_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, ascending by id. ``encoding`` is 'delta' or 'dictionary'. There are as many
    ``partitions`` as asked for, or else as shuffles have, and more where texts are more than ``file_bytes`` for each."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError("encoding must be 'delta' or 'dictionary'")
    least = int(text_batches(docs.sparkSession, ROWS, PIECE).conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = partitions or max(least, -(-(own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // file_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("head"), F.col("hash")]
    ordered = own.select("*", F.substring("text", 1, 16).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")).repartitionByRange(n, *order, "row")
    (
        ordered.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_encode_map(tokenizer, end_id), ROW).write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes).option("compression", "snappy").parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, part_start, n_tokens, start: reads no ids. Totals are a row per file."""
    rows = read_tokens(spark, path).select("doc_id", "part", "part_start", "n_tokens")
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).toLocalIterator())
    before = np.concatenate(([0], np.cumsum([n for _, n in totals]))).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, part_offset long")  # noqa: B905  one more sum than parts
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("part_offset") + F.col("part_start"))


def _digest_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        ids, offs = tokens.flatten().to_numpy().astype("<u4"), tokens.offsets.to_numpy()
        offs = offs - offs[0]
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("part_start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all read back from the files."""
    rows = read_tokens(text_batches(spark), path)
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).toLocalIterator())
    before = np.concatenate(([0], np.cumsum([n for _, n in totals]))).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, part_offset long")  # noqa: B905
    digests = rows.mapInArrow(_digest_map, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return digests.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
