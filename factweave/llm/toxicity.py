"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents off, look-alike letters of other scripts to Latin, and
within words digits and signs that stand for letters to these. The lexicon holds whole words and
word beginnings; weights are smoothed log odds of the labels over documents, learned from a bounded
sample of labelled rows whose crc32(doc_id as text) mod 5 is not 0. Phrases of two words around a
lexicon word that occur in the sample's harmless documents, and hardly in others, are exceptions: a match within one doesn't count. One
automaton finds terms and exceptions in one scan; the weights found, alone and by length, give the
score through a logistic curve.

Bounds: ``sample`` labelled rows, those with the smallest hashes of their ids; of the rows of one id,
the one with the smallest hash of its text. ``terms`` terms and as many exceptions. Everything else is
over all rows.

Nulls: a null text is empty; labels without an id or a value are ignored, of repeated labels the
largest counts; without labels of both kinds every score is 0. Every row gives a row, an empty table
none; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import learns, release_memory, stored, text_batches
from factweave.llm.quality import _decided

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs that stand for letters within a word.
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
SAMPLE, TERMS, PREFIXES = 20_000, 3000, (5, 6, 7, 8)


class _Fold(dict):
    """Translation table filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = HOMOGLYPHS.get(c) or "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        self[code] = c
        return c


_FOLD = _Fold()
_SWAP = str.maketrans(STANDINS)
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$")
_ODD = re.compile(r"[0-9@$!|]")
_NOT_LETTER = re.compile(r"[^\w]+|_+")


def folded(text: str) -> list[str]:
    """The words of a text as the lexicon has them."""
    out = []
    for w in text.translate(_FOLD).split():
        if not w.isalnum() or not w.isalpha():
            w = w.strip(_EDGE).rstrip("@$")
            if _ODD.search(w) and any(map(str.isalpha, w)):
                w = w.translate(_SWAP)
            w = _NOT_LETTER.sub("", w)
        if w:
            out.append(w)
    return out


def terms_of(words: list[str]) -> set[str]:
    """Whole words as ' word ', word beginnings as ' begin'."""
    found = set()
    for w in set(words):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, ...]

    def automaton(self):
        if "_machine" not in self.__dict__:
            machine = ahocorasick.Automaton()
            for term, w in self.weights.items():
                machine.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                machine.add_word(phrase, (len(phrase), None))
            if len(machine):
                machine.make_automaton()
            self.__dict__["_machine"] = machine
        return self.__dict__["_machine"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_machine"}

    def matches(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(start, end, weight) of what counts, the heaviest term of each word."""
        machine, text = self.automaton(), " " + " ".join(words) + " "
        if not words or not len(machine):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (size, w) in machine.iter(text):
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            elif start not in best or best[start][1] < w:
                best[start] = (end, w)
        return [(a, b, w) for a, (b, w) in best.items() if not any(x <= a and b <= y for x, y in spared)]

    def features(self, text: str) -> tuple[float, float, float]:
        words = folded(text)
        found = [w for _, _, w in self.matches(words)]
        total = sum(found)
        return max(found, default=0.0), math.log1p(total), total / math.sqrt(len(words) + 10)

    def score(self, text: str) -> float:
        if not self.curve:
            return 0.0
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    z = np.concatenate((np.ones((len(x), 1)), x), 1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)) * 0.1
        w = w + np.linalg.solve(h, z.T @ (y - p) - ridge * 0.1 * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Lexicon:
    """The lexicon from at most ``sample`` labelled rows, one of each id; ``terms`` terms and as many
    exceptions at most."""
    text_batches(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().where(learns(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a row of each id, reduced before the exchange: an id that a third of the rows share is one row too
    one = own.join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    train = stored(one.select("text", "y").repartition(12), "toxic-sample")

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg, n = Counter(), Counter(), [0, 0]
        for p in parts:
            for text, label in zip(p["text"], p["y"], strict=True):
                (pos if label else neg).update(terms_of(folded(text)))
                n[bool(label)] += 1
        rows = [("", n[1], n[0]), *((t, pos[t], neg[t]) for t in pos)]
        yield pd.DataFrame(rows, columns=["term", "pos", "neg"])
        yield pd.DataFrame([(t, 0, c) for t, c in neg.items() if t not in pos], columns=["term", "pos", "neg"])

    table = stored(train.mapInPandas(counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "terms")
    sums = table.where("term = ''").first()
    if sums is None or not sums["pos"] or not sums["neg"]:
        return Lexicon({}, frozenset(), ())
    p_all, n_all = float(sums["pos"]), float(sums["neg"])
    odds = F.log((F.col("pos") + 0.1) / p_all) - F.log((F.col("neg") + 0.1 * n_all / p_all) / n_all)
    # the least that a term must show: four standard errors of chance, and three documents
    chance = (F.col("pos") + F.col("neg")) * (p_all / (p_all + n_all))
    clear = (F.col("pos") >= 3) & (F.col("pos") - chance > 4 * F.sqrt(chance)) & (odds > 1.2)
    rows = table.where((F.col("term") != "") & clear).withColumn("w", odds).orderBy(F.desc(F.col("pos") * F.col("w")), "term").limit(terms).toPandas()
    weights = dict(zip(rows["term"], rows["w"].astype(float), strict=True))
    whole = {t.strip() for t in weights if t.endswith(" ")}

    def phrases(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = Counter(), Counter()
        for p in parts:
            for text, label in zip(p["text"], p["y"], strict=True):
                words = folded(text)
                (pos if label else neg).update({f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if a in whole or b in whole})
        yield pd.DataFrame([(t, pos[t], c) for t, c in neg.items()], columns=["term", "pos", "neg"])

    rows = train.mapInPandas(phrases, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spare = frozenset(r["term"] for r in rows.where("neg >= 3 and pos * 10 <= neg").orderBy(F.desc("neg"), "term").limit(terms).toLocalIterator())
    lexicon = Lexicon(weights, spare, ())

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(*lexicon.features(t), float(v)) for t, v in zip(p["text"], p["y"], strict=True)], columns=["a", "b", "c", "y"])

    x = train.mapInPandas(measured, "a double, b double, c double, y double").toPandas().to_numpy()  # `sample` rows at most
    return Lexicon(weights, spare, tuple(logistic(x[:, :3], x[:, 3]).tolist()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, **how) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    lexicon = learn(docs, labels, id_col, text_col, label_col, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
        release_memory()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _decided(own.mapInArrow(run, "doc_id long, score double"), threshold)
