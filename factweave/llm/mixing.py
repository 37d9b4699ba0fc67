"""Mixing sources to target weights by iterative proportional fitting.

Every document gets a source, a language, a topic and a token weight (its number of words). Token
totals of the (source, language, topic) cells are raked to the three target marginals, one after the
other and over again; the factor of a cell over the largest factor of any cell that has tokens is the
chance with which its documents are kept, so that the raked marginals hold in expectation (where targets
contradict each other, those of the axis raked last). It is decided by
a hash of the document's id and text, so that a run can be repeated. No document is kept twice. A
source that holds a third of the rows is one cell total per topic and language, pre-aggregated in each
task.

Topics are found here too: texts become histograms of hashed byte trigrams, and a spherical k-means
over all documents names the nearest of ``TOPICS`` centres. Each of its ``PASSES`` adds up, centre by
centre, the vectors of all documents as whole numbers, so that neither the order of the rows nor their
partitions count; it starts from the texts with the smallest hashes.

Targets default to a tempering of the corpus's own shares, share ** ``temper``, which lifts small
sources, languages and topics. Of given targets, a target of zero keeps nothing, a value without a target
keeps its own share, and the other targets are scaled to what these leave; targets of values without tokens
don't count. Raking ends when a whole round leaves every factor where it was, or after ``ROUNDS``; it
runs on the driver while there are at most ``CELLS`` cells, beyond that as joins over the cell table, by the
same rule and to the same convergence. ``achieved`` tells how far a mixture is from its targets.

Two arguments trade targets for documents, and are off unless asked for. ``least``: values with less than
this share of the tokens are tempered as one and keep their proportions among each other. ``spread``: no
cell's factor exceeds ``spread`` times the product of its values' lifts (target over share). Where topics follow
languages, raking meets the last thousandths of a target by a few rare cells, and these set the price in
documents for all; under a bound such targets are missed by what ``achieved`` says.

Nulls: a null source, language or text counts as ''; a null id hashes like any other value. Rows that
occur twice are decided alike. An empty table gives an empty one. Cells of zero weight have no part in
the largest factor. Further columns stay untouched; working columns have names of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import by_bytes, flat_text, release_memory, stored, text_batches

TOPICS, PASSES, GRAMS, CELLS, ROUNDS, CLOSE = 8, 6, 1024, 200_000, 50, 1e-9
AXES = ("source", "lang", "topic")


def trigram_shares(column) -> np.ndarray:
    """A unit vector of hashed byte trigrams for every text, damped by the square root."""
    flat, offs = flat_text(column)
    n = len(offs) - 1
    out = np.zeros((n, GRAMS), np.float32)
    if len(flat) > 2:
        b = flat.astype(np.uint32)
        gram = ((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) * np.uint32(2654435761) >> np.uint32(22)
        doc = np.repeat(np.arange(n), np.diff(offs))
        whole = doc[2:] == doc[:-2]
        count = np.bincount(doc[:-2][whole] * GRAMS + gram[whole], minlength=n * GRAMS).reshape(n, GRAMS)
        out = np.sqrt(count).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T, axis=1)


def topic_centres(docs: DataFrame, text_col: str, topics: int = TOPICS, passes: int = PASSES) -> np.ndarray:
    """Spherical k-means over all documents; the same documents give the same centres."""
    text_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = own.select(F.xxhash64("text").alias("h"))
    start = [r["h"] for r in digest.distinct().orderBy(F.xxhash64("h"), "h").limit(topics).collect()]
    if not start:
        return np.zeros((1, GRAMS), np.float32)
    rows = own.withColumn("h", F.xxhash64("text")).where(F.col("h").isin(start)).groupBy("h").agg(F.min("text").alias("text")).collect()
    c = trigram_shares(pa.array([r["text"] for r in sorted(rows, key=lambda r: r["h"])], pa.string()))

    def summed(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(centres.shape, np.int64)
            for batch in batches:
                for piece in by_bytes(batch.column("text")):
                    x = trigram_shares(piece)
                    member = np.zeros((len(x), len(centres)))
                    member[np.arange(len(x)), nearest(x, centres)] = 1
                    total += (member.T @ np.rint(x * np.float64(1 << 24))).astype(np.int64)
            release_memory()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "s"])

        return run

    for _ in range(passes):
        sums = own.mapInArrow(summed(c), "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
        total = np.zeros(c.size)
        total[sums["at"].to_numpy(np.int64)] = sums["s"].to_numpy(float)
        total = total.reshape(c.shape)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        new = np.where(norm > 0, total / np.maximum(norm, 1e-9), c).astype(np.float32)
        if np.array_equal(new, c):
            break
        c = new
    return c


def rake(cells: np.ndarray, weight: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE, most: np.ndarray | None = None) -> np.ndarray:
    """Factor of each cell: ``cells`` has its index on every axis, ``targets`` each axis's shares,
    ``most`` a bound on each cell's factor, which holds after every round."""
    factor = np.ones(len(weight))
    if not len(weight) or weight.sum() <= 0:
        return factor
    for _ in range(rounds):
        was = factor.copy()
        for axis, share in enumerate(targets):
            now = np.bincount(cells[:, axis], factor * weight, len(share))
            step = np.where(now > 0, share * weight.sum() / np.where(now > 0, now, 1), 1.0)
            factor *= step[cells[:, axis]]
        if most is not None:
            factor = np.minimum(factor, most)
        if float(np.abs(factor[was > 0] / was[was > 0] - 1).max(initial=0)) < close:
            break
    return factor


def rake_tables(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """The same over a cell table of any size, with the bounds in a column ``most`` if there is one;
    lineage is cut after every round."""
    whole = cells.agg(F.sum("w")).first()[0] or 0.0
    cells = cells.withColumn("factor", F.lit(1.0))
    if whole <= 0:
        return cells
    for _ in range(rounds):
        cells = cells.withColumn("was", F.col("factor"))
        for axis, share in targets.items():
            now = cells.groupBy(axis).agg(F.sum(F.col("w") * F.col("factor")).alias("now")).join(share.select(axis, "share"), axis)
            step = F.when(F.col("now") > 0, F.col("share") * F.lit(float(whole)) / F.col("now")).otherwise(F.lit(1.0))
            steps = stored(now.select(axis, step.alias("step")), "steps")
            cells = cells.join(steps, axis).withColumn("factor", F.col("factor") * F.col("step")).drop("step")
        if "most" in cells.columns:
            cells = cells.withColumn("factor", F.least("factor", "most"))
        cells = stored(cells, "rake")
        moved = cells.where("was > 0").agg(F.max(F.abs(F.col("factor") / F.col("was") - 1))).first()[0]
        cells = cells.drop("was")
        if (moved or 0.0) < close:
            break
    return cells


def share_table(cells: DataFrame, axis: str, temper: float, given: dict | None, least: float = 0.0) -> DataFrame:
    """(axis, share): the target share of every present value of an axis."""
    total = cells.groupBy(axis).agg(F.sum("w").alias("t"))
    whole = float(cells.agg(F.sum("w")).first()[0] or 0.0) or 1.0
    each = stored(total.select(axis, (F.col("t") / whole).alias("own")), "shares")
    zero = F.lit(0.0)
    if given is None:
        small = float(each.where(F.col("own") < least).agg(F.sum("own")).first()[0] or 0.0)
        low = F.lit(small**temper / small if small else 0.0)
        part = each.select(axis, F.when(F.col("own") < least, F.col("own") * low).otherwise(F.pow("own", F.lit(float(temper)))).alias("want"), zero.alias("own"))
    else:
        kind = cells.schema[axis].dataType.simpleString()
        asked = cells.sparkSession.createDataFrame([(k, max(0.0, float(v))) for k, v in given.items()], f"`{axis}` {kind}, asked double")
        # a value without tokens can't take a share
        want = F.when(F.col("own") > 0, F.coalesce("asked", zero)).otherwise(zero)
        part = each.join(asked, axis, "left").select(axis, want.alias("want"), F.when(F.col("asked").isNull(), F.col("own")).otherwise(zero).alias("own"))
    part = stored(part, "targets")
    scale, stretch = scales(*(float(x or 0.0) for x in part.agg(F.sum("want"), F.sum("own")).first()))
    return part.select(axis, (F.col("want") * F.lit(scale) + F.col("own") * F.lit(stretch)).alias("share"))


def scales(want: float, own: float) -> tuple[float, float]:
    """What targets, and the shares of values without one, are multiplied by to be 1 in all."""
    if want > 0:
        return max(0.0, 1 - own) / want, 1.0
    return 0.0, 1 / own if own > 0 else 0.0


def word_counts(column) -> np.ndarray:
    """The number of words of every text."""
    flat, offs = flat_text(column)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    before = np.ones(len(flat) + 1, bool)
    before[1:] = blank
    before[offs] = True
    seen = np.concatenate(([0], np.cumsum(~blank & before[:-1])))
    return seen[offs[1:]] - seen[offs[:-1]]


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """The documents and, in __mix, source, lang, topic, tokens and a uniform number of each."""
    centres = topic_centres(docs, text_col)

    @F.arrow_udf("struct<topic:int,tokens:bigint>")
    def measured(text: pa.Array) -> pa.Array:
        topic, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for piece in by_bytes(text):
            topic.append(nearest(trigram_shares(piece), centres))
            tokens.append(word_counts(piece))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(topic).astype(np.int32)), pa.array(np.concatenate(tokens).astype(np.int64))], ["topic", "tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(id_col).cast("string"), text), 11) / F.lit(float(1 << 53))
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.withColumn("__measured", measured(text))
    mix = F.struct(label(source_col).alias("source"), label(lang_col).alias("lang"), F.col("__measured.topic").alias("topic"), F.col("__measured.tokens").alias("tokens"), chance.alias("chance"))
    return own.withColumn("__mix", mix).drop("__measured")


def axis_shares(total: np.ndarray, values: list, temper: float, given: dict | None, least: float = 0.0) -> np.ndarray:
    """``share_table`` on the driver: ``total`` has the tokens of each of ``values``."""
    own = total / (total.sum() or 1.0)
    if given is None:
        small = own[own < least].sum()
        want, own = np.where(own < least, own * (small**temper / small if small else 0.0), np.power(own, temper)), np.zeros(len(own))
    else:
        want = np.where(own > 0, [max(0.0, float(given.get(v, 0))) for v in values], 0.0)
        own = np.where([v in given for v in values], 0.0, own)
    scale, stretch = scales(float(want.sum()), float(own.sum()))
    return want * scale + own * stretch


def cell_rates(cells: DataFrame, temper: float, targets: dict[str, dict] | None, cap: int = CELLS, rounds: int = ROUNDS, least: float = 0.0, spread: float | None = None) -> DataFrame:
    """(source, lang, topic, w, factor, rate) of every cell; rate is its documents' probability."""
    given = targets or {}
    if cells.count() <= cap:
        rows = cells.toPandas().sort_values(list(AXES)).reset_index(drop=True)
        schema = "source string, lang string, topic int, w double, factor double, rate double"
        if not len(rows):
            return cells.sparkSession.createDataFrame([], schema)
        w = rows["w"].to_numpy(float)
        index, shares = [], []
        for axis in AXES:
            code, values = pd.factorize(rows[axis], sort=True)
            index.append(code)
            shares.append(axis_shares(np.bincount(code, w, len(values)), values.tolist(), temper, given.get(axis), least))
        index, most = np.stack(index, 1), None
        if spread is not None:
            own = [np.bincount(code, w, len(share)) / (w.sum() or 1.0) for code, share in zip(index.T, shares, strict=True)]
            lifts = [np.divide(share, o, out=np.ones(len(share)), where=o > 0) for share, o in zip(shares, own, strict=True)]
            most = spread * np.prod([lift[code] for lift, code in zip(lifts, index.T, strict=True)], axis=0)
        rows["factor"] = factor = rake(index, w, shares, rounds, most=most)
        top = factor[w > 0].max(initial=0) if (w > 0).any() else 1.0
        rows["rate"] = np.minimum(1.0, factor / top) if top > 0 else (factor > 0).astype(float)
        return cells.sparkSession.createDataFrame(rows[["source", "lang", "topic", "w", "factor", "rate"]].astype({"topic": "int32"}), schema)
    shares = {axis: share_table(cells, axis, temper, given.get(axis), least) for axis in AXES}
    if spread is not None:
        cells = stored(_bounded(cells, shares, spread), "bounded")
    raked = rake_tables(cells, shares, rounds)
    top = raked.where("w > 0").agg(F.max("factor")).first()[0]
    top = 1.0 if top is None else top
    rate = F.least(F.lit(1.0), F.col("factor") / F.lit(float(top))) if top > 0 else (F.col("factor") > 0).cast("double")
    return raked.select("source", "lang", "topic", "w", "factor", rate.alias("rate"))


def _bounded(cells: DataFrame, shares: dict[str, DataFrame], spread: float) -> DataFrame:
    """The cells with the bound on their factor in ``most``."""
    whole = float(cells.agg(F.sum("w")).first()[0] or 0.0) or 1.0
    out = cells.withColumn("most", F.lit(float(spread)))
    for axis, share in shares.items():
        own = cells.groupBy(axis).agg((F.sum("w") / whole).alias("own")).join(share, axis)
        lift = own.select(axis, F.when(F.col("own") > 0, F.col("share") / F.col("own")).otherwise(F.lit(1.0)).alias("lift"))
        out = out.join(lift, axis).withColumn("most", F.col("most") * F.col("lift")).drop("lift")
    return out


def achieved(rates: DataFrame, temper: float = 0.95, targets: dict[str, dict] | None = None, least: float = 0.0) -> DataFrame:
    """axis, value, share, target, expected of every value: what ``cell_rates`` come to, against what they
    were to come to; a row for each value of an axis."""
    out = None
    for axis in AXES:
        want = share_table(rates, axis, temper, (targets or {}).get(axis), least)
        sums = rates.groupBy(axis).agg(F.sum("w").alias("had"), F.sum(F.col("w") * F.col("rate")).alias("has"))
        total = rates.agg(F.sum("w").alias("whole"), F.sum(F.col("w") * F.col("rate")).alias("kept"))
        one = sums.join(want, axis).join(F.broadcast(total))
        one = one.select(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("value"), F.try_divide("had", "whole").alias("share"), F.col("share").alias("target"), F.try_divide("has", "kept").alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


def mixed_documents(docs: DataFrame, temper: float = 0.95, targets: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: bool = True, least: float = 0.0, spread: float | None = None) -> DataFrame:
    """With ``keep``, the sampled documents, columns as they were. Without, a row per document:
    doc_id, source, lang, topic, n_tokens, factor, rate and sampled."""
    own = described(docs, id_col, text_col, source_col, lang_col)
    narrow = own.select(F.col(id_col).alias("id"), "__mix.*")
    narrow = narrow if keep else stored(narrow, "cells")
    cells = stored(narrow.groupBy(*AXES).agg(F.sum("tokens").cast("double").alias("w")), "totals")
    rates = cell_rates(cells, temper, targets, least=least, spread=spread)
    bounded = rates.count() <= CELLS
    if not keep:
        each = narrow.join(F.broadcast(rates) if bounded else rates, list(AXES))
        return each.select(F.col("id").alias("doc_id"), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "factor", "rate", (F.col("chance") < F.col("rate")).alias("sampled"))
    # texts stay where they are: the rate of a cell comes to the document
    cell = rates.select(F.struct(*AXES).alias("__cell"), F.col("rate").alias("__rate"))
    here = own.withColumn("__at", F.struct(*(F.col(f"__mix.{a}").alias(a) for a in AXES)))
    kept = here.join(F.broadcast(cell) if bounded else cell, F.col("__at") == F.col("__cell"))
    return kept.where(F.col("__mix.chance") < F.col("__rate")).select(*docs.columns)
