"""The learned operators against plain versions on whole tables, and the token files against the tokenizer."""

import glob
import math
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factweave.llm import quality, token_files, toxicity
from factweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def learnable(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def labels_of(spark, name):
    return {r["doc_id"]: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def plain_statistics(text):
    """Some of the statistics, word by word: sizes, word lengths, repeats, lines."""
    raw = text.encode()
    words = raw.split()
    n = max(1, len(words))
    sizes = [len(w) for w in words]
    counts = {w: words.count(w) for w in set(words)}
    lines = [tuple(x.split()) for x in raw.split(b"\n") if x.split()]
    mean = sum(sizes) / n
    return [
        math.log1p(len(raw)), math.log1p(len(words)), mean, math.sqrt(max(0.0, sum(s * s for s in sizes) / n - mean**2)), sum(s > 15 for s in sizes) / n, sum(s <= 2 for s in sizes) / n,
        sum(65 <= b <= 90 for b in raw) / max(1, len(raw)), sum(97 <= b <= 122 for b in raw) / max(1, len(raw)), sum(48 <= b <= 57 for b in raw) / max(1, len(raw)), sum(b > 127 for b in raw) / max(1, len(raw)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(counts) / n, max(counts.values(), default=0) / n, sum(c >= 3 for c in counts.values()) / max(1, len(counts)),
        math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
    ]


def test_statistics_against_plain_counts(texts):
    import pyarrow as pa

    some = [*list(texts.values())[:150], "", " \n\t ", "a", "é\n\né a a a", "x" * 5000]
    got = quality.statistics(pa.array(some))[:, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 14, 15, 16, 17, 18]]
    assert np.allclose(got, [plain_statistics(t) for t in some], atol=1e-9)


def test_quality_against_plain_fit(spark, texts):
    """Normal equations, ridge and isotonic steps over all labelled rows at once; scores of all rows."""
    import pyarrow as pa

    labels, ids = labels_of(spark, "quality"), sorted(texts)
    x = quality.statistics(pa.array([texts[i] for i in ids])).astype(np.float32).astype(float)
    rows = [k for k, i in enumerate(ids) if i in labels and labels[i] is not None and learnable(i)]
    t, y = x[rows], np.array([labels[ids[k]] for k in rows], float)
    mean, scale = t.mean(0), t.std(0)
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    turn = rng.normal(0, 1 / quality.WIDTH, (t.shape[1], quality.FEATURES))
    shift = rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def expand(v):
        z = np.clip((v - mean) / scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / quality.FEATURES) * np.cos(z @ turn + shift)])

    z = expand(t)
    w = np.linalg.solve(z.T @ z + 1e-2 * len(t) / quality.FEATURES * np.eye(z.shape[1]), z.T @ y)
    bins = np.clip(np.floor((z @ w + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    places = np.unique(bins)
    level = [y[bins == b].mean() for b in places]
    weight = [float((bins == b).sum()) for b in places]
    blocks = [[k] for k in range(len(places))]  # pool until no block is above the next
    mean_of = lambda b, v: sum(v[k] * weight[k] for k in b) / sum(weight[k] for k in b)
    while any(mean_of(a, level) >= mean_of(b, level) for a, b in zip(blocks, blocks[1:], strict=False)):
        at = next(k for k in range(len(blocks) - 1) if mean_of(blocks[k], level) >= mean_of(blocks[k + 1], level))
        blocks[at : at + 2] = [blocks[at] + blocks[at + 1]]
    middle = [(p + 0.5) / quality.BINS * 2 - 0.5 for p in places]
    want = np.interp(expand(x) @ w, [mean_of(b, middle) for b in blocks], [mean_of(b, level) for b in blocks])
    got = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, SF).collect()}
    assert len(got) == len(ids)
    assert np.allclose([got[i]["score"] for i in ids], np.clip(want, 0, 1), atol=1e-4)
    assert all(got[i]["held_out"] == (not learnable(i)) and got[i]["predicted"] == int(got[i]["score"] >= 0.3) for i in ids)


def plain_words(text):
    """Folded words, letter by letter."""
    out = []
    flat = []
    for c in text:
        c = c.lower()
        if c in toxicity.HOMOGLYPHS:
            flat.append(toxicity.HOMOGLYPHS[c])
        else:
            flat += [toxicity.HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
    for w in "".join(flat).split():
        if not w.isalpha():
            w = re.sub(r"^[!-#%-/:-?\[-`{-~]+|[!-#%-/:-?\[-`{-~]+$", "", w).rstrip("@$")
            if any(c in "0123456789@$!|" for c in w) and any(c.isalpha() for c in w):
                w = "".join(toxicity.STANDINS.get(c, c) for c in w)
            w = "".join(c for c in w if re.match(r"[^\W_]", c))
        if w:
            out.append(w)
    return out


def plain_lexicon(labelled, most=toxicity.TERMS):
    """Weights and exceptions by plain counts over documents; ``labelled`` has (words, label)."""
    pos, neg = {}, {}
    for words, y in labelled:
        terms = {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in toxicity.PREFIXES if len(w) > k}
        for t in terms:
            (pos if y else neg)[t] = (pos if y else neg).get(t, 0) + 1
    p_all, n_all = sum(y for _, y in labelled), sum(1 - y for _, y in labelled)
    weights = {}
    for t, p in pos.items():
        n = neg.get(t, 0)
        odds = math.log((p + 0.1) / p_all) - math.log((n + 0.1 * n_all / p_all) / n_all)
        chance = (p + n) * p_all / (p_all + n_all)
        if p >= 3 and p - chance > 4 * math.sqrt(chance) and odds > 1.2:
            weights[t] = odds
    weights = dict(sorted(weights.items(), key=lambda x: (-pos[x[0]] * x[1], x[0]))[:most])
    whole = {t.strip() for t in weights if t.endswith(" ")}
    with_, without = {}, {}
    for words, y in labelled:
        for t in {f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if a in whole or b in whole}:
            (with_ if y else without)[t] = (with_ if y else without).get(t, 0) + 1
    spare = [t for t, n in without.items() if n >= 3 and with_.get(t, 0) * 10 <= n]
    return weights, set(sorted(spare, key=lambda t: (-without[t], t))[:most])


def plain_matches(words, weights, spare):
    """The heaviest term of each word that no exception covers, word by word."""
    found = []
    for i, w in enumerate(words):
        terms = [f" {w} "] + [f" {w[:k]}" for k in toxicity.PREFIXES if len(w) >= k]
        best = max((weights[t], len(t)) for t in terms if t in weights) if any(t in weights for t in terms) else None
        near = [f" {a} {b} " for a, b in ((words[i - 1] if i else None, w), (w, words[i + 1] if i + 1 < len(words) else None)) if a and b]
        if best and not any(t in spare for t in near):
            found.append(best[0])
    return found


def test_toxicity_against_plain_counts(spark, texts):
    """Folding, weights, exceptions, matches, features and scores of all rows, without an automaton."""
    labels = labels_of(spark, "toxic")
    words = {i: plain_words(t) for i, t in texts.items()}
    assert all(toxicity.folded(texts[i]) == words[i] for i in texts)
    labelled = [(words[i], labels[i]) for i in texts if labels.get(i) is not None and learnable(i)]
    weights, spare = plain_lexicon(labelled)
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, marks)
    assert lexicon.weights.keys() == weights.keys() and np.allclose([lexicon.weights[t] for t in weights], list(weights.values()))
    assert lexicon.exceptions == spare

    def features(w):
        found = plain_matches(w, weights, spare)
        return [max(found, default=0.0), math.log1p(sum(found)), sum(found) / math.sqrt(len(w) + 10)]

    x, y = np.array([features(w) for w, _ in labelled]), np.array([v for _, v in labelled], float)
    z, c = np.hstack([np.ones((len(x), 1)), x]), np.zeros(4)
    for _ in range(2000):  # plain Newton steps to the penalised optimum
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + 0.1 * np.eye(4), z.T @ (y - p) - 0.1 * c)
        c = c + step
        if np.abs(step).max() < 1e-12:
            break
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    ids = sorted(texts)
    want = 1 / (1 + np.exp(-np.clip(np.hstack([np.ones((len(ids), 1)), np.array([features(words[i]) for i in ids])]) @ c, -30, 30)))
    assert np.allclose([got[i]["score"] for i in ids], want, atol=1e-3)
    assert all(got[i]["held_out"] == (not learnable(i)) and got[i]["predicted"] == int(got[i]["score"] >= 0.5) for i in ids)


def test_toxicity_learns_from_bounded_rows(spark):
    """An id that stands in very many rows is one row of the sample."""
    rows_ = [(1, f"same id {i}") for i in range(500)] + [(i, "nice words here" if i % 2 else "awful nasty words") for i in range(2, 60)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    seen = []
    keep = toxicity.stored
    toxicity.stored = lambda df, name: seen.append(keep(df, name)) or seen[-1]
    try:
        toxicity.learn(docs, labels, sample=20)
    finally:
        toxicity.stored = keep
    assert seen[0].count() == 20


def test_tokens_of_a_whole_table(spark, texts):
    """Every text of the table as the tokenizer itself encodes it."""
    from tokenizers import Tokenizer

    whole, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(texts):
        ids = [*whole.encode(texts[i], add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op7_token_files"](spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files_as_written(spark, tmp_path, encoding):
    """Encodings, row groups of the stated size and page indexes; metadata is read without ids."""
    path = f"{tmp_path}/t"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.write_tokens(docs, f"file://{path}", public_tokenizers.path("word_bpe_49k.json"), encoding=encoding, partitions=2, row_group_bytes=1 << 18, page_bytes=1 << 14)
    groups = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for k in range(meta.num_row_groups):
            for c in range(meta.row_group(k).num_columns):
                col = meta.row_group(k).column(c)
                if col.path_in_schema.startswith("tokens"):
                    assert ("RLE_DICTIONARY" in col.encodings) == (encoding == "dictionary")
                    assert ("DELTA_BINARY_PACKED" in col.encodings) == (encoding == "delta")
                assert col.has_column_index and col.has_offset_index
    assert groups > 4
    plan = token_files.document_starts(spark, f"file://{path}")._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in re.sub(r"n_tokens", "", "".join(re.findall(r"ReadSchema: (.*)", plan)))


def test_long_texts(spark):
    """Texts of megabytes go through in pieces, with the ids of the whole."""
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    long = "lorem ipsum, dolor\tsit amet é中 " * 6000
    whole = Tokenizer.from_file(name).encode(long, add_special_tokens=False).ids + [1]
    for most in (1000, 50_000, len(long.encode())):
        assert token_files.encode_long(name, long.encode(), 1, most).tolist() == whole
    assert b"".join(token_files.cut_text(b"a" * 50 + b" b c" * 20, 7)) == b"a" * 50 + b" b c" * 20
    docs = spark.createDataFrame([(1, long * 20), (2, "x"), (3, None)], "doc_id long, text string")
    token_files.write_tokens(docs, path := token_files_path(spark), name)
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.read_digests(spark, path).collect()}
    assert got == {1: 20 * (len(whole) - 1) + 1, 2: 2, 3: 1}


def token_files_path(spark):
    from factweave.llm.common import scratch

    return scratch(spark, "test-tokens")


def test_empty_token_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, part int, tokens int")
    token_files.write_tokens(docs, path := token_files_path(spark), public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_digests(spark, path).isEmpty() and token_files.document_starts(spark, path).where(F.lit(True)).isEmpty()


def test_one_id_of_many_rows_fills_several_files(spark):
    """Rows without an id, and copies of one text among them, are dealt over files and stay in order."""
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, f"text number {i}") for i in range(300)] + [(None, "the same text")] * 300 + [(7, "last"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    token_files.write_tokens(docs, path := token_files_path(spark), name, file_bytes=1 << 10)
    got = token_files.read_tokens(spark, path)
    sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 200  # bytes decide on the number of files
    held = got.orderBy("part", "part_start").collect()
    whole = Tokenizer.from_file(name)
    assert sorted(map(list, (r["tokens"] for r in held))) == sorted([*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
    assert [r["doc_id"] for r in held] == [None] * 601 + [7]
    starts = sorted((r["start"], r["n_tokens"]) for r in token_files.read_digests(spark, path).collect())
    assert [a + n for a, n in starts[:-1]] == [a for a, _ in starts[1:]] and starts[0][0] == 0
