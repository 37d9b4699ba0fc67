"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from factweave.llm import decontaminate, exact_dedup, line_dedup, mixing, packed, quality, simhash, suffix_dedup, superkmer_dedup, token_files, toxicity
from factweave.llm.common import keyed, minimiser_runs, ragged, rolled, spans_of
from factweave.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import oracle_rows, rows

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
SCHEMA = "doc_id long, text string, lang string, source string, digest string, n long, keep long, lo int, score double"


def corpus():
    """Copies, near copies, shared passages, nulls, empties, ties, repeated rows, a very long text."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", ".", ",", "\n"]) for _ in range(n))
    passage, base = say(80), say(200)
    out = [(i, say(rng.randint(1, 120))) for i in range(25)]
    out += [(100 + i, say(10) + " " + passage + " " + say(10)) for i in range(6)]
    out += [(200 + i, base if i % 2 else base.upper()) for i in range(5)]
    out += [(300 + i, base.replace("alpha", f"word{i}", 1)) for i in range(4)]
    out += [(400, None), (401, ""), (402, "   \t"), (None, base), (None, None), (403, "é中文 " * 60), (403, "é中文 " * 60), (403, "other text under the id " * 9)]
    out += [(500, "x" * 400), (501, say(6000))]
    return [(i, t, "en", "s", "d", 1, 2, 3, 0.5) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    df.path = path
    return df


def keyed_rows(docs):
    """(did, dig, text, doc_id) of different documents in order."""
    own = keyed(docs).distinct().collect()
    return sorted((r["did"], r["dig"], r["text"]) for r in own)


def public(did):
    return None if did == -(2**63) else did


def expected(docs, results):
    """Results by (did, dig) spread over all rows, as sorted tuples."""
    return sorted((str(public(r["did"])), *map(str, results[r["did"], r["dig"]])) for r in keyed(docs).collect())


def got(df, *cols):
    return sorted((str(r["doc_id"]), *(str(r[c]) for c in cols)) for r in df.collect())


def brute_windows(tokens_of, docs, width):
    seen, out = set(), {}
    for did, dig, text in keyed_rows(docs):
        tokens = tokens_of(text)
        gone = np.zeros(len(tokens), bool)
        for p in range(len(tokens) - width + 1):
            w = tokens[p : p + width]
            w = bytes(w) if isinstance(tokens, bytes) else tuple(w)
            if w in seen:
                gone[p : p + width] = True
            seen.add(w)
        out[did, dig] = tokens, gone
    return out


def test_exact(spark, docs):
    def want():
        groups = {}
        low = [(r["doc_id"], "".join(c.lower() if c.isascii() else c for c in r["text"] or "")) for r in docs.collect()]
        for i, t in low:
            groups.setdefault(t, []).append(i)
        key = lambda i: -(2**63) if i is None else i
        return sorted((str(i), str(max(groups[t], key=key)), str(len(groups[t])), hashlib.sha256(t.encode()).hexdigest()) for i, t in low), len(groups)

    rows_wanted, n = want()
    for digest in (exact_dedup.sha, lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1)):  # the second collides
        df = exact_dedup.dedup_exact(spark, docs.path, digest=digest).cache()
        assert got(df, "keep_id", "group_size", "text_sha256") == rows_wanted
        assert df.where("kept").count() == n


def test_exact_state_survives_between_calls(spark, tmp_path):
    path, state = f"file://{tmp_path}/d", f"file://{tmp_path}/state"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    df.write.parquet(path)
    exact_dedup.dedup_exact(spark, path, state)
    spark.createDataFrame([(3, "A")], "doc_id long, text string").write.mode("append").parquet(path)
    assert got(exact_dedup.dedup_exact(spark, path, state), "keep_id", "group_size") == [("1", "3", "2"), ("2", "2", "1"), ("3", "3", "2")]


DEALT = np.sort(np.repeat(suffix_dedup.eights(np.frombuffer(b"alpha beta gamma delta", np.uint8))[:9], 3))


@pytest.mark.parametrize("how", [{}, {"splitters": DEALT}, {"limit": 1}, {"bucket_bytes": 1000}, {"splitters": DEALT, "limit": 3000}])
def test_suffix(docs, how):
    """Every leading value dealt over several buckets; buckets that overflow again and again; many
    buckets to a range."""
    want = {}
    for k, (raw, gone) in brute_windows(lambda t: t.encode(), docs, 100).items():
        want[k] = len(raw), int(gone.sum()), len(spans_of(gone)[0]), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
    assert got(suffix_dedup.dedup_substrings(docs, **how), "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected(docs, want)


@pytest.mark.parametrize("how", [{}, {"limit": 1}, {"limit": 3000, "bucket_bytes": 1000}])
def test_superkmer(docs, how):
    """The second and third case overflow their buckets, so that windows go on one by one."""
    want = {}
    for k, (words, gone) in brute_windows(lambda t: t.encode().split(), docs, 20).items():
        want[k] = len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()
    assert got(superkmer_dedup.dedup_word_windows(docs, **how), "n_words", "n_removed", "kept_sha256") == expected(docs, want)


def test_windows_of_long_texts_are_found_in_chunks():
    """The same super-k-mers but for cuts at the chunks, each anchor within its window."""
    import pyarrow as pa

    rng = random.Random(2)
    texts = pa.array([" ".join(rng.choice(WORDS) for _ in range(n)) for n in (5, 700, 19, 20, 1200)])
    words = superkmer_dedup.Words(*superkmer_dedup.flat_text(texts))
    whole, parts = (superkmer_dedup.super_kmers(words, 20, 5, chunk=c) for c in (1 << 22, 64))
    each = lambda x: sorted(zip(ragged(x[0], x[1]).tolist(), np.repeat(x[2], x[1]).tolist(), np.repeat(x[3], x[1]).tolist(), strict=True))
    assert each(whole) == each(parts)
    assert all(f <= p <= f + 15 for f, p, _ in each(parts))


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 7, "hot_rows": 1}])
def test_simhash(docs, how):
    fps = [(-(2**63) if r["doc_id"] is None else r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(fps):
        low[find(i)] = min(low.get(find(i), d), d)
    want = sorted((str(public(d)), f"{f:016x}", str(public(low[find(i)]))) for i, (d, f) in enumerate(fps))
    assert got(simhash.near_duplicates(docs, **how), "fingerprint", "component_id") == want


def test_gray_tree_finds_all_links():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 300).astype(np.uint64)
    near = np.concatenate([fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) for _ in range(4)])
    x = np.unique(np.concatenate((fps, near)))
    i, j = simhash.linked(x, 3, step=64 * 10)
    parent = np.arange(len(x))
    simhash._join(parent, *(np.stack((i, j))))
    full = np.arange(len(x))
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))
    simhash._join(full, a, b)
    assert (simhash._roots(parent) == simhash._roots(full)).sum() >= 0
    same = lambda p: {tuple(np.flatnonzero(p == r)) for r in np.unique(p)}
    assert same(simhash._roots(parent)) == same(simhash._roots(full))


def test_decontamination(spark, docs):
    items = [(1, " ".join(r["text"].split()[12:40])) for r in docs.where("doc_id = 101").collect()] + [(2, "Alpha, BETA gamma"), (3, None), (None, "alpha"), (4, ""), (5, "中文")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: decontaminate.words_of((t or "").encode())
    windows = [(i, words(t)[p : p + 10]) for i, t in items if i is not None and words(t) for p in range(max(1, len(words(t)) - 9))]
    want = {}
    for did, dig, text in keyed_rows(docs):
        w = words(text)
        hit, ids = np.zeros(len(w), bool), set()
        for i, win in windows:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit[p : p + len(win)] = True
                    ids.add(str(i))
        want[did, dig] = len(w), int(hit.sum()), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit.any())
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.find_contamination(docs, bench), *cols) == expected(docs, want)
    assert got(decontaminate.find_contamination(docs, bench, block_bytes=50), *cols) == expected(docs, want)
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns
    assert decontaminate.decontaminated(docs, bench).count() == sum(not want[r["did"], r["dig"]][4] for r in keyed(docs).collect())


def test_decontamination_offsets(spark):
    docs = spark.createDataFrame([(1, "é One,  TWO!\nthree 中 four")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "one two three")], "item_id long, text string")
    row = decontaminate.find_contamination(docs, bench).first()
    assert [("é One,  TWO!\nthree 中 four")[s["start"] : s["end"]] for s in row["spans"]] == ["One,  TWO!\nthree"]


def test_raking_meets_targets():
    cells = np.array([(a, b, c) for a in range(3) for b in range(2) for c in range(2)])
    weight = np.arange(1, 13, dtype=float)
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.25, 0.75])]
    out = mixing.rake(cells, weight, targets) * weight
    for axis, share in enumerate(targets):
        assert np.allclose(np.bincount(cells[:, axis], out) / out.sum(), share, atol=1e-6)


def test_mixing_by_tables_is_the_same(spark):
    rows_ = [(s, g, t, float(10 * len(s) + t)) for s in ("a", "bb", "ccc") for g in ("x", "y") for t in (0, 1)]
    cells = spark.createDataFrame(rows_, "source string, lang string, topic int, w double")
    near = lambda df: {(r["source"], r["lang"], r["topic"]): round(r["factor"], 4) for r in df.collect()}
    assert near(mixing.cell_rates(cells, 0.5, None, rounds=6)) == near(mixing.cell_rates(cells, 0.5, None, cap=1, rounds=6))


def skewed_cells(spark):
    """One source of a hundredth of the tokens, in a language and a topic of its own size."""
    rows_ = [("big", "x", 0, 60000.0), ("big", "y", 0, 20000.0), ("big", "x", 1, 9000.0), ("mid", "x", 0, 7000.0), ("mid", "y", 1, 3000.0), ("tiny", "z", 0, 600.0), ("tiny", "x", 1, 400.0), ("none", "x", 1, 0.0)]
    return spark.createDataFrame(rows_, "source string, lang string, topic int, w double")


def test_mixing_meets_all_targets(spark):
    """Expected tokens, weight times rate, have the target shares on every axis, small values too."""
    out = mixing.cell_rates(skewed_cells(spark), 0.5, None).toPandas()
    assert out["rate"].between(0, 1).all() and out.loc[out["w"] > 0, "rate"].max() == 1
    for axis in mixing.AXES:
        had, has = out["w"].groupby(out[axis]).sum(), (out["w"] * out["rate"]).groupby(out[axis]).sum()
        want = (had / had.sum()) ** 0.5
        assert np.allclose(has / has.sum(), want / want.sum(), atol=1e-6), axis


@pytest.mark.parametrize("cap", [mixing.CELLS, 1])
def test_mixing_to_incomplete_targets(spark, cap):
    """On both sizes: every cell stays, and values without a target keep their share."""
    targets = {"source": {"mid": 3, "tiny": 1, "absent": 9}, "lang": {"x": 0.5}}
    out = mixing.cell_rates(skewed_cells(spark), 1.0, targets, cap=cap).toPandas()
    assert len(out) == 8 and out["rate"].between(0, 1).all()
    has = (out["w"] * out["rate"]).groupby(out["source"]).sum()
    assert np.allclose((has / has.sum())[["big", "mid", "tiny", "none"]], [0.89, 0.0825, 0.0275, 0], atol=1e-6)
    # every other axis keeps its own shares
    has, had = ((out["w"] * x).groupby(out["lang"]).sum() for x in (out["rate"], 1))
    assert np.allclose(has / has.sum(), had / had.sum(), atol=1e-6)


def test_mixing_by_tables_has_the_same_rates(spark):
    targets = {"source": {"mid": 3, "tiny": 1, "absent": 9}, "topic": {1: 2, 7: 1}}
    a, b = (mixing.cell_rates(skewed_cells(spark), 0.5, targets, cap=cap, rounds=8).toPandas().sort_values(list(mixing.AXES)) for cap in (mixing.CELLS, 1))
    assert np.allclose(a["rate"], b["rate"], atol=1e-9) and np.allclose(a["factor"], b["factor"], atol=1e-9)


def test_topics_come_from_all_documents(spark):
    """A topic of five in 9,000 documents weighs in a centre, and neither order nor repeats of an id count."""
    texts = [f"aaa bbb ccc {i % 7}" for i in range(8995)] + [f"zzz yyy xxx www {i}" for i in range(5)]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    one = mixing.topic_centres(df.coalesce(1), "text")
    assert np.array_equal(one, mixing.topic_centres(df.orderBy(F.rand(1)).repartition(5), "text"))
    rare = mixing.trigram_shares(__import__("pyarrow").array(["zzz yyy xxx www"]))
    assert (rare @ one.T).max() > 0.5


def test_mixing(docs):
    each = mixing.mixed_documents(docs, keep=False)
    assert each.count() == docs.count() and each.where("rate < 0 or rate > 1").isEmpty()
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.count() == each.where("sampled").count()
    assert mixing.mixed_documents(docs.where("false")).isEmpty()


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, docs, tmp_path, encoding):
    from tokenizers import Tokenizer

    path, name = f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(docs, path, name, encoding=encoding, partitions=3, row_group_bytes=1 << 16, page_bytes=1 << 12)
    whole, start, want = Tokenizer.from_file(name), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, (r["text"] or "").encode())):
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((str(r["doc_id"]), str(start), str(len(ids)), str(zlib.crc32(np.array(ids, "<u4").tobytes()))))
        start += len(ids)
    assert got(token_files.read_digests(spark, path), "start", "n_tokens", "ids_crc32") == sorted(want)
    assert token_files.document_starts(spark, path).where("doc_id = 501").first()["start"] == max(int(w[1]) for w in want if w[0] == "501")


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(name), random.Random(4)
    letters = "abcXYZ éÉßÀ'.,!?$<|>09\t\n 　Σσς·ñ日_~́-\"ª×İŒ​\x7f\x00\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["<|endoftext|>", "a<|startoftext|>b", "don't IT'S we'll", ""]
    for t, ids in zip(texts, token_files.encode_texts(name, texts, 1), strict=True):
        assert whole.encode(t, add_special_tokens=False).ids + [1] == ids.tolist(), repr(t)


def held_out(spark, df, label):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    p = df.where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("y"), "score").toPandas()
    assert p["score"].between(0, 1).all()
    return p


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = held_out(spark, quality.quality_scores(docs, labels), "quality")
    assert (p["predicted"] == p["y"]).mean() > 0.93
    assert quality.accepted(docs, labels).columns == docs.columns


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = held_out(spark, toxicity.toxicity_scores(docs, labels), "toxic")
    assert (p["predicted"] == p["y"]).mean() > 0.9


def test_scores_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None)] + [(i, i % 2, i % 2) for i in range(4, 25)], "doc_id long, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert f(docs, labels).count() == docs.count()
        assert f(docs, labels).where("score is null or score < 0 or score > 1").isEmpty()
        assert f(docs.where("false"), labels).isEmpty()
        assert f(docs, labels.where("false")).count() == docs.count()


def test_isotonic():
    x, y = quality.pooled(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 0.0, 2.0, 1.0]), np.array([2.0, 2.0, 2.0, 1.0]))
    assert np.all(np.diff(y) >= 0) and np.allclose(y, [0.25, 1.0])


def test_folding_and_exceptions():
    assert toxicity.folded("1D10T, idіоt tr@sh! c4n") == ["idiot", "idiot", "trash", "can"]
    lex = toxicity.Lexicon({" trash ": 2.0, " idio": 3.0}, frozenset({" trash can "}), (0.0, 1.0, 1.0, 1.0))
    assert [m[2] for m in lex.matches("a trash can and trash idiots".split())] == [2.0, 3.0]


def test_long_items_are_cut_without_losing_windows():
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 50, 500):
        text = ", ".join(rng.choice(WORDS) + rng.choice(["", "é", "9"]) for _ in range(n))
        for block in (1, 60, 400, 1 << 20):
            parts = list(decontaminate.pieces(text, 4, block))
            assert decontaminate.windows_of([("i", text)], 4) == decontaminate.windows_of([("i", p) for p in parts], 4)
            assert max(map(len, parts)) <= max(block // 4 + 12, 60) or len(text) * 4 <= block


def test_automaton_of_a_whole_block_is_bounded():
    """A block as large as they get, of random words: under half a gigabyte."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(20_000)]
    items, size = [], 0
    while size <= decontaminate.BLOCK_BYTES:
        items.append((str(len(items)), " ".join(rng.choices(words, k=150))))
        size += len(items[-1][1]) * 10
    stats = decontaminate.automaton(decontaminate.windows_of(items, 10), -1).get_stats()
    decontaminate._built.clear()
    assert stats["total_size"] < 512 << 20


def test_offsets_of_spans_in_a_long_text():
    text = "é, über 中文 word! " * 20_000
    raw = text.encode()
    n = len(decontaminate.words_of(raw))
    lo = np.arange(0, n - 1, 2)
    got_ = decontaminate.original(raw, lo, lo + 1)
    assert all(text[a:b].lower().encode() == w for (a, b), w in zip(got_, decontaminate.words_of(raw)[::2], strict=False))


def test_single_lines_are_deduplicated(spark):
    """One-line copies, a single repeated line between differing neighbours, a run of two lines."""
    texts = ["only line", "only line", "a\nshared\nb", "c\n shared \nd", "p\nq\nr", "x\np\nq\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in line_dedup.dedup_lines(df, window=1).collect()}
    assert out == {0: (1, 0, "only line"), 1: (1, 1, ""), 2: (3, 0, texts[2]), 3: (3, 1, "c\nd"), 4: (3, 0, texts[4]), 5: (4, 2, "x\ny")}


def test_short_repeated_lines_stay(spark):
    """By default a run counts from 4 lines or 240 bytes on, extended to its ends on both sides."""
    long = "w" * 239
    texts = ["{\n}\nend", "x\n{\n}", f"a\n}}\n{long}\n}}\nb", f"c\n}}\n{long}\n}}\nd", f"{long}\ne", f"f\n1\n2\n3\n4\n5\n6", f"g\n1\n2\n3\n4\n5\n7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(df).collect()}
    assert out == dict(enumerate(texts)) | {3: "c\nd", 6: "g\n7"}


def plain_lines(docs, window, least):
    """Lines and kept text by brute force over all earlier runs of ``window`` lines, or fewer of ``least`` bytes,
    whoever holds them."""
    seen, out = set(), {}
    for did, dig, text in keyed_rows(docs):
        rows_, gone = text.split("\n"), set()
        solid = [i for i, x in enumerate(rows_) if x.strip(" \t\r\x0b\x0c")]
        clean = [rows_[i].strip(" \t\r\x0b\x0c") for i in solid]
        for p in range(len(solid)):
            for n in range(1, min(window, len(solid) - p) + 1):
                run = tuple(clean[p : p + n])
                if n == window or least is not None and len("".join(run).encode()) >= least:
                    if run in seen:
                        gone.update(solid[p : p + n])
                    seen.add(run)
        out[did, dig] = len(solid), len(gone), "\n".join(x for i, x in enumerate(rows_) if i not in gone)
    return out


@pytest.mark.parametrize("window,least", [(4, 240), (1, None), (2, None), (3, None), (6, None), (4, 1), (4, 3), (3, 4), (6, 5)])
def test_line_dedup_against_all_earlier_runs(spark, window, least):
    """Every run that any earlier document or place holds goes, whoever owns what, and nothing else."""
    rng = random.Random(8)
    docs = [(i, "\n".join(rng.choice(["a", "b", " c ", "dd", "", "e", "fff"]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    docs += [(100 + 10 * k + i, t) for k in range(8) for i, t in enumerate([f"h{k}\nt{k}", f"h{k}\nt{k}\nu{k}", f"h{k}\nt{k}\nu{k}"])]
    docs += [(300 + i, t) for i, t in enumerate(["x\ny\nq", "w\nx\ny\nq\nr\ns", "w\nx\ny\nq\nr\ns", "\n".join(map(str, range(300))), "\n".join(map(str, range(100, 400)))])]
    df = spark.createDataFrame([*docs, docs[3], (70, None), (None, "a\nb\nc\nd"), (3, "x\na\nb\n c "), (310, " a\r\n\nb \nc")], "doc_id long, text string")
    how = (window, least) if (window, least) != (4, 240) else ()  # the registered query takes the defaults
    assert got(line_dedup.dedup_lines(df, *how), "n_lines", "n_removed", "kept") == expected(df, plain_lines(df, window, least))


def test_hot_line_between_many_neighbours(spark):
    """A line that every document has, between neighbours of its own, and again with neighbours that some share."""
    docs = [(i, f"n{i}\n0 hot\nm{i}\nk{i % 7}\n0 hot\nk{i % 5}\nk{i % 3}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert got(line_dedup.dedup_lines(df, 3, None), "n_lines", "n_removed", "kept") == expected(df, plain_lines(df, 3, None))


def test_lines_of_odd_tables(docs):
    """Clashing columns, nulls, repeated rows, a very long text."""
    for how in ((4, 240), (1, None)):
        assert got(line_dedup.dedup_lines(docs, *how), "n_lines", "n_removed", "kept") == expected(docs, plain_lines(docs, *how))


def test_winnowing_selects_window_minima():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h, sizes = (rng.integers(lo, 6, rng.integers(1, 30)) for lo in (0, 1))
        sizes = sizes[: len(h)] if len(sizes) >= len(h) else np.resize(sizes, len(h))
        for window, least in ((1, None), (2, None), (5, None), (4, 1), (4, 7)):
            start, end = line_dedup.windows_of(sizes, window, least)
            counts = lambda a, b: b - a == window or least is not None and b - a < window and sizes[a:b].sum() >= least  # noqa: B023, E731
            runs = [(a, b) for a in range(len(h)) for b in range(a + 1, min(a + window, len(h)) + 1) if counts(a, b)]
            shortest = {(a, min(b for x, b in runs if x == a)) for a, _ in runs} | {(max(a for a, x in runs if x == b), b) for _, b in runs}
            assert set(zip(start.tolist(), end.tolist(), strict=True)) == shortest
            if len(start):
                at = line_dedup.selected(h, start, end)
                assert [(h[i], i) for i in at] == [min(((h[i], i) for i in range(a, b)), key=lambda x: (x[0], -x[1])) for a, b in zip(start, end, strict=True)]
                lo, hi = line_dedup.spans(line_dedup.window_code(start, end, window), window)
                assert (lo == start).all() and (hi == end).all()
                lo, hi = line_dedup.spans(line_dedup.seed_code(at, start, end, window), window)
                assert (lo == start).all() and (hi == end).all()


def test_fewer_positions_than_lines(spark):
    """What is shuffled are selected positions: about a third of the lines by lines alone, and three quarters with windows of
    240 bytes, which are often one line."""
    own = keyed(spark.read.parquet(f"{SF}/documents.parquet"))
    lines = sum(len(line_dedup.lines_of(r["text"].encode())) for r in own.collect())
    assert line_dedup.selected_positions(own, 4, None).count() < 0.5 * lines
    assert line_dedup.selected_positions(own, 4, 240).count() < 0.8 * lines


def test_exact_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n long").write.parquet(f"file://{tmp_path}/d")
    assert exact_dedup.dedup_exact(spark, f"file://{tmp_path}/d").isEmpty()


def test_bitmap_lets_all_keys_pass(spark):
    keys, other = (spark.range(a, b).select(F.sha1(F.col("id").cast("string")).alias("k")) for a, b in ((0, 3000), (3000, 9000)))
    assert exact_dedup.may_be_in(keys, keys, "k").count() == 3000
    assert exact_dedup.may_be_in(other, keys, "k").count() < 600
    assert exact_dedup.may_be_in(other, keys.where("false"), "k").isEmpty()


def test_batches_are_bounded_by_bytes(spark):
    """Texts of a megabyte reach Python a few at a time, whatever the number of rows."""
    import pyarrow as pa

    from factweave.llm.common import text_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    big = text_batches(spark).range(0, 40, 1, 1).select(F.repeat(F.lit("x"), F.lit(1 << 20)).alias("text"))
    got = big.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 40 and max(r["rows"] for r in got) <= 5


def test_empty_tables(spark, docs):
    none, bench = docs.where("false"), spark.createDataFrame([], "item_id long, text string")
    for df in (suffix_dedup.dedup_substrings(none), superkmer_dedup.dedup_word_windows(none), simhash.near_duplicates(none), line_dedup.dedup_lines(none), decontaminate.find_contamination(none, bench), decontaminate.find_contamination(docs, bench).where("contaminated")):
        assert df.isEmpty()


def test_packed_records_round_trip():
    n = 50
    size = np.random.default_rng(1).integers(0, 9, n).astype(np.int32)
    rec = packed.Records(*(np.arange(n, dtype=np.int64) for _ in range(3)), np.ones(n, np.int32), np.zeros(n, np.int32), size, np.arange(size.sum(), dtype=np.uint8))
    back = packed.Records.unpack(rec.take(np.arange(n)[::-1]).pack())
    assert back.did.tolist() == list(range(n))[::-1] and back.data.tobytes() == b"".join(rec.data[a : a + k].tobytes() for a, k in list(zip(rec.start, rec.size, strict=True))[::-1])


def test_minimiser_runs_cover_all_windows():
    x = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64)
    grams, ok = rolled(x, 4), np.ones(500 - 19, bool)
    ok[200:219] = False
    first, size, pos = minimiser_runs(grams, 17, ok)
    assert sorted(ragged(first, size).tolist()) == np.flatnonzero(ok).tolist()
    assert all(f + s - 1 <= p <= f + 16 for f, s, p in zip(first, size, pos, strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF).toPandas()
    assert len(frame) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in ORACLE_SQL:
        columns, want = oracle_rows(ORACLE_SQL[name], SF)
        assert sorted(frame.columns) == columns and rows(frame) == want


@pytest.mark.parametrize("cap", [mixing.CELLS, 1])
def test_mixing_with_absent_and_zero_targets(spark, cap):
    """One meaning on both sizes: absent keeps its share, zero keeps nothing."""
    cells = spark.createDataFrame([("a", "x", 0, 50.0), ("b", "x", 0, 40.0), ("c", "x", 0, 10.0), ("d", "x", 0, 20.0)], "source string, lang string, topic int, w double")
    share = lambda targets: {r["source"]: r["w"] * r["rate"] for r in mixing.cell_rates(cells, 1.0, {"source": targets}, cap=cap).collect()}
    kept = share({"a": 0.5, "b": 0.5, "d": 0})
    total = sum(kept.values())
    assert np.allclose([kept[k] / total for k in "abcd"], [(1 - 10 / 120) / 2, (1 - 10 / 120) / 2, 10 / 120, 0], atol=1e-9)
    none = share({"a": 0, "b": 0})
    assert none["a"] == none["b"] == 0 and np.isclose(none["c"] / none["d"], 0.5)
    assert set(share(dict.fromkeys("abcd", 0)).values()) == {0.0}


def test_mixing_paths_agree_on_random_tables(spark):
    rng = np.random.default_rng(6)
    for _ in range(2):
        rows_ = [(f"s{i}", f"g{j}", k, float(rng.integers(0, 1000) * rng.integers(0, 2))) for i in range(4) for j in range(3) for k in range(2)]
        cells = spark.createDataFrame(rows_, "source string, lang string, topic int, w double")
        targets = {"source": {"s0": float(rng.random()), "s2": 0.0, "gone": 3.0}, "topic": {1: 2.0}}
        a, b = (mixing.cell_rates(cells, 0.7, targets, cap=cap, rounds=5).toPandas().sort_values(list(mixing.AXES)) for cap in (mixing.CELLS, 1))
        assert np.allclose(a["rate"], b["rate"], atol=1e-9) and np.allclose(a["factor"], b["factor"], atol=1e-9)


def test_rare_values_do_not_set_the_price():
    """A value of a ten-thousandth of the tokens is tempered with its like."""
    total = np.array([60000.0, 39000.0, 900.0, 90.0, 10.0])
    share = mixing.axis_shares(total, list("abcde"), 0.5, None, least=0.01)
    assert np.isclose(share.sum(), 1) and np.allclose(share[2:] / share[2:].sum(), [0.9, 0.09, 0.01])
    assert np.isclose(share[2:].sum() / share[0], (0.01**0.5) / (0.6**0.5))


def brute_mixing(docs, temper, least=0.0, spread=None):
    """Rates of all documents by plain raking of a dictionary, to the rules of the module's head."""
    cell_of = [(r["source"], r["lang"], r["topic"]) for r in docs]
    w = {}
    for c, r in zip(cell_of, docs, strict=True):
        w[c] = w.get(c, 0) + r["n_tokens"]
    whole, factor = sum(w.values()), dict.fromkeys(w, 1.0)
    targets, owns = [], []
    for axis in range(3):
        own = {}
        for c, t in w.items():
            own[c[axis]] = own.get(c[axis], 0) + t / whole
        rare = sum(v for v in own.values() if v < least)
        want = {k: v**temper if v >= least else v / rare * rare**temper if rare else 0.0 for k, v in own.items()}
        targets.append({k: v / sum(want.values()) for k, v in want.items()})
        owns.append(own)
    lift = lambda axis, c: targets[axis][c[axis]] / owns[axis][c[axis]] if owns[axis][c[axis]] else 1.0
    for _ in range(50):
        for axis in range(3):
            now = {}
            for c, t in w.items():
                now[c[axis]] = now.get(c[axis], 0) + t * factor[c]
            factor = {c: f * targets[axis][c[axis]] * whole / now[c[axis]] if now[c[axis]] else f for c, f in factor.items()}
        if spread:
            factor = {c: min(f, spread * lift(0, c) * lift(1, c) * lift(2, c)) for c, f in factor.items()}
    top = max(f for c, f in factor.items() if w[c])
    return [min(1.0, factor[c] / top) for c in cell_of], targets


@pytest.mark.parametrize("how", [{}, {"least": 0.01, "spread": 1.25}])
def test_mixing_against_brute_force(spark, how):
    """On whole tables: the words, the rates, the draws, and how near the drawn tokens come to the targets."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    each = mixing.mixed_documents(frame, keep=False, **how).collect()
    texts = {r["doc_id"]: (r["text"] or "", r["source"], r["lang"]) for r in frame.collect()}
    assert all((len(texts[r["doc_id"]][0].encode().split()), *texts[r["doc_id"]][1:]) == (r["n_tokens"], r["source"], r["lang"]) for r in each)
    rates, targets = brute_mixing(each, 0.95, **how)
    assert np.allclose([r["rate"] for r in each], rates, atol=1e-6)
    for axis, name in enumerate(mixing.AXES):
        drawn, due = {}, {}
        for r in each:
            due[r[name]] = due.get(r[name], 0) + r["n_tokens"] * r["rate"]
            drawn[r[name]] = drawn.get(r[name], 0) + r["n_tokens"] * r["sampled"]
        for k, share in targets[axis].items():
            assert abs(due[k] / sum(due.values()) - share) < 0.005, (name, k)
            assert abs(drawn[k] / sum(drawn.values()) - share) < 0.06, (name, k)
    kept = {r["doc_id"] for r in mixing.mixed_documents(frame, **how).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in each if r["sampled"]} and len(kept) > 0.2 * len(each)


def test_mixing_reports_missed_targets(spark):
    """Targets that contradict each other: the report says by how much, and raking still ends."""
    cells = spark.createDataFrame([("a", "x", 0, 70.0), ("b", "y", 0, 30.0)], "source string, lang string, topic int, w double")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.1}}
    rates = mixing.cell_rates(cells, 1.0, targets)
    report = {(r["axis"], r["value"]): (r["target"], r["expected"]) for r in mixing.achieved(rates, 1.0, targets).collect()}
    assert np.allclose(report["lang", "x"], (0.9, 0.9)) and np.allclose(report["source", "a"], (0.5, 0.9))
    fine = mixing.cell_rates(skewed_cells(spark), 0.5, None)
    assert all(abs(r["target"] - r["expected"]) < 1e-6 for r in mixing.achieved(fine, 0.5).collect())


def test_exact_with_a_column_named_metadata(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x"), (2, "A", "y")], "doc_id long, text string, _metadata string").write.parquet(f"{tmp_path}/d")
    assert got(exact_dedup.dedup_exact(spark, f"file://{tmp_path}/d"), "keep_id") == [("1", "2"), ("2", "2")]
