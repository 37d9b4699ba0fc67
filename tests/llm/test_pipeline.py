"""The pipeline's stages, each on what the one before kept."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import common, decontaminate, simhash, token_files

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for (name, stage), columns in zip(corpus_pipeline.STAGES, [docs.columns] * 4 + [["doc_id", "start", "n_tokens", "ids_crc32", "token_files"]], strict=True):
        after = stage(spark, before, SF).cache()
        assert after.columns == columns
        kept, had = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (after, before))
        assert kept <= had and kept
        if name.startswith("SimHash"):
            groups = simhash.near_duplicates(before).collect()
            assert kept == {r["component_id"] for r in groups}
        if "decontamination" in name:
            bad = {r["doc_id"] for r in decontaminate.find_contamination(before, bench).where("contaminated").collect()}
            assert kept == had - bad
        if name.startswith("token"):
            assert kept == had
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()


def test_run_keeps_its_token_files(spark, tmp_path, monkeypatch):
    """The ids are there after the run, in the folder asked for, and nothing else of the run."""
    (tmp_path / "shared").mkdir()
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    mine = common.stored(spark.range(3), "mine")  # of somebody else
    out = corpus_pipeline.run(spark, SF, f"file://{tmp_path}/ids")
    crc = {r["doc_id"]: r["ids_crc32"] for r in out.collect()}
    ids = token_files.read_tokens(spark, f"file://{tmp_path}/ids").collect()
    assert {r["doc_id"]: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["tokens"])) for r in ids} == crc and crc
    assert mine.count() == 3 and sorted(x.name.rpartition("-")[0] for x in (tmp_path / "shared").iterdir()) == ["mine", "token-files"]
    named = corpus_pipeline.run(spark, SF).select("token_files").distinct().collect()
    assert len(named) == 1 and token_files.read_tokens(spark, named[0][0]).count() == len(crc)


def test_near_dedup_keeps_a_row_of_each_group(spark):
    """Rows without an id, and namesakes with other texts, replace only their own near-duplicates."""
    say = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(None, say(1)), (None, say(2)), (1, say(3)), (1, say(4)), (2, say(3)), (2, say(5)), (3, say(6)), (3, say(6)), (4, say(6).upper())]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(None, say(1)), (None, say(2)), (1, say(3)), (1, say(4)), (2, say(5)), (3, say(6))]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))


def odd_tables(spark, tmp_path, empty=False):
    """Documents with nulls in any column, ties, repeated rows, empty and long texts, and columns named
    like those that operators make; labels and a benchmark to go with them."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    more = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, "", None, None, None), (1, None, "en", None, 3), (1, "other text under the id of another", None, "s", None), (7, "long text " * 40_000, "en", "s", None)]
    odd = spark.createDataFrame(rows, more)
    cols = [c for c in base.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]
    docs = base.select(*cols).unionByName(base.limit(5).select(*cols)).unionByName(odd.select(*(odd[c].cast(base.schema[c].dataType) for c in cols)))
    clash = {c: F.lit(n) for n, c in enumerate(("did", "dig", "topic", "rate", "tokens", "score", "part", "fp", "component", "words"))}
    docs = docs.withColumns(clash)
    docs = docs.where("false") if empty else docs
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("false" if empty else "true")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_odd_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path)).cache()
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        assert after.exceptAll(docs).isEmpty(), name  # rows come through as they were
        docs = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, empty=True)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).isEmpty()
