"""The corpus pipeline: documents go through five operators, one after the other.

Each stage works on all that its predecessor kept, and all but the last return the columns of
``documents``. Rows that occur twice are decided alike, but near-dedup keeps one of them; rows that share
an id, or have none, are told apart by their texts. Nulls are as the operators define them.

The product are the token files. They stay, in a folder that the caller of ``run`` names or finds in column
``token_files`` of the result; what stages write besides goes with the run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import drop, scratch, scratch_run, shared_dir, text_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    from factweave.llm.quality import accepted

    return accepted(docs, text_batches(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest id, then text hash."""
    from factweave.llm.simhash import one_of_each

    text_batches(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    from factweave.llm.decontaminate import decontaminated

    return decontaminated(docs, text_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities. Here rare values are tempered as one and factors
    are bounded: targets in the last points of a share aren't worth most of the documents."""
    from factweave.llm.mixing import mixed_documents

    text_batches(spark)
    return mixed_documents(docs, least=0.01, spread=1.25)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Documents become token files at ``path``; a row for each document, as read back from them."""
    import public_tokenizers

    from factweave.llm.token_files import read_digests, write_tokens

    path = path or f"{shared_dir(text_batches(spark))}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_digests(spark, path).withColumn("token_files", F.lit(path))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing to target weights", mixing), ("token files", tokens)]
#: The stages learn models and link fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, token_files: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage
    left there besides, and the stage before, go when it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch_run() as written:
            out = stage(spark, docs, sf_dir, token_files) if stage is tokens else stage(spark, docs, sf_dir)
            schema = out.schema
            out.write.parquet(path := scratch(spark, name.replace(" ", "-")))
        docs = spark.read.schema(schema).parquet(path)
        drop(spark, *before, *(p for p in written if p != path))
        before = [path]
    return docs
