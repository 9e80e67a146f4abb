"""From raw documents to a token set for shuffled reads; each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.decontaminate import search
from tickframe.llm.mixing import resample
from tickframe.llm.near_dup import near_duplicates
from tickframe.llm.quality import judged
from tickframe.llm.store import Run, column, delete
from tickframe.llm.token_records import write_index, write_records
from tickframe.session import scratch_path, shared_root

#: BPE with word ends; the pipeline's name for it, resolved by the installed vocabulary package.
TOKENIZER = "word_bpe_49k.json"
#: The token ids of the last stage have no SQL form; tests compare every stage with brute force.
ORACLE_SQL = None
_NO_ID = (1 << 63) - 1
#: The tables of the last stage that ran over an input folder; the next one removes them, since that stage's result is written by then.
_LAST: dict[str, Run] = {}


def _stage(spark: SparkSession, sf_dir: str) -> Run:
    """The tables of this stage, with those of the one before removed; other queries keep theirs."""
    run = _LAST.setdefault(sf_dir, Run())
    run.release(spark)
    return run


def _row(docs: DataFrame) -> Column:
    return F.struct(*[column(c) for c in docs.columns]).alias("row")


def _named(docs: DataFrame) -> DataFrame:
    """Each row whole, with the names (k, h) under which verdicts are joined to it: id and hash of the text."""
    return docs.select(_row(docs), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("k"),
                       F.xxhash64(F.col("text").cast("string")).alias("h"))


def _names(verdict: DataFrame) -> DataFrame:
    return verdict.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("k"), F.col("text_hash").alias("h")).distinct()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; rows without words, null texts among them, go."""
    with _stage(spark, sf_dir):
        kept = _names(judged(docs).where("kept"))
    return _named(docs).join(kept, ["k", "h"], "left_semi").select("row.*")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; of equal rows one stays."""
    with _stage(spark, sf_dir):
        chosen = _names(near_duplicates(docs).where("chosen"))
    one = _named(docs).join(chosen, ["k", "h"], "left_semi")
    return one.dropDuplicates(["k", "h"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item in their text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       _row(docs))
    with _stage(spark, sf_dir):
        return search(base, benchmark).where(F.col("lcs") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    with _stage(spark, sf_dir):
        return resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The offset index of the record files, which stay in the shared folder."""
    import public_tokenizers
    _stage(spark, sf_dir)
    path = f"{shared_root(spark)}/corpus-tokens-{uuid.uuid4().hex}"  # the pipeline's product: it stays
    write_records(docs, path, public_tokenizers.path(TOKENIZER))
    return write_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality", quality), ("near_dup", near_dup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    out = STAGES[-1][1](spark, docs, sf_dir)
    delete(spark, before)
    return out
