"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import ORACLE as CHAT_SQL
from .chat import format_chats, read_back, replayed
from .decontaminate import contaminated
from .licences import ORACLE as LICENCE_SQL
from .licences import licences
from .line_templates import drop_templates
from .lm_score import backoff_scores
from .merkle import ORACLE as MERKLE_SQL
from .merkle import folded, manifest, proof_hash
from .mixing import ORACLE as MIXING_SQL
from .mixing import mixture
from .near_dup import near_duplicates
from .quality import judged
from .runs import find_runs, planted
from .store import Store
from .token_records import write_index, write_records
from .toxicity import toxic_passages
from .url_filter import judge_urls


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return judged(_table(spark, sf, "documents")).drop("text_hash")


def op4_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_records(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    path = Store(spark, "records").path("tokens")
    write_records(_table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return write_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences(_table(spark, sf, "documents"))


def op6_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    return drop_templates(_table(spark, sf, "documents"), long_texts=2, copies=True)


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op8_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return backoff_scores(_table(spark, sf, "documents"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    scored = toxic_passages(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(_table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = find_runs(planted(_table(spark, sf, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("best", best).withColumn("lines", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
                        (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
                        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_chat(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    parts = Store(spark, "chat-parts").keep(format_chats(replayed(rows)), "parts")
    return read_back(parts)


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    proven = manifest(docs, now={"text": F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    return proven.select("doc_id", "leaf", "subroot", "root", proof_hash().alias("proof_sha256"), folded().alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_records": op2_token_records,
    "op3_quality": op3_quality,
    "op4_near_dup": op4_near_dup,
    "op5_licences": op5_licences,
    "op6_line_templates": op6_line_templates,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat": op12_chat,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {
    "op1_mixing": MIXING_SQL,
    "op5_licences": LICENCE_SQL,
    "op12_chat": CHAT_SQL,
    "op13_merkle": MERKLE_SQL,
}
