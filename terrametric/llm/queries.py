"""The corpus operators as queries with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, line_dedup, metric_join, mixing, packing, pii, quality, sharding, simhash, token_files
from .common import documents


#: A deployment sets its own secret; this one makes the query's results repeatable.
SURROGATE_KEY = b"terrametric-surrogates"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), temperature=0.5, seed=42)


def op3_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.roundtrip_digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(documents(spark, sf_dir), SURROGATE_KEY).select("doc_id", "text", "spans")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), radius=3, words_a_shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print.w0"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).select("doc_id", *quality.STATISTICS, "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(documents(spark, sf_dir), shards=16)
    text_crc32 = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", "size", text_crc32.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated_lines(documents(spark, sf_dir)).select("doc_id", "text", "removed_lines")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_best_fit_packing, op2_mixing, op3_metric_join, op4_token_files, op5_pii_surrogates, op6_simhash, op7_quality, op8_language_id, op9_sharding, op10_line_dedup)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL}
