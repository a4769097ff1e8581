"""The operators as queries over whole tables, and the SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe, imatch, jaccard, language, matroska, mixing, secrets, sharding, suffix, warc
from tesserae.llm.sql import ORACLES


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_imatch": lambda s, d: imatch.fingerprint_table(_read(s, d, "documents")),
    "op2_secrets": lambda s, d: secrets.secret_table(_read(s, d, "documents")),
    "op3_warc": lambda s, d: warc.page_table(_read(s, d, "pages")),
    "op4_bpe": lambda s, d: bpe.token_table(_read(s, d, "documents")),
    "op5_hilbert": lambda s, d: sharding.shard_documents(_read(s, d, "documents")),
    "op6_matroska": lambda s, d: matroska.media_table(_read(s, d, "documents")),
    "op7_language": lambda s, d: language.language_table(_read(s, d, "documents")),
    "op8_suffix": lambda s, d: suffix.dedup_table(_read(s, d, "documents")),
    "op9_jaccard": lambda s, d: jaccard.link_table(_read(s, d, "documents")),
    "op10_mixing": lambda s, d: mixing.mixture_table(_read(s, d, "documents")),
    "pipeline": _pipeline,
}

__all__ = ["ORACLES", "QUERIES"]
