"""Documents through five stages; what each keeps or changes is what the next one gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, jaccard, language, mixing, secrets
from tesserae.llm.shared import release, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model: language.Model | None = None) -> DataFrame:
    """Texts in none of the learned languages go, and a null lang becomes the predicted one.

    Rejected are null and empty texts, those without a letter, and those whose n-grams are no more likely in their best
    language than by chance. Where nothing was learned, only the former go. Ties: the first language by name. Repeated
    rows and very long texts: each judged whole, for itself. Empty tables: empty results. Columns: as they are.
    """
    model = model or language.fit(docs)
    judged = language.identify(docs, model)
    pred, _, evidence = (F.col(f"`{c}`") for c in judged.columns[-3:])
    kept = judged.where((pred != "und") & (evidence > 0) if model.languages else F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    if "lang" in docs.columns and model.languages:
        kept = kept.withColumn("lang", F.coalesce(F.col("lang"), pred))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id. Null, empty and blank texts, ties,
    repeated rows, very long texts, empty tables and clashing names: as `jaccard.keep_one` says."""
    return jaccard.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay. Odd rows and clashing names: as `secrets.redact` says."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources are repeated, at most twice, as the tempered weights ask for. Repeats
    stand side by side. Odd rows and clashing names: as `mixing.mix` says."""
    return mixing.mix(docs, max_repeats=2.0, slots=False)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of ids and decoded texts; repeats that stand side by side are encoded once. Odd rows: as
    `bpe.encode` says."""
    return bpe.token_table(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("temperature_mixing", mixing_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, the one before it deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = table(out, name)
        if before is not None:
            release(before)
        before = docs
    return docs


#: Language ID and BPE have no SQL; tests hold the result against a plain Python version.
ORACLE_SQL = None
