"""A training corpus from raw documents: quality rules, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadpulse.llm import jaccard, mixing, packing, quality, secrets
from threadpulse.llm.common import shared_dir, table
from threadpulse.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Each row is judged by its own text and language, also where ids repeat or are null; null and empty texts go, an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id; of different texts under one id each is a document of its own, and rows with a null id all stay."""
    return jaccard.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; null texts, repeated rows and other columns stay as they are."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times). Null sources are one source; texts without words are taken 0 or 1 times, at their source's rate; rows that are alike count together."""
    return mixing.repeat_by_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences. A null text is one piece with the end id; repeated rows are packed each on its own."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_stage), ("ngram_jaccard_join", near_duplicate_stage), ("secret_scan", secret_stage), ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage)]

#: Trained cutoffs, MinHash classes, hash draws and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
