"""The queries op1 to op13, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, binary, chaining, fingerprints, html_extract, jaccard, merkle, mixing, packing, quality, secrets, suffixes, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    labels = lambda s, d: table(s, d, "labels")
    return {
        "op1_secret_scan": lambda s, d: secrets.scan_secrets(docs(s, d)),
        "op2_quality_rules": lambda s, d: quality.quality_rules(docs(s, d), labels(s, d)),
        "op3_fingerprints": lambda s, d: fingerprints.fingerprint_documents(docs(s, d)),
        "op4_html_extraction": lambda s, d: html_extract.extract_articles(table(s, d, "pages")),
        "op5_ngram_jaccard_join": lambda s, d: jaccard.near_duplicates(docs(s, d)),
        "op6_best_fit_packing": lambda s, d: packing.pack_documents(docs(s, d), tokenizer_path()),
        "op7_toxicity": lambda s, d: toxicity.score_toxicity(docs(s, d), labels(s, d)),
        "op8_source_mixing": lambda s, d: mixing.mix_documents(docs(s, d)),
        "op9_token_files": lambda s, d: binary.token_files(docs(s, d), tokenizer_path()),
        "op10_substring_dedup": lambda s, d: chaining.repeated_passages(docs(s, d)),
        "op11_tokenizer_alignment": lambda s, d: alignment.align_tokenizers(docs(s, d), tokenizer_path(), piece_model_path()),
        "op12_merkle_manifest": lambda s, d: merkle.verify_manifest(docs(s, d)),
        "op13_suffix_dedup": lambda s, d: suffixes.remove_repeats(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """Of the manifest; the other results can't be written in DuckDB SQL (lexing, trained cutoffs and models, sketches, hash draws, tokenizers, suffixes of whole texts), and tests/llm compares them with brute force."""
    return {"op12_merkle_manifest": merkle.manifest_sql()}
