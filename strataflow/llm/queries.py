"""Queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import ORACLE as CONTAMINATION
from .jaccard import ORACLE as JACCARD
from .lines import ORACLE as LINES


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files lie; the package that holds them is installed beside Spark."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_corpus import corpus_digest

    return corpus_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import labelled_table, pii_digest

    return pii_digest(table(spark, sf_dir, "documents"), labelled_table(spark))


def op3_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import labelled_findings, scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"), labelled_findings(spark))


def op4_induced_suffix_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats_digest

    return repeats_digest(table(spark, sf_dir, "documents"))


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files_digest

    return token_files_digest(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_digest

    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_three_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup_query

    return line_dedup_query(table(spark, sf_dir, "documents"))


def op10_t_occurrence_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cross_entropy_difference,
        op2_crf_personal_data,
        op3_forest_secret_scan,
        op4_induced_suffix_sorting,
        op5_wu_manber_decontamination,
        op6_repair_token_files,
        op7_risk_controlled_quality,
        op8_byte_level_bpe,
        op9_three_line_windows,
        op10_t_occurrence_jaccard,
    )
}

ORACLES: dict[str, str] = {"op5_wu_manber_decontamination": CONTAMINATION, "op9_three_line_windows": LINES, "op10_t_occurrence_jaccard": JACCARD}
