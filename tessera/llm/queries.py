"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip
from .common import table
from .compaction import compacted_clicks
from .decontam import contamination_digest
from .licenses import license_digest
from .neardup import near_duplicates
from .pii import pii_digest
from .quality import quality_digest
from .repeats import passage_digest
from .secret_scan import secret_digest
from .spelling import spelling_variants
from .token_counts import token_count_rollup
from .token_files import token_file_digest
from .toxicity import toxicity_digest


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count_rollup(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted_clicks(table(spark, sf_dir, "clicks"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_byte_bpe, op2_token_counts, op3_token_files, op4_toxicity, op5_decontamination, op6_quality_rules,
        op7_personal_data, op8_licenses, op9_secrets, op10_near_duplicates, op11_spelling_variants, op12_compaction, op13_repeated_passages,
    ]
    return {f.__name__: f for f in made}
