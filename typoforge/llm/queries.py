"""The queries of the corpus operators: each runs over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .base import documents
from .byte_bpe import bpe_digest
from .decontaminate import leak_digest
from .lm_scoring import score
from .near_dedup import near_digest
from .pii import pii_digest
from .quality import quality_digest
from .search import search
from .spelling import DRAW, spelling_variants
from .subwords import pieces_digest
from .substring_dedup import remove_repeated_words
from .suffix_dedup import remove_repeats
from .token_counts import count_digest
from .token_file import ids_digest


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_digest(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_digest(documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_digest(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(documents(spark, sf_dir))


def op10_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(documents(spark, sf_dir))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), draw=DRAW)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_substring_dedup, op3_token_counts, op4_decontaminate, op5_lm_scoring, op6_token_file, op7_near_dedup, op8_pii, op9_quality, op10_subwords, op11_byte_bpe, op12_spelling_variants, op13_lexical_search)}
ORACLES = {"op2_substring_dedup": oracles.SUBSTRING_DEDUP, "op4_decontaminate": oracles.DECONTAMINATE, "op7_near_dedup": oracles.NEAR_DEDUP, "op13_lexical_search": oracles.LEXICAL_SEARCH}
