"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.llm.collocations import collocations
from lamellar.llm.decontamination import decontaminate
from lamellar.llm.jaccard_join import jaccard_join
from lamellar.llm.language_id import language_id
from lamellar.llm.license_scan import license_scan
from lamellar.llm.lm_scoring import lm_scoring
from lamellar.llm.packing import pack
from lamellar.llm.quality_rules import quality_rules
from lamellar.llm.secret_scan import scan_documents
from lamellar.llm.spelling import spelling_variants
from lamellar.llm.statements import statements
from lamellar.llm.token_counts import token_counts
from lamellar.llm.token_files import token_files
from lamellar.llm.url_filter import url_filter
from lamellar.sources.storage import read_table

#: Rules of the registered URL filter.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("key")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents")).drop("key", "stays")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted: labelled of quality 1 and not toxic."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.expr("quality = 1 and toxic = 0").alias("wanted"))
    return lm_scoring(read_table(spark, sf_dir, "documents"), labels)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the same number; it is bad if of quality 0 or toxic."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 or toxic = 1").alias("bad"))
    return url_filter(read_table(spark, sf_dir, "pages"), labels, URL_RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark, read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_token_files": op2_token_files,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_quality_rules": op4_quality_rules,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_url_filter": op7_url_filter,
        "op8_language_id": op8_language_id,
        "op9_secret_scan": op9_secret_scan,
        "op10_token_counts": op10_token_counts,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_collocations": op12_collocations,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return statements(URL_RULES)
