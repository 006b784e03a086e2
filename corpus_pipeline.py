"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.llm import decontamination as decontaminate_op
from lamellar.llm import jaccard_join as jaccard
from lamellar.llm import language_id as language
from lamellar.llm import packing, secret_scan
from lamellar.sources.storage import drop, materialise, read_table

#: (doc_id, key) pairs up to this many, 24 bytes each, are broadcast; beyond, documents are shuffled.
MOST_BROADCAST = 1_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as one column, beside id and hash of text, so that no name of theirs clashes."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def _without(rows: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``_keyed`` whose id and hash of text aren't in ``gone``; null ids are equal."""
    gone = materialise(gone.select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key")).distinct(), "gone")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return rows.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("hash") == F.col("g_key")), how)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from this stage's labelled documents, rejects.

    Null texts and texts without a letter go; repeated rows stay or go together; other columns stay as
    they are. An empty table gives an empty result.
    """
    return language.accepted(docs, language.learn(docs))


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked with each other, the one with the least id stays; of repeated rows, one.

    A document without words is linked with nothing and stays, its repetitions too. A row with a null id
    stays only if no linked one has an id. An empty table gives an empty result.
    """
    rows = jaccard.jaccard_join(docs).groupBy("doc_id", "key").agg(F.count_if("stays").alias("stay"), F.count("*").alias("copies"))
    rows = materialise(rows, "stays")
    kept = _without(_keyed(docs), rows.filter("stay = 0"))
    repeated = rows.filter("stay > 0 and stay < copies")  # rows with one id and text: one of them stays
    if not repeated.isEmpty():
        kept = _without(kept, repeated).unionByName(_without(kept, repeated, "left_semi").dropDuplicates(["id", "hash"]))
    return kept.select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, however few.

    Null and empty texts hold none and stay; repeated rows stay or go together; other columns stay
    as they are. An empty table of documents gives an empty result, and with no items all stay.
    """
    found = decontaminate_op.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(_keyed(docs), found.filter("contaminated")).select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; the models are learned from this stage's documents.

    Every row stays. ``n_chars`` is counted anew, and stays as it is for a null text. An empty table
    gives an empty result.
    """
    model = secret_scan.fit(secret_scan.labelled_samples(docs))
    clean = secret_scan.redact(docs, model)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places what is left in sequences of 2048 tokens; a null text is its end id alone, a long one several pieces.

    An empty table gives an empty result.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_a_group),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: Tokenizers and learned models can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each but the last returns is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        was, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        drop(was)
    return STAGES[-1][1](spark, docs, sf_dir)
