"""From raw documents to packed training sequences: each stage works on all rows that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import jaccard_join, langid, mixing, packing, secrets_scan
from noteloom.llm.base import keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of which fewer n-grams than this belong to any learned language is in none of them.
LEAST_COVERAGE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text, without letters, or in no learned language; fills in a missing lang."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.fit(docs), keep_columns=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("coverage") >= LEAST_COVERAGE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays."""
    return jaccard_join.without_near_copies(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows where the text has changed. Every document stays."""
    text, mark = F.col("text"), "[REDACTED]"
    old = docs.select(*COLUMNS).withColumn("__old", text)
    new = secrets_scan.redact(old, mark=mark)
    return new.withColumn("n_chars", F.when(text.eqNullSafe(F.col("__old")), F.col("n_chars")).otherwise(F.length(text).cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; a document that the mix repeats has the pieces of each repeat."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: Classifier and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
