"""The corpus pipeline: language ID, n-gram Jaccard join, secret scans, best-fit packing.

Each stage works on all rows that the one before kept, and its result is written to the shared folder and read again.
A stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Nulls in any column are kept as
they are; an empty table goes through every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, ngram_join, packing, secret_scan
from tessera.llm.common import documents, shared_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A code of this many bits a byte is as long as the text itself: no learned language explains it.
UNEXPLAINED = 8.0
#: Texts of fewer bytes are not judged by their code length: there a rare letter alone costs more than UNEXPLAINED.
LEAST_BYTES = 32


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letter at all, or, from LEAST_BYTES on, no language's code is shorter than the text.

    If no row has a language label, nothing is learned and only documents without a letter go."""
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(language_id.LETTER)).select(*COLUMNS)
    kept = language_id.with_language(docs.select(*COLUMNS), model, list(COLUMNS))
    explained = (F.octet_length("text") < LEAST_BYTES) | (F.col("bits_per_byte") < UNEXPLAINED)
    return kept.where((F.col("lang_pred") != language_id.UNKNOWN) & explained).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that the join links, one row stays: the one with the smallest id, null ids last, then the smallest hash of the text."""
    return ngram_join.drop_copies(docs.select(*COLUMNS), width=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding is replaced in its text and n_chars follows; all documents stay."""
    masked = secret_scan.mask(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", keep_languages), ("ngram_join", drop_near_copies), ("secret_scan", mask_secrets), ("packing", pack)]

#: PPM code lengths and packing can't be put in SQL; tests/llm holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
