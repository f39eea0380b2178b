"""The corpus pipeline: language identification, exact and near deduplication, mixing and packing of ``documents``.

Each stage reads all that its predecessor kept; all but the last return the columns of their input, the first with
lang_pred and score, the fourth with mix_position and mix_share. Defined cases, for every stage: texts of any length are
taken whole; further columns stay, and of the columns that a stage adds one of the same name is replaced; an empty table
gives an empty table of the same columns. Null and empty texts, and those without a letter, have no language and go in the
first stage, so no later one meets them. A null lang or source is a value like any other. Ties and repeated rows are told
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import exact_dedup, langid, mixing, packing, simhash
from caselens.llm.common import bounded_batches, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its language (lang_pred) and score; those without any letter, null and empty texts included, have no
    language and go. Ties go to the language that sorts first; repeated rows all stay. Rows of a null lang or doc_id are
    predicted, but not learned from."""
    bounded_batches(spark)
    return langid.tagged(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the document of the largest doc_id stays (a null one is smallest); of
    rows that repeat it, one stays."""
    bounded_batches(spark)
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one of the smallest doc_id stays, of rows that repeat it one; a document
    without doc_id stays if its component has no other."""
    bounded_batches(spark)
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the sources' schedule, with their places in it and their sources' target shares. None
    goes; rows that repeat a doc_id have the place of the first; a null source is a queue of its own."""
    bounded_batches(spark)
    return mixing.planned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences by the mixing plan, with their token ids, languages and scores. Each token of
    each row lies in exactly one piece, those of repeated rows too; ties of the plan go by doc_id."""
    bounded_batches(spark)
    return packing.pack(docs, planned=True, keep=("lang_pred", "score"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_dedup", near), ("mix_sources", mix), ("pack", pack)]

#: Fingerprints and tokens are not SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
