"""A training-corpus pipeline: documents to packed token sequences.

Each stage works on all that the one before kept, written as Parquet in the shared folder in between. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import exact_dedup, language_id, near_dedup, pii, queries
from rowloom.llm._shared import passing, release, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: those without text or without a letter. All others stay, with the language that the
    automata find as their lang, whatever it is; labels only teach. Null ids, repeated rows and an empty table are as any others; without
    any labelled row nothing can be told, and lang stays as it is."""
    samples = language_id.learn(docs)
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = language_id.identify(docs, samples).filter(F.col("lang_pred") != language_id.UNDETERMINED)
    return judged.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest id stays; of repeated rows one; null ids are smaller than all others."""
    return exact_dedup.dedup(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, at five-word shingles and a similarity of 0.8: the one with the smallest id. Rows with a null id stay."""
    return near_dedup.dedup(docs).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by pseudonyms under the session's key, n_chars counted anew (null for a null text)."""
    return pii.pseudonymise(docs, queries.pii_key(spark), found=None).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, as op6_best_fit_packing gives it. A null text is one piece of the end id."""
    return queries.packed(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii", private),
    ("packing", pack),
]

#: Suffix automata, similarities and Feistel networks have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing() as keep:
            before, docs = docs, scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
