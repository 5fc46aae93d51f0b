"""A corpus pipeline over ``documents``: language ID, near-duplicates, decontamination, mixing.

Every stage takes the documents its predecessor kept, with all their columns; the last returns the mix, a row per
document with the copies and words taken of it.  All stages take null values in any column, repeated rows, extra
columns and empty tables; what they do with them is stated with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import decontaminate, jaccard, languages, mixing, simhash
from flowloom.llm.columns import table
from flowloom.storage import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; the model learns from all labelled documents.

    Null and empty texts go, and so do texts without letters and those of which less than a third is learned language
    and the rest noise.  Repeated rows are judged alike.  Without any label, or without rows, nothing is left.
    """
    return languages.keep_identified(docs, languages.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; five-word shingles, similarity 0.8 or more.

    Texts without words are one group.  Of repeated rows one stays; where an id stands on several texts of a group, the
    text with the smallest key.  A null id is never the smallest; a group of null ids keeps one row.  Candidates come
    from SimHash by the generalised pigeonhole principle, as in ``op2_simhash_neardup``, and from MinHash, as 64 bits
    miss most copies that differ in more than a few words; the shingles of both texts decide.
    """
    return simhash.keep_one(docs, materialize(jaccard.jaccard_groups(docs), "pipeline-groups"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in a passage go.

    Null and empty texts stay, and so do repeated rows; without benchmark items everything stays.
    """
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of every document, so that each source meets its target.

    A null source is a source, a null text has no words and nothing is taken of it; repeated rows are documents of their
    own.  Without documents the mix is empty.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SQL cannot express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
