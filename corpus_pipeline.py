"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, mixing.

Part of the subpackage ``talkspark.llm``. Each stage works on all that the one before it kept.
Stages that judge a row by itself (language ID, decontamination, secrets) pass whole rows through and
shuffle nothing but what the secret scan's candidates need.

In all stages: nulls in any column are allowed, a null or empty text counts as a text without words;
very long texts are worked on whole; repeated rows are judged alike, and near duplicates keep one of
them; ties (documents of one group) go to the smallest doc_id; an empty table gives an empty one;
extra columns, whatever their names, are returned as they are by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkspark.llm import decontaminate, jaccard, langid, mixing, secrets
from talkspark.llm.common import Staged, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those rejected (junk, code, other scripts, no letters) go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard 0.8 of five-word shingles."""
    return jaccard.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those contaminated by benchmark items; texts without words stay."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret's characters replaced; a null text stays null."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and where they go."""
    return mixing.mix(docs).drop("rid")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("mixing", mix)]

#: The stages can't be expressed in SQL (nearest centroids, seeded draws); tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    st = Staged(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        mark = Staged.mark()
        docs = st.put(stage(spark, docs, sf_dir), name)
        Staged.release(mark)  # what the stage wrote for itself
    return STAGES[-1][1](spark, docs, sf_dir)
