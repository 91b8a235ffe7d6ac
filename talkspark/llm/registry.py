"""The subpackage's queries and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkspark.llm import decontaminate, jaccard, langid, mixing, pii, secrets, suffixes, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_suffix_dedup": suffixes.op4_suffix_dedup,
        "op5_pii": pii.op5_pii,
        "op6_mixing": mixing.op6_mixing,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_language_id": langid.op8_language_id,
        "op9_topk": topk.op9_topk,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.oracle(), "op2_jaccard": jaccard.ORACLE, "op4_suffix_dedup": suffixes.ORACLE, "op5_pii": pii.oracle(), "op7_decontaminate": decontaminate.ORACLE, "op9_topk": topk.ORACLE, "op10_warc": warc.ORACLE}
