"""The registered queries of the training-data operators, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, fingerprints, hard_negatives, html_text, jaccard_join, licenses, merkle, mixing, quality, suffix_dedup, transport


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.query,
        "op2_jaccard": jaccard_join.query,
        "op3_bpe": bpe.query,
        "op4_html": html_text.query,
        "op5_fingerprints": fingerprints.query,
        "op6_chat": chat.query,
        "op7_transport": transport.query,
        "op8_mixing": mixing.query,
        "op9_quality": quality.query,
        "op10_suffix": suffix_dedup.query,
        "op11_exact": exact_dedup.query,
        "op12_merkle": merkle.query,
        "op13_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": licenses.ORACLE_SQL,
        "op2_jaccard": jaccard_join.ORACLE_SQL,
        "op6_chat": chat.ORACLE_SQL,
        "op8_mixing": mixing.ORACLE_SQL,
        "op10_suffix": suffix_dedup.ORACLE_SQL,
        "op11_exact": exact_dedup.ORACLE_SQL,
        "op12_merkle": merkle.ORACLE_SQL,
        "op13_negatives": hard_negatives.ORACLE_SQL,
    }
