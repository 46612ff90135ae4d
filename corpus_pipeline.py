"""A training-corpus pipeline of five stages, each one of the operators in ``tarnwork.llm``.

Each stage takes (spark, docs, sf_dir), works on all documents that the one
before it kept, and returns the columns of documents; the last returns what
the texts became as tokens.

Defined cases, those of the operators taken together: a null text counts as
empty, and stays; rows with a null doc_id are kept like others, and with equal
texts are one document; rows equal in id and text are one document after the
second stage; without any label the first stage keeps all, and all go where
labels are 0 only; an empty table gives an empty result of the same columns;
other columns of documents are carried along and not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from tarnwork.llm.common import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    return jaccard_join.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occurred before."""
    return suffix_dedup.clean(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as tokens: counts and digests of its ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", passages),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: A trained classifier and a vocabulary file decide the rows: SQL cannot state them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
