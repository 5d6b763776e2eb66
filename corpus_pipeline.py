"""A training corpus from raw documents, stage by stage; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, langid, mixing, simhash, subwords
from ledgerloom.llm.common import prepared
from ledgerloom.session import durable
from ledgerloom.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, texts without a letter and texts in which no language has half of the letters go."""
    prepared(spark)
    return langid.drop_unidentified(docs, least=0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays."""
    prepared(spark)
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts (the smallest id) stays; texts link at a Jaccard similarity of 0.8 of their five-word
    shingles. Close copies are found by the SimHash trie, all others by an exact join. Texts without words are equal."""
    prepared(spark)
    return simhash.drop_similar(docs, width=5, least=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: rows repeat, and some documents are not taken."""
    prepared(spark)
    return mixing.mix_documents(docs, weights=(5.0, 2.0, 1.0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and the decoded text of every document of the mix."""
    prepared(spark)
    return subwords.coded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mixing", mixed),
    ("sentencepiece", encoded),
]

#: Language labels, fingerprints and token ids are out of SQL's reach; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepared(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
