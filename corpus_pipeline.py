"""Corpus pipeline: quality filter, exact and near duplicates, and packing into sequences.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loresmith.llm import exact_dedup, near_dedup, packing, subword_classifier
from loresmith.llm.queries import WORD_BPE, id_remainder, table
from loresmith.llm.staging import small_batches, stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go.

    Null text counts as empty; null and repeated ids are scored row by row; an
    empty table stays empty, and one without labels of both classes keeps or
    rejects by the share of good labels alone.
    """
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 4) != 2)
    return subword_classifier.keep_good(docs, subword_classifier.fit(docs, labels, "quality"), 0.7)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, each (id, text) once.

    Null text counts as empty; a null id stays only where no other row has its
    text; an id beside two texts keeps both; an empty table stays empty.
    """
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Texts without words are one group; rows without an id all stay; an id beside
    two texts is decided on for each; an empty table stays empty.
    """
    small_batches(spark)
    return near_dedup.drop_near_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens.

    Null and empty texts give one piece of the end id; rows that repeat an id
    each get places of their own; an empty table gives no pieces.
    """
    small_batches(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path(WORD_BPE), end_id=1, capacity=4096)
    return packing.pack_pieces(pieces.select("doc_id", "piece", "start", "length"), "length", 4096)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs


QUERIES = {"pipeline": run}
#: No stage but the second is expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
