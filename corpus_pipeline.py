"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage is written as Parquet and read again before the next. Every stage works on all rows its predecessor kept and
returns the columns of ``documents``, but for the last, which returns the packed pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annomat.llm import langid, packing, quality, simhash, substring
from annomat.llm.catalogue import vocabulary
from annomat.llm.common import shared_folder, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: without letters, or with next to no n-gram of any learned language."""
    small_batches(spark)
    return langid.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under the model of trusted text is above their language's threshold."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts windows of 20 words that occur earlier in the corpus; documents stay, n_chars follows the text."""
    small_batches(spark)
    return substring.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", pack),
]

#: SQL has no Kneser-Ney model, SimHash or tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; stages in between are tables in the shared checkpoint folder."""
    top = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{top}/pipeline-{uuid.uuid4().hex}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
