"""A corpus through five stages: quality, near-duplicates, repeated passages,
benchmark passages, packing. Each stage's rows are written as Parquet in the
shared folder and read back as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafspring.llm import decontaminate, neardup, packing, quality, substring
from leafspring.llm.common import stored
from leafspring.llm.queries import table, tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the
    labelled ones of the documents given."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs, shingle=5, similarity=(80, 100))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages met before, in a document with a smaller id, are cut out."""
    return substring.remove_repeated_passages(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", classify), ("near_duplicates", near_duplicates), ("substrings", substrings),
    ("decontamination", decontaminated), ("packing", packed),
]

#: Learned weights and packing have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
