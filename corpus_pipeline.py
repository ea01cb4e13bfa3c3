"""Corpus pipeline: stages that each apply one training-data operator to what the stage before kept.

Null texts count as empty and are clean; null and repeated doc_ids are told apart by their text; ties go to the
smaller doc_id, then to the smaller hash of the text; very long texts are taken whole; empty tables give no rows;
further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import mixing, nearwords, packing, repeats, toxicity
from logloom.llm.common import scratch_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not scored as toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints of at most 3 differing bits, or five-word shingles of similarity 0.8 or more, join."""
    return nearwords.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or of 400 bytes, that occur more than once."""
    return repeats.without_repeats(docs, words=51)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.report(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mixture),
    ("best_fit_packing", sequences),
]

#: SQL has neither the string kernel nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; what one returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}-{uuid.uuid4().hex[:8]}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
    return docs
