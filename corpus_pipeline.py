"""A training-data pipeline over ``documents``: each stage reads what the one before has written.

Language ID drops documents whose language isn't told, exact and near deduplication keep one document of each
group, mixing repeats or leaves documents to meet the sources' targets, and BPE gives each document's token ids.
Null ids, texts and sources, ties, repeated rows and empty tables are as the functions that the stages call say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, exact_dedup, language_id, mixing, simhash
from graphloom.llm.common import shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay, with the columns of documents."""
    return language_id.keep_identified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.keep_one_of_each(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep_one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.repeat_to_mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to."""
    return bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_level_bpe", bpe_stage),
]

#: Subset sums, SimHash components and merges have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages meet in Parquet under ``spark.checkpoint.dir``.

    What a stage has read goes when its result is written, so the corpus lies there twice at most.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{i}-{name}"
    return docs
