"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next one.

Stages that filter or rewrite return the columns of documents; the last one returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.llm import decontam, packing, pii, simhash, toxicity
from selvage.llm.common import delete, shared_folder, table
from selvage.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on a bounded sample of the labels, grades over 0 go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return simhash.drop_similar(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that hold a window of a benchmark item are cut out of the texts."""
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as query op4 returns them, with the ids."""
    pieces = packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", cut_benchmark), ("private_data", mask_private), ("packing", pack)]

#: Classifiers, fingerprints and tokens cannot be written in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each but the last written to the shared folder and read again.

    What the last stage reads stays there, for the caller to read the result as often as needed.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:  # nothing reads the stage before any more
                delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
