"""From raw documents to packed training sequences, as stages that are each written and reread."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepulse.llm import line_dedup, packing, pii, quality_rules, simhash_dedup
from casepulse.llm.common import table
from casepulse.llm.queries import CAPACITY, END_ID
from casepulse.session import shared_folder
from casepulse.sources.writers import remove_folder, staging


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the learned quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of lines that the corpus repeats."""
    cut = line_dedup.line_dedup(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return simhash_dedup.keep_first(docs, shingle=3, distance=3)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most ``CAPACITY``."""
    pieces = packing.token_pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID, capacity=CAPACITY
    ).withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(pieces, packers=packing.packers_for(docs, capacity=CAPACITY, text_col="text"), capacity=CAPACITY)


STAGES = [
    ("quality_rules", good),
    ("line_dedup", without_repeats),
    ("simhash_dedup", one_of_each),
    ("pii", without_personal_data),
    ("packing", packed),
]
#: Rolling hashes, fingerprints, learned rules and a tokenizer have no SQL form; tests compare each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; each stage's result is stored before the next one reads it.

    Only the last one's stays: earlier results, and what the operators stage, go as soon as they have been read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    with staging(spark):
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove_folder(spark, before)
            before = f"{folder}/{name}"
    return docs
