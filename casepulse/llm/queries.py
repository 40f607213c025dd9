"""The operators over whole tables, with production parameters; digests where the outputs are large."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepulse.llm import (
    bpe,
    exact_dedup,
    line_dedup,
    merkle,
    packing,
    pii,
    prefix_trie,
    quality_rules,
    sharding,
    simhash_dedup,
    token_counts,
    topk,
    warc,
)
from casepulse.llm.common import table

#: Tokens per sequence, the id that ends a document, shards.
CAPACITY, END_ID, SHARDS = 1024, 2, 16
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable) -> Callable:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_left"),
        F.sha2("text", 256).alias("left_sha256"),
    )


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=CAPACITY
    )


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)

    def rows(kind: str, size, **options) -> DataFrame:
        return warc.read_warc(spark, folder, where={"record_type": [kind]}, **options).select(
            warc.page_of("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), "payload_digest",
            "record_type", warc.page_of("refers_to").alias("refers_to"),
        )

    # Payloads are decoded once, to check them; the scan for revisits goes past them.
    return rows("response", F.octet_length("payload"), verify=True).union(
        rows("revisit", F.col("payload_bytes"), payload=False)
    )


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), shards=SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))
    base = [kind.name for kind in pii.KINDS if kind.base]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(name: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(name))).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id", *map(number, base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pieces = packing.token_pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID, capacity=CAPACITY
    ).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, packers=packing.packers_for(docs, capacity=CAPACITY, text_col="text"), capacity=CAPACITY)


@query
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(documents(spark, sf_dir), shingle=3, distance=3).select(
        "doc_id", simhash_dedup.hex_fingerprint("fp").alias("fingerprint"), "component_id"
    )


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum five divides present their text in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(tampered, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    return merkle.merkle_manifest(
        documents(spark, sf_dir), columns=["doc_id", "source", "lang", "n_chars", "text"], presented={"text": text}, proofs=False
    ).withColumnRenamed("id", "doc_id")


@query
def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie.prefix_trie(
        table(spark, sf_dir, "conversations"), kept=F.crc32(conv.cast("string")) % 9, base=conv - conv % 5, longest=8
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
