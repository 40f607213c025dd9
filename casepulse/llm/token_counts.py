"""Token counts by a map-side lookup in two tiers, without a shuffle."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepulse.llm.common import map_arrow, whole
from casepulse.llm.pretokens import LONGEST, PieceCache, worker_cache

#: Rows (about) that the table of frequent pre-tokens is made from, and its entries, of ``LONGEST`` characters
#: at most. The table only saves work: counts are the same whatever is in it.
SAMPLE_ROWS = 4000
TABLE_SIZE = 32_768
#: Further pre-tokens that a Python worker keeps, and as many of an older generation.
WORKER_PIECES = 250_000

def frequent_lengths(
    docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
    table_size: int = TABLE_SIZE,
) -> dict[str, int]:
    """The number of tokens of the pre-tokens most frequent in a bounded sample of rows.

    Each partition keeps a counter of bounded size over its share of the sample and hands on its ``table_size``
    first entries; Spark adds these up.
    """
    total = docs.count()
    if not total:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = PieceCache(tokenizer_path, len, 0), Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if cache.plain(text):
                    for pieces in cache.parts(text):
                        seen.update(piece for piece in pieces if len(piece) <= LONGEST)
                        if len(seen) > 16 * table_size:
                            seen = Counter(dict(seen.most_common(4 * table_size)))
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"]
        )

    sample = docs.select(whole(text_col).alias("text")).sample(min(1.0, sample_rows / total), seed=7)
    counted = map_arrow(sample, count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "piece").limit(table_size).collect()
    return PieceCache(tokenizer_path, len, 0).made({row.piece for row in top})


def token_counts(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 1024, sample_rows: int = SAMPLE_ROWS, table_size: int = TABLE_SIZE,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    First tier: a broadcast table of at most ``table_size`` frequent pre-tokens, each of at most ``LONGEST``
    characters, and their numbers of tokens. Second tier: a cache in each Python worker, filled by the library. Nothing is
    shuffled, so a hot source or a group of copies costs no more than its bytes.

    Counts are those of the tokenizers library on the whole text without added special tokens,
    truncation or padding; a special token's string in the text is that token. A NULL text is
    empty; repeated rows are counted alike; other columns are ignored; an empty table gives an
    empty result.
    """
    name = f"lengths-{uuid.uuid4().hex}"
    shared = docs.sparkSession.sparkContext.broadcast(
        frequent_lengths(docs, tokenizer_path, text_col=text_col, sample_rows=sample_rows, table_size=table_size)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(name, lambda: PieceCache(tokenizer_path, len, WORKER_PIECES, shared.value))
        for batch in batches:
            counts = []
            for text in batch.column(1):
                text = text.as_py()
                counts.append(
                    sum(map(sum, cache.values(text))) if cache.plain(text) else cache.direct(text)
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"),
        F.octet_length(whole(text_col)).cast("long").alias("n_bytes"),
    )
    return map_arrow(rows, count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
