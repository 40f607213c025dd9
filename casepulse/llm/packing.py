"""Best-fit packing of token pieces into sequences, in bounded space."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casepulse.llm.common import map_arrow, spare, whole
from casepulse.llm.pretokens import PieceCache, id_bytes, worker_cache

#: Open bins of one packer, and pieces that one packer gets on average.
OPEN_BINS = 32_768
PIECES_PER_TASK = 40_000
#: Bytes of a token, at the least of usual texts, by which the number of pieces is estimated.
TOKEN_BYTES = 3
#: Pre-tokens that a Python worker keeps, and as many of an older generation.
WORKER_PIECES = 250_000


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, end_id: int | None, capacity: int = 1024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The token ids of each row's text, cut into pieces of at most ``capacity``.

    doc_id, piece (from 0), start (ids before it), length, ids (binary, little-endian unsigned
    32-bit integers). ``end_id`` closes each document. A document that does not fit is cut so that
    the first piece is what the full pieces leave over. A NULL text is empty; without ``end_id`` an
    empty text has no piece. No shuffle; memory is one batch of texts and the ids of one of them.
    """
    step, name = 4 * capacity, f"ids-{uuid.uuid4().hex}"
    end = b"" if end_id is None else id_bytes([end_id])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids", pa.binary()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(name, lambda: PieceCache(tokenizer_path, id_bytes, WORKER_PIECES))
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                ids = (
                    b"".join(b"".join(part) for part in cache.values(text))
                    if cache.plain(text) else cache.direct(text)
                ) + end
                doc_id, first = doc_id.as_py(), len(ids) % step or step
                for piece, at in enumerate([0, *range(first, len(ids), step)] if ids else ()):
                    own = ids[at:at + step] if at else ids[:first]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, own))
                    held += len(own)
                    if held > 1 << 21:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                        )
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return map_arrow(texts, cut, "doc_id long, piece int, start long, length long, ids binary")


class BestFit:
    """Online best fit with a fixed number of open bins.

    Open bins stand in stacks by free space; bit f of ``free`` says whether stack f has one, so
    the tightest bin that takes a piece is the lowest bit at or above its length. When no bin
    takes a piece and all places are open, the fullest bin closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.stacks = 0, [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def take(self, space: int) -> int:
        stack = self.stacks[space]
        number = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        return number

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the place in it of the next piece."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self.take(space)
        else:
            if self.open == self.open_bins:
                self.take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            space, number = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            self.stacks[left].append(number)
            self.free |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - space

    def put_all(self, lengths: Iterable[int]) -> list[tuple[int, int]]:
        return [self.put(length) for length in lengths]


def pack(
    pieces: DataFrame, *, packers: int, capacity: int = 1024, open_bins: int = OPEN_BINS,
    length_col: str = "length", keys: tuple[str, ...] = ("doc_id", "piece"),
) -> DataFrame:
    """``pieces`` with the sequence each goes to (``sequence_id``) and its ``offset`` there.

    ``packers`` tasks each get an even share by the hash of ``keys``, whatever the sources or
    groups of copies, and pack it as a stream, longest pieces first: memory is ``open_bins`` numbers
    and one batch. Rows are ordered by all of ``keys`` too, so a task that runs again packs alike.
    Every length must be 1 to ``capacity``; other lengths stop the job. All other columns come
    along; columns already named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitter = BestFit(capacity, open_bins)
        for batch in batches:
            lengths = batch.column(columns.index(length_col)).to_numpy(zero_copy_only=False)
            if len(lengths) and not (lengths.min() >= 1 and lengths.max() <= capacity):
                raise ValueError(f"lengths must be 1 to {capacity}")
            placed = np.array(fitter.put_all(lengths.tolist()), dtype="int64").reshape(-1, 2)
            at = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype("int64")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array((at << 40) + placed[:, 0]), pa.array(placed[:, 1])],
                names=[*columns, "sequence_id", "offset"],
            )

    task = spare(pieces, "task")
    dealt = (
        pieces.repartition(packers, *keys)
        .withColumn(task, F.spark_partition_id())
        .sortWithinPartitions(F.desc(length_col), F.xxhash64(*keys), *keys)
    )
    return map_arrow(dealt, fit, T.StructType([
        *pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ]))


def packers_for(
    docs: DataFrame, pieces_per_task: int = PIECES_PER_TASK, *, capacity: int = 1024, text_col: str | None = None
) -> int:
    """As many packers as the number of pieces asks for: one for each row and, given the text, more for the bytes of long ones."""
    size = F.octet_length(text_col) if text_col else F.lit(0)
    found = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("size")).first()
    pieces = found.n + (found.size or 0) // (TOKEN_BYTES * capacity)
    return max(1, -(-pieces // pieces_per_task))
