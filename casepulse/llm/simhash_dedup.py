"""Near duplicates by SimHash: Golay-decoded segments give join keys, candidates are verified.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18. A and B are decoded to
the indices of the codewords within 4 bits, of which words up to 2 bits apart share one. At most
3 bits differ between linked fingerprints, a + b + c in the segments, so one of these keys agrees:

    code(A), C      if c = 0 and a <= 2            code(B), C      if c = 0 and b <= 2
    code(A), B      if b = 0 and c > 0             A, code(B)      if a = 0 and c > 0
    code(A), a half of B, a half of C              if a = b = c = 1

They have 30 to 35 bits, about 42 of them per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepulse.llm.common import join_groups, map_arrow, parts_of, spare, whole
from casepulse.llm.components import components
from casepulse.llm.golay import near_codewords
from casepulse.sources.writers import stage

#: Fingerprints under one key that one task compares; larger groups are dealt out in pairs of blocks.
BLOCK = 4096
SEED = 42
#: Stands in for the id of rows without one; above every id.
NO_ID = 1 << 62
#: Shingles whose bits are counted at once.
_SLAB = 1 << 15


def fingerprint_of(text: str, shingle: int) -> int:
    """Bit by bit the majority of the hashes of all word shingles; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    total, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, total, _SLAB):
        part = words[at:min(at + _SLAB, total) + shingle - 1]
        hashes = np.fromiter(
            (digest(join(s), SEED) for s in zip(*(part[k:] for k in range(shingle)), strict=False)), dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint as a long, of every row. No shuffle."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return map_arrow(texts, hashed, "doc_id long, fp long")


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of fingerprints (unsigned), and for each key the place of its fingerprint."""
    a, b, c = fps & np.uint64(0x7FFFFF), fps >> np.uint64(23) & np.uint64(0x7FFFFF), fps >> np.uint64(46)
    a, b, c = (x.astype(np.int64) for x in (a, b, c))
    at = np.arange(len(fps))
    keys, places = [], []

    def add(kind: int, code: np.ndarray, rest: np.ndarray, bits: int) -> None:
        known = code >= 0
        keys.append(((kind << 56) | (code << bits) | rest[:, None])[known])
        places.append(np.broadcast_to(at[:, None], code.shape)[known])

    code_a, code_b = near_codewords(a), near_codewords(b)
    add(1, code_a, c, 18)
    add(2, code_b, c, 18)
    add(3, code_a, b, 23)
    add(4, code_b, a, 23)
    for kind, half_b, half_c in (
        (5, b & 0x7FF, c & 0x1FF), (6, b & 0x7FF, c >> 9), (7, b >> 11, c & 0x1FF), (8, b >> 11, c >> 9)
    ):
        add(kind, code_a, half_b << 9 | half_c, 21)
    return np.concatenate(keys), np.concatenate(places)


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what all links up to ``distance`` connect: at most one per fingerprint."""
    links, rest = [], np.unique(fps)
    while len(rest):
        found, rest = [rest[0]], rest[1:]
        while found and len(rest):
            own = found.pop()
            near = np.bitwise_count(rest ^ own) <= distance
            if near.any():
                met = rest[near]
                links += [(int(own), int(other)) for other in met]
                found += list(met)
                rest = rest[~near]
    return links


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Batches sorted by their first ``columns`` columns, recut where these change, and the starts of runs."""
    held: list[np.ndarray] | None = None

    def cut(parts: list[np.ndarray]) -> np.ndarray:
        change = np.zeros(len(parts[0]), dtype=bool)
        change[:1] = True
        for column in parts[:columns]:
            change[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        parts = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            parts = [np.concatenate(pair) for pair in zip(held, parts, strict=True)]
        starts = cut(parts) if len(parts[0]) else np.array([], dtype=np.int64)
        if len(starts) > 1:
            yield [p[:starts[-1]] for p in parts], starts[:-1]
            parts = [p[starts[-1]:] for p in parts]
        held = parts
        while len(held[0]) > 2 * BLOCK:  # a large group goes on in pieces, none smaller than a block
            yield [p[:BLOCK] for p in held], np.array([0])
            held = [p[BLOCK:] for p in held]
    if held is not None and len(held[0]):
        yield held, cut(held)


def links(fps: DataFrame, *, distance: int = 3) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) that connect what pairs up to ``distance`` bits apart connect.

    The keys of each fingerprint are shuffled and sorted; a group of one key gives at most one
    link per member instead of all its pairs. A group of more than ``BLOCK`` members is counted,
    dealt into blocks by the hash, and each pair of blocks is compared by a task of its own.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the keys find distances up to 3 bits")
    spark, parts = fps.sparkSession, parts_of(fps.sparkSession)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            keys, places = join_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[places])], names=["key", "fp"])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of groups of one task; the members of larger groups come back with their key instead."""
        for (keys, own), starts in _runs(batches, 1):
            ends = np.append(starts[1:], len(own))
            sizes = ends - starts
            own = own.view(np.uint64)
            pair = starts[sizes == 2]
            pair = pair[np.bitwise_count(own[pair] ^ own[pair + 1]) <= distance]
            out = [(None, int(x), int(y)) for x, y in zip(own[pair], own[pair + 1], strict=True)]
            for start, end in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                if end - start < BLOCK:
                    out += [(None, x, y) for x, y in forest(own[start:end], distance)]
                else:
                    out += [(int(keys[start]), int(x), None) for x in own[start:end]]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.int64()),
                    *(pa.array([None if v is None else v - (v >> 63 << 64) for v in c], pa.int64()) for c in columns[1:]),
                ], names=["key", "a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of pairs of blocks; each has about two blocks of members."""
        group: list = []

        def done() -> Iterator[pa.RecordBatch]:
            if group:
                found = forest(np.concatenate([g[3] for g in group]).view(np.uint64), distance)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in zip(*found, strict=True)],
                        names=["a", "b"],
                    )

        for columns, starts in _runs(batches, 3):
            for start, end in zip(starts, np.append(starts[1:], len(columns[0])), strict=True):
                own = [c[start:end] for c in columns]
                if group and any(g[0] != o[0] for g, o in zip(group[-1], own[:3], strict=False)):
                    yield from done()
                    group = []
                group.append(own)
        yield from done()

    keyed = map_arrow(fps.select("fp"), explode, "key long, fp long")
    sorted_ = keyed.repartition(parts, "key").sortWithinPartitions("key")
    found = stage(spark, map_arrow(sorted_, connect, "key long, a long, b long"), "fp-links")
    near = found.where("b is not null").select("a", "b")
    large = found.where("b is null").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return near
    blocks = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = large.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    pairs = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return near.union(map_arrow(pairs, compare, "a long, b long"))


def simhash_dedup(
    docs: DataFrame, *, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fp (64-bit fingerprint as a long) and component_id of every row.

    Texts are lower-cased (A-Z), cut into words and shingles of ``shingle`` words; fewer words are
    one shingle, no words give fingerprint zero, which links like any other. Two rows are linked
    if their fingerprints differ in at most ``distance`` bits; component_id is the smallest id
    reachable over links. Copies meet in one distinct fingerprint before any comparison.

    A NULL text is empty. Rows without an id take part; a component of only such rows has a NULL
    component_id. Ids must be below 2^62. Repeated rows are reported alike; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stage(spark, fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = stage(spark, rows.groupBy("fp").agg(
        F.coalesce(F.min("doc_id"), F.pmod(F.col("fp"), F.lit(NO_ID)) + NO_ID).alias("node"),
        F.count(F.lit(1)).alias("copies"),
    ), "fp-nodes")
    pairs = links(nodes, distance=distance)
    own, other = nodes.select(F.col("fp").alias("a"), F.col("node").alias("x")), nodes.select(
        F.col("fp").alias("b"), F.col("node").alias("y")
    )
    roots = components(pairs.join(own, "a").join(other, "b").select("x", "y"))
    groups = stage(spark, nodes.join(roots, "node", "left").select(
        "fp", "copies", F.coalesce("root", "node").alias("component_id")
    ), "fp-groups")
    joined = join_groups(rows, groups, ["fp"], size="copies", spread=["doc_id"])
    return joined.select(
        "doc_id", "fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id")
    )


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(
    docs: DataFrame, *, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all their columns.

    The ids that go are joined away by id. Rows without an id stay. Of rows that repeat an id all
    stay or go, unless one of them is in another component than its id: it goes with the rest.
    """
    found = simhash_dedup(docs, shingle=shingle, distance=distance, id_col=id_col, text_col=text_col)
    name = spare(docs, "gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
