"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the UTF-8 bytes chooses where a text is cut, so equal passages in different
documents give equal chunks wherever they stand. Chunks that occur more than once in the corpus
are encoded once; a document then joins the ids of its chunks and repairs each join.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepulse.llm.common import join_groups, map_arrow, whole
from casepulse.llm.pretokens import (
    ODD,
    ODD_SEAM,
    SEAM,
    Generations,
    id_bytes,
    library_pieces,
    load,
    model_ids,
    slices,
    special_strings,
    worker_cache,
)
from casepulse.sources.writers import stage

#: Bytes that the rolling hash sees, chance of a cut after a byte, and the least length of a chunk.
WINDOW, AVERAGE, LEAST = 32, 2048, 512
#: Pieces that a Python worker keeps, and as many of an older generation.
WORKER_PIECES = 60_000
# Fixed value: the pattern that cuts normal text into pieces, for the characters that are not in ODD.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: What a join's window has to its right and left: up to white space, which nothing goes over.
_HEAD, _TAIL = re.compile(r"[^ \t\r\n]*"), re.compile(r"[^ \t\r\n]*\Z")
#: The base of the rolling hash to the powers 1, 2, 4 and so on, below WINDOW.
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(WINDOW.bit_length() - 1)]
_SLAB = 1 << 20


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of a text: after bytes where the hash of the last WINDOW bytes says so.

    Never inside a character; chunks have LEAST bytes at least, but for the last.
    """
    found, n = [], len(data)
    last = 0
    for at in range(0, n, _SLAB):
        low = max(0, at - WINDOW + 1)
        part = np.frombuffer(data, np.uint8, min(at + _SLAB, n) - low, low)
        if len(part) < WINDOW:
            continue
        own = part.astype(np.uint64) + np.uint64(1)
        rolled, width = own, 1
        for power in _POWERS:  # the hash of twice as many bytes comes from two hashes
            rolled = rolled[:-width] * power + rolled[width:]
            width *= 2
        ends = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(AVERAGE) == 0) + low + WINDOW
        for end in ends.tolist():
            if end - last >= LEAST and end < n and data[end] & 0xC0 != 0x80:
                found.append(end)
                last = end
    return [*found, n]


def chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in cuts(data):
        out.append(data[start:end])
        start = end
    return out


class Encoder:
    """Encodes pieces of words through a cache that lives as long as its Python worker; ids are bytes, 4 for each.

    The text's normal form (NFC, lower case) is cut by the tokenizer's pattern, and the library's
    model gives the ids of each piece. Texts with characters for which libraries may differ in any
    of this get their normal form and pieces from the library; with a special token's string they go
    to it as a whole.
    """

    def __init__(self, path: str, limit: int = WORKER_PIECES):
        self.tokenizer = load(path)
        self.special = special_strings(self.tokenizer)
        self.pieces = Generations(limit, self.made)
        self.cut, self.cut_odd = re.compile(PATTERN).findall, library_pieces(self.tokenizer)

    def made(self, pieces: set[str]) -> dict[str, bytes]:
        ids = model_ids(self.tokenizer)
        return {piece: id_bytes(ids(piece)) for piece in pieces}

    def encode(self, text: str) -> bytes:
        """The ids of a text. White space ends a token whatever stands around it."""
        if any(s in text for s in self.special):
            return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        normal = "" if ODD.search(text) else normalize("NFC", text).lower()
        if odd := ODD.search(normal or text):
            normal = self.tokenizer.normalizer.normalize_str(text)
        cut = self.cut_odd if odd else self.cut
        parts = slices(normal, seams=ODD_SEAM if odd else SEAM)
        return b"".join(b"".join(self.pieces.values(cut(part))) for part in parts)

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def joined(texts: Sequence[str], ids: Sequence[bytes], encode: Callable[[str], bytes]) -> bytes:
    """The ids of the joined texts from the ids of each.

    The window around a join is encoded anew. It grows to either side up to white space, if need
    be over whole chunks; beyond that the ids of the chunks agree exactly with those of the whole
    text, as no token, normal form or special string goes over white space.
    """
    out, word = [], ""  # word: what the window has to the left of the next join
    for text, own in zip(texts, ids, strict=True):
        head = _HEAD.match(text)[0]
        if len(head) == len(text):
            word += text
            continue
        tail = _TAIL.search(text)[0]
        inner = own[len(encode(head)):len(own) - len(encode(tail))]
        out += [encode(word + head), inner]
        word = tail
    return b"".join([*out, encode(word)])


def chunk_hashes(rows: DataFrame) -> DataFrame:
    """doc_id, mark, no, hash (128 bits) of the chunks of each row of doc_id, mark, text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, numbers, hashes = [], [], []
            for row, text in enumerate(batch.column(2)):
                own = chunks(text.as_py().encode())
                where += [row] * len(own)
                numbers += range(len(own))
                hashes += [blake2b(chunk, digest_size=16).digest() for chunk in own]
            kept = batch.select([0, 1]).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(numbers, pa.int32()), pa.array(hashes, pa.binary())],
                names=["doc_id", "mark", "no", "hash"],
            )

    return map_arrow(rows, hashed, "doc_id long, mark long, no int, hash binary")


def encode_decode(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) and decoded text of every row.

    Chunk hashes are counted over the corpus; of each chunk that occurs again one place is chosen,
    and only there it is encoded. Its ids go to all its places, spread where a chunk is very
    frequent, and each document is put together from those and from its own other chunks. The
    texts are shuffled once, by document and compressed.

    For tokenizers in which white space separates tokens and is dropped. Ids are those of the
    library on the whole text without added special tokens, truncation or padding. A NULL text is
    empty. Rows are told apart by id and text, so repeated rows are encoded alike; other columns
    are ignored; an empty table gives an empty result.
    """
    spark, name = docs.sparkSession, f"words-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("mark"), "text"
    )
    places = stage(spark, chunk_hashes(rows), "chunk-places")
    small = ids_dtype(tokenizer_path)
    shared = stage(spark, places.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "no")).alias("at")
    ).where("n > 1"), "chunk-groups")

    def encoder() -> Encoder:
        return worker_cache(name, lambda: Encoder(tokenizer_path))

    def encode_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode
        for batch in batches:
            hashes, ids = [], []
            for text, chosen in zip(batch.column(0), batch.column(1), strict=True):
                own = chunks(unpack(text.as_py()))
                for no in chosen.as_py():
                    hashes.append(blake2b(own[no], digest_size=16).digest())
                    ids.append(np.frombuffer(encode(own[no].decode()), "<u4").astype(small).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], names=["hash", "ids"]
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        for batch in batches:
            doc_ids, all_ids, decoded, held = [], [], [], 0
            for doc_id, text, known in zip(*batch.columns, strict=True):
                text, known = unpack(text.as_py()), {c["no"]: c["ids"] for c in known.as_py() or ()}
                if known:
                    parts = [chunk.decode() for chunk in chunks(text)]
                    ids = joined(parts, [
                        np.frombuffer(known[k], small).astype("<u4").tobytes() if k in known else own.encode(p)
                        for k, p in enumerate(parts)
                    ], own.encode)
                else:  # no chunk to reuse: the whole text is one
                    ids = own.encode(text.decode())
                doc_ids.append(doc_id.as_py())
                all_ids.append(ids)
                decoded.append(own.decode(ids))
                held += len(ids)
                if held > 1 << 21:
                    yield _batch(doc_ids, all_ids, decoded)
                    doc_ids, all_ids, decoded, held = [], [], [], 0
            if doc_ids:
                yield _batch(doc_ids, all_ids, decoded)

    key = ["doc_id", "mark"]
    packed = map_arrow(rows, compressed, "doc_id long, mark long, text binary")
    chosen = shared.select("at.*").groupBy(*key).agg(F.collect_list("no").alias("chosen"))
    codes = map_arrow(
        _join(packed, chosen, key, "inner").select("text", "chosen"), encode_chosen, "hash binary, ids binary"
    )
    known = join_groups(
        places, codes, ["hash"], size="n", spread=["doc_id"], sizes=shared, value="ids"
    ).groupBy(*key).agg(F.collect_list(F.struct("no", "ids")).alias("known"))
    return map_arrow(
        _join(packed, known, key, "left").select("doc_id", "text", "known"), assemble,
        "doc_id long, ids binary, decoded string",
    )


def ids_dtype(tokenizer_path: str) -> str:
    """The shortest integers that hold every id of a vocabulary."""
    return "<u2" if load(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text as compressed UTF-8, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield batch.set_column(2, "text", pa.array([pack(t.as_py().encode()) for t in batch.column(2)], pa.binary()))


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _batch(doc_ids: list, ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
        names=["doc_id", "ids", "decoded"],
    )


def _join(rows: DataFrame, lists: DataFrame, key: list[str], how: str) -> DataFrame:
    """Rows to lists with the same id and mark; ids may be NULL."""
    other = lists.select(*(F.col(k).alias(f"of_{k}") for k in key), *(c for c in lists.columns if c not in key))
    same = rows.doc_id.eqNullSafe(other.of_doc_id) & (rows.mark == other.of_mark)
    return rows.join(other, same, how).drop("of_doc_id", "of_mark")
