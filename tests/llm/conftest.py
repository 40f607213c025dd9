from __future__ import annotations

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casepulse.llm.common import importable

#: Columns whose names the operators use themselves.
CLASHING = (
    "n_tokens", "row", "mark", "hash", "lines", "chunks", "spans", "kept", "keep_id", "shard", "size", "fp", "node", "task",
    "sequence_id", "n_lines", "_text", "_hash", "_salt", "left", "gone", "id", "own", "alone", "first", "again", "copies", "_hot",
)


@pytest.fixture(scope="session")
def llm(spark):
    importable(spark)
    return spark


@pytest.fixture(scope="session")
def texts(llm):
    """A table of documents from (doc_id, text) pairs, with columns of clashing names."""

    def build(rows, clashing=True):
        df = llm.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({name: F.lit("x") for name in CLASHING}) if clashing else df

    return build


LONG = "Some words of a very long text, 12 at a time.\nNext line here. " * 3000
#: NULLs, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "Tie of words here"), (7, "Tie of words here"),
    (7, "Tie of words here"), (None, "no id"), (None, "no id"), (8, LONG), (9, "é ́x 日本 🙂 <|endoftext|>İΣ\x1c\x85\xa0 end"),
    (10, "x" * 100_000), (11, "a\n" * 5000), (None, None), (12, "\n\n\n"), (13, "tail \r\n\x0b\x0c"),
]


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def encode():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = {path: Tokenizer.from_file(path) for path in map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))}
    return lambda path, text: made[path].encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="session")
def small(testdata, llm):
    """The documents of the smallest test tables, as rows and as a frame."""
    df = llm.read.parquet(f"{testdata}/documents.parquet")
    return [(r.doc_id, r.text) for r in df.collect()], df
