from __future__ import annotations

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casepulse.llm import bpe, packing, pretokens
from casepulse.llm.token_counts import frequent_lengths, token_counts
from tests.conftest import rows_of
from tests.llm.conftest import ODD

MIXED = st.text(st.one_of(
    st.sampled_from(" \n\t.,'aA1é<|>_"), st.characters(codec="utf-8"), st.characters(max_codepoint=0x4ff),
), max_size=60)


WEB = [
    "“Don’t stop,” she said — it’s the year’s best… naïve café", "日本語のテキストは空白なしで続く。東京と大阪の間", "مرحبا بالعالم هذا نص عربي قصير",
    "👍🏽 great 🙂🙂 post — 50 % off™ ½ price", "ราคาสินค้าในร้าน", "Straße\u00a0und İstanbul, ΑΣ ΣΑΣ", "plain words, and 1234 numbers",
]


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


@settings(max_examples=300, deadline=None)
@given(text=MIXED)
def test_pieces_give_the_ids_of_the_library(byte_bpe, encode, text):
    cache = pretokens.PieceCache(byte_bpe, pretokens.id_bytes, 50)
    got = b"".join(b"".join(part) for part in cache.values(text)) if cache.plain(text) else cache.direct(text)
    assert unpacked(got) == encode(byte_bpe, text)


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_texts_of_the_web_come_through_the_cache(byte_bpe, word_bpe, encode, kind):
    """Curly quotes, dashes, no-break spaces, CJK, Arabic, Thai, emoji: the library's ids, most pieces kept."""
    texts = [" ".join(WEB[(k + j) % len(WEB)] for j in range(5)) for k in range(70)]
    if kind == "bytes":
        path, cache = byte_bpe, pretokens.PieceCache(byte_bpe, pretokens.id_bytes, 10_000)
        run = lambda text: b"".join(b"".join(part) for part in cache.values(text))
        assert all(map(cache.plain, texts))
    else:
        path, cache = word_bpe, bpe.Encoder(word_bpe)
        run = cache.encode
    asked, missed, values, make = [], [], cache.pieces.values, cache.pieces.make
    cache.pieces.values = lambda keys: asked.extend(keys) or values(keys)
    cache.pieces.make = lambda keys: missed.extend(keys) or make(keys)
    for text in texts:
        assert unpacked(run(text)) == encode(path, text)
    assert len(missed) < 0.2 * len(asked)


def test_long_words_are_not_kept(byte_bpe, word_bpe, encode, monkeypatch):
    monkeypatch.setattr(pretokens, "KEPT_CHARACTERS", 500)
    cache, words = pretokens.PieceCache(byte_bpe, pretokens.id_bytes, 10**6), bpe.Encoder(word_bpe)
    for k in range(40):
        text = f"word{k} " + "Zx9" * (3000 + k) + " " + "ab" * 4000 + f" é’ and other words {k}" * 20
        assert unpacked(b"".join(b"".join(part) for part in cache.values(text))) == encode(byte_bpe, text)
        assert unpacked(words.encode(text)) == encode(word_bpe, text)
    for kept in (cache.pieces, words.pieces):
        assert sum(map(len, kept.kept)) <= 500 and max(map(len, kept.kept)) <= pretokens.LONGEST


@settings(max_examples=100, deadline=None)
@given(words=st.lists(st.sampled_from(["a", "é’s", " ", "  ", "\n", "日本.", "12", "“b ", "\x1c"]), max_size=80), size=st.integers(1, 9))
def test_slices_of_any_text_end_where_pieces_end(byte_bpe, words, size):
    text = " ".join(words)
    cut = pretokens.library_pieces(pretokens.load(byte_bpe))
    parts = list(pretokens.slices(text, size, pretokens.ODD_SEAM))
    assert "".join(parts) == text and [p for part in parts for p in cut(part)] == cut(text)


@settings(max_examples=100, deadline=None)
@given(words=st.lists(st.sampled_from(["a", "b'll", " ", "  ", "\n", "x.", "12", "\t "]), max_size=80), size=st.integers(1, 9))
def test_slices_end_where_pieces_end(byte_bpe, words, size):
    text = " ".join(words)
    cache = pretokens.PieceCache(byte_bpe, len, 50)
    parts = list(pretokens.slices(text, size))
    assert "".join(parts) == text
    assert [p for part in parts for p in cache.cut(part)] == cache.cut(text)


@settings(max_examples=200, deadline=None)
@given(text=MIXED, cuts=st.lists(st.integers(0, 60), max_size=6))
def test_repaired_joins_give_the_ids_of_the_whole(word_bpe, encode, text, cuts):
    encoder = bpe.Encoder(word_bpe)
    ends = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    parts = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    ids = bpe.joined(parts, [encoder.encode(p) for p in parts], encoder.encode)
    assert unpacked(ids) == encode(word_bpe, text) == unpacked(encoder.encode(text))


def test_chunks_resist_shifts():
    passage = "".join(f"Line {k} of a passage {k * k}. " for k in range(2000)).encode()
    first, second = bpe.chunks(b"Short. " + passage), bpe.chunks(b"Another, longer start. " * 40 + passage)
    assert b"".join(first) == b"Short. " + passage
    assert len(set(first) & set(second)) > len(first) / 2
    whole = "日本語のテスト。" * 4000
    assert "".join(c.decode() for c in bpe.chunks(whole.encode())) == whole
    assert bpe.chunks(b"") == [b""]


def test_chunks_do_not_depend_on_the_slab(monkeypatch):
    data = b"".join(b"%d words; " % (k * 7919) for k in range(9000))
    want = bpe.chunks(data)
    monkeypatch.setattr(bpe, "_SLAB", 5000)
    assert bpe.chunks(data) == want


def key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_counts_of_odd_rows(texts, byte_bpe, encode, rows):
    got = token_counts(texts(rows), byte_bpe, limit=100)
    want = [(i, len((t or "").encode()), len(encode(byte_bpe, t)), len(encode(byte_bpe, t)) > 100) for i, t in rows]
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=key)


def test_counts_are_the_same_without_a_table(small, byte_bpe, encode):
    rows, df = small
    want = sorted((i, len(encode(byte_bpe, t))) for i, t in rows)
    for size in (1, 500):
        assert rows_of(token_counts(df, byte_bpe, table_size=size), "doc_id", "n_tokens") == want
    table = frequent_lengths(df, byte_bpe, table_size=500)
    assert len(table) <= 500 and all(len(encode(byte_bpe, piece)) == n for piece, n in table.items())


@pytest.mark.parametrize("rows", [ODD + [(20 + k, ODD[10][1] + f" end {k}") for k in range(3)], []], ids=["odd", "empty"])
def test_encoding_and_decoding_odd_rows(texts, word_bpe, encode, rows):
    tokenizer = pretokens.load(word_bpe)
    got = [(r.doc_id, unpacked(r.ids), r.decoded) for r in bpe.encode_decode(texts(rows), word_bpe).collect()]
    want = [(i, encode(word_bpe, t), tokenizer.decode(encode(word_bpe, t), skip_special_tokens=False)) for i, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_encoding_documents_with_shared_passages(small, word_bpe, encode):
    rows, df = small
    got = bpe.encode_decode(df, word_bpe)
    assert {r.doc_id: unpacked(r.ids) for r in got.collect()} == {i: encode(word_bpe, t) for i, t in rows}


def test_pieces_of_odd_rows(texts, byte_bpe, encode):
    got = {}
    for r in packing.token_pieces(texts(ODD), byte_bpe, end_id=2, capacity=64).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in ODD:
        if doc_id in (None, 7):
            continue
        ids, pieces = [*encode(byte_bpe, text), 2], sorted(got[doc_id], key=lambda r: r.piece)
        assert [i for p in pieces for i in unpacked(p.ids)] == ids
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert all(p.length == 64 for p in pieces[1:]) and 1 <= pieces[0].length <= 64
        assert all(p.length * 4 == len(p.ids) for p in pieces)
    assert len(got[7]) == 2 * len({p.piece for p in got[7]})
    assert packing.token_pieces(texts([(1, "")]), byte_bpe, end_id=None).count() == 0


def test_every_plain_character_is_classed_as_the_library_does(byte_bpe, word_bpe, encode):
    bytes_, words = pretokens.PieceCache(byte_bpe, pretokens.id_bytes, 10**6), bpe.Encoder(word_bpe)
    for code in range(0x500):
        text = "".join(f"a{chr(code)}{other}1 {chr(code)}{chr(code)} " for other in "b1._ ")
        got = b"".join(b"".join(part) for part in bytes_.values(text)) if bytes_.plain(text) else bytes_.direct(text)
        assert unpacked(got) == encode(byte_bpe, text), code
        assert unpacked(words.encode(text)) == encode(word_bpe, text), code
