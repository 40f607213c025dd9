"""The registered queries over the smallest tables: against SQL, and their digests against brute force."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import duckdb
import pytest

import corpus_pipeline
from casepulse.llm import checks, queries
from tests.llm.test_native import BASE, brute_counts, brute_lines, brute_spans
from tests.llm.test_simhash import brute as brute_simhash
from tests.test_registry import TABLES, normal


@pytest.fixture(scope="module")
def db(testdata):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{testdata}/{name}.parquet'")
    yield connection
    connection.close()


def run(llm, testdata, name):
    return queries.QUERIES[name](llm, testdata)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", checks.oracle_sql())
def test_query_equals_its_check(llm, testdata, db, name):
    df, result = run(llm, testdata, name), db.sql(checks.oracle_sql()[name])
    assert normal(df.columns, df.collect()) == normal(result.columns, result.fetchall())


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_token_counts(llm, testdata, small, byte_bpe, encode):
    df = run(llm, testdata, "op2_token_counts")
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    want = {i: (len(t.encode()), len(encode(byte_bpe, t)), len(encode(byte_bpe, t)) > 1024) for i, t in small[0]}
    assert {r.doc_id: tuple(r)[1:] for r in df.collect()} == want


def test_warc(llm, testdata):
    df = run(llm, testdata, "op3_warc")
    assert [c for c, _ in df.dtypes] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    pages = llm.read.parquet(f"{testdata}/pages.parquet").collect()
    first = {}
    for page in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(page.html, page.page_id)
    got = {r.page_id: r for r in df.collect()}
    assert len(got) == len(pages)
    for page in pages:
        row, own = got[page.page_id], first[page.html] == page.page_id
        assert row.payload_bytes == len((page.html or "").encode())
        assert (row.record_type, row.refers_to) == (("response", None) if own else ("revisit", first[page.html]))


def test_sharding(llm, testdata, small):
    df = run(llm, testdata, "op4_sharding")
    assert dict(df.dtypes)["grown_shard"] == "int" and dict(df.dtypes)["slot"] == "bigint"
    rows = {r.doc_id: r for r in df.collect()}
    assert {i: (r.size, r.text_crc32, r.law, r.grown_shard) for i, r in rows.items()} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t in small[0]
    }
    assert {r.shard for r in rows.values()} == set(range(16))


def test_encoding(llm, testdata, small, word_bpe, encode):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_bpe)
    want = {}
    for i, t in small[0]:
        ids = encode(word_bpe, t)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in run(llm, testdata, "op6_bpe").collect()} == want


def assert_packed(rows, docs, byte_bpe, encode):
    """Pieces are the documents', sequences are full without gaps, and they are few."""
    pieces, sequences, total = {}, {}, 0
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert pieces.keys() == docs.keys()
    for doc_id, own in pieces.items():
        ids, at = [*encode(byte_bpe, docs[doc_id]), 2], 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(packed(ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * total / 1024 + 2


def test_packing(llm, testdata, small, byte_bpe, encode):
    assert_packed(run(llm, testdata, "op7_packing").collect(), dict(small[0]), byte_bpe, encode)


def test_simhash(llm, testdata, small):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in run(llm, testdata, "op8_simhash_dedup").collect())
    assert got == [(i, f"{fp % (1 << 64):016x}", c) for i, fp, c in brute_simhash(small[0])]


def test_quality(llm, testdata, small):
    rows = {r.doc_id: r for r in run(llm, testdata, "op10_quality_rules").collect()}
    for i, t in small[0]:
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed = brute_counts(t)
        assert tuple(rows[i])[:7] == (i, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed)
        assert not (failed and rows[i].kept)


def test_pipeline_stage_by_stage(llm, testdata, small, byte_bpe, encode):
    """Each stage against brute force on what the one before it left."""
    docs, stages = small[1], dict(corpus_pipeline.STAGES)
    judged = {r.doc_id: r.kept for r in run(llm, testdata, "op10_quality_rules").collect()}

    def step(name, docs):
        out = stages[name](llm, docs, testdata)
        path = f"{llm.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        return llm.read.parquet(path), {r.doc_id: r.text for r in out.collect()}

    good, texts = step("quality_rules", docs)
    assert good.columns == docs.columns and texts == {i: t for i, t in small[0] if judged[i]}
    lines, cut = step("line_dedup", good)
    assert lines.columns == docs.columns and cut == {i: t for i, t, _ in brute_lines(list(texts.items()))}
    assert all(r.n_chars == len(r.text) for r in lines.collect() if cut[r.doc_id] != texts[r.doc_id])
    single, left = step("simhash_dedup", lines)
    assert left == {i: cut[i] for i, _, component in brute_simhash(list(cut.items())) if i == component}
    clean, plain = step("pii", single)
    assert clean.columns == docs.columns and not any(map(brute_spans, plain.values()))
    assert all(plain[i] == t for i, t in left.items() if not brute_spans(t)) and BASE
    sequences, _ = step_packed(stages, llm, clean, testdata)
    assert_packed(sequences, plain, byte_bpe, encode)
    shared = llm.conf.get("spark.checkpoint.dir")
    there = set(os.listdir(shared))
    whole = corpus_pipeline.run(llm, testdata)
    # Of all that the stages wrote, only the result stays.
    (made,) = set(os.listdir(shared)) - there
    assert os.listdir(f"{shared}/{made}") == ["packing"]
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in sequences}


def step_packed(stages, llm, docs, testdata):
    out = stages["packing"](llm, docs, testdata)
    return out.collect(), out.columns


def test_pipeline_without_documents(llm, testdata, small):
    docs = small[1].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, testdata)
        assert docs.count() == 0
