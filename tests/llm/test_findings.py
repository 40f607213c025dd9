"""Cases that earlier forms of the training-data operators lost."""

from __future__ import annotations

import random
import re

import pytest

from casepulse.llm import pii, sharding
from tests.llm.test_sharding import best_capacity


def spans_of(df):
    return {r.doc_id: [(s.kind, s.match) for s in r.spans] for r in pii.find_spans(df).collect()}


# --- personal data -----------------------------------------------------------------------

DE, GB = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"


@pytest.mark.parametrize(("text", "accounts"), [
    ("DE89370400440532013000 Please pay", ["DE89370400440532013000"]),
    (f"{DE} BIC COBADEFFXXX", [DE]),
    ("GB82WEST12345698765432 12 March", ["GB82WEST12345698765432"]),
    (f"{GB} {DE} A", [GB, DE]),
    (f"REF AB12 {DE} 1", [DE]),
    (f"{DE}X", []),
])
def test_an_account_number_ends_with_its_country_s_length(texts, text, accounts):
    df = texts([(1, text)], clashing=False)
    assert spans_of(df)[1] == [("iban", account) for account in accounts]
    for account in accounts:
        text = text.replace(account, "[IBAN]")
    assert pii.redact(df).first().text == text


def test_each_country_has_one_length():
    countries = [c for group in pii.LENGTHS.values() for c in group.split("|")]
    assert len(countries) == len(set(countries)) and all(len(c) == 2 for c in countries)


def test_a_context_word_counts_for_each_number_of_a_list(texts):
    rows = [(1, "SSN: 123-45-6789, 987-65-4321"), (2, "123-45-6789, 987-65-4321 (social)"), (3, "123-45-6789, 987-65-4321")]
    df = texts(rows, clashing=False)
    both = [("ssn", "123-45-6789"), ("ssn", "987-65-4321")]
    assert spans_of(df) == {1: both, 2: both, 3: []}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "SSN: [SSN], [SSN]", 2: "[SSN], [SSN] (social)", 3: rows[2][1]}


def test_the_code_that_carries_rows_on_is_small(texts):
    """Whatever the number of kinds: with columns for each of them, the longest method had 7,500 bytes."""
    found = pii.find_spans(texts([(1, f"write to a@b.org, {DE}"), (2, None)], clashing=False))
    code = found._jdf.queryExecution().debug().codegenToSeq()
    assert code.size() and max(code.apply(k)._3().maxMethodCodeSize() for k in range(code.size())) < 4000


def test_scores_are_those_of_the_characters_around(texts):
    rng = random.Random(3)
    parts = ["card ", "tel. ", "ssn ", "x ", "é🙂, ", "12 34x", "+1 2 ", "4111 1111 1111 1111, ", "+1 (743) 555-3824; ", "123-45-6789, ", "a@b.cd "]
    rows = [(k, "".join(rng.choices(parts, k=40))) for k in range(60)]
    found = {r.doc_id: r.spans for r in pii.find_spans(texts(rows, clashing=False)).collect()}
    assert sum(map(len, found.values())) > 100
    for k, text in rows:
        want = []
        for kind in pii.KINDS:
            near = re.compile(rf"(?i)\b(?:{kind.context})", re.ASCII)
            for s in (s for s in found[k] if s.kind == kind.name):
                around = text[max(0, s.start - pii.NEAR):s.start], text[s.end:s.end + pii.NEAR]
                want.append((s.kind, s.start, round(kind.score + pii.BONUS * any(map(near.search, around)), 6)))
        assert [(s.kind, s.start, round(s.score, 6)) for s in found[k]] == want


# --- shards ------------------------------------------------------------------------------


def shard_sizes(llm, sizes, shards=16):
    step = (1 << 64) // len(sizes)
    groups = [(k * step - (1 << 63), size) for k, size in enumerate(sizes)]
    cuts = sharding.cut_hashes(llm.createDataFrame(groups, "hash long, size long"), shards)
    out = [0] * shards
    for hash_, size in groups:
        out[sum(hash_ > cut for cut in cuts)] += size
    assert max(out) == best_capacity(sizes, shards)
    return out


@pytest.mark.parametrize(("share", "at"), [(0.1, 0.5), (1 / 3, 0.3), (1 / 3, 0)])
def test_a_large_group_leaves_the_other_shards_even(llm, share, at):
    rng = random.Random(9)
    sizes = [rng.randint(50, 150) for _ in range(6000)]
    large = int(sum(sizes) * share / (1 - share))
    sizes.insert(int(at * len(sizes)), large)
    out = sorted(shard_sizes(llm, sizes))
    even = (sum(sizes) - large) / 15
    assert out[-1] == large and 0.8 * even < out[0] and out[-2] < 1.2 * even


def test_few_groups_leave_no_shard_empty(llm):
    assert sorted(shard_sizes(llm, [10] * 50)) == [30] * 14 + [40] * 2


def test_asking_for_sums_makes_no_more_rows_than_there_are(llm, monkeypatch):
    """Every running sum is in one span and one bucket, also where the spans of several shards overlap."""
    frames, ask = [], sharding.ask

    def watched(running, sums, spans, steps):
        spans = list(spans)
        frames.append((running, spans))
        return ask(running, sums, spans, steps)

    monkeypatch.setattr(sharding, "ask", watched)
    monkeypatch.setattr(sharding, "RANGE_BITS", 3)
    sizes = [7] * 900 + [3_000] + [5] * 900
    shard_sizes(llm, sizes)
    assert frames and "posexplode" not in frames[0][0]._jdf.queryExecution().toString()
    learned = sharding.Sums([0, sum(sizes)])
    ask(llm.createDataFrame([(10,), (20,), (30,)], "upto long"), learned, [(0, 25), (5, 22), (8, 40)], 4)
    assert learned.known == [0, 10, 20, 30, sum(sizes)]
