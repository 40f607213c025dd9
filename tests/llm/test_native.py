"""The operators of built-in functions: lines, personal data, quality."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casepulse.llm import line_dedup, pii, quality_rules
from tests.conftest import rows_of
from tests.llm.conftest import CLASHING, ODD


def no_python(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# --- lines -------------------------------------------------------------------------------


def plain_chunks(text):
    """The lines, and the first and last line of each chunk."""
    lines = text.split("\n")
    worded = [k for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line)]
    hashes = [int(hashlib.md5(lines[k].encode()).hexdigest()[:12], 16) for k in worded]
    out = []
    for k in range(len(worded) - 1):
        longer = (31 * hashes[k] + hashes[k + 1]) % 3 == 0 and k + 2 < len(worded)
        out.append((worded[k], worded[k + 2 if longer else k + 1]))
    return lines, out


def brute_lines(rows):
    """Documents in order of id; equal rows see what the first of them saw."""
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        if text is None:
            out.append((doc_id, None, 0))
            continue
        gone, (lines, chunks) = set(), plain_chunks(text)
        for no, (first, last) in enumerate(chunks):
            own = (doc_id, text, no)
            if seen.setdefault("\n".join(lines[first:last + 1]), own) != own:
                gone.update(range(first, last + 1))
        out.append((doc_id, "\n".join(line for k, line in enumerate(lines) if k not in gone), len(gone)))
    return sorted(out, key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))


def test_lines_of_odd_rows(texts):
    df = texts(ODD)
    got = line_dedup.line_dedup(df)
    assert rows_of(got, "doc_id", "text", "n_removed") == brute_lines(ODD)
    assert [c for c in got.columns if c not in ("n_chunks", "n_removed")] == [c for c in df.columns if c != "n_lines"] + ["n_lines"]
    assert rows_of(line_dedup.line_dedup(texts([]))) == []


def test_lines_of_documents(small):
    rows, df = small
    got = line_dedup.line_dedup(df)
    assert rows_of(got, "doc_id", "text", "n_removed") == brute_lines(rows)
    assert no_python(got)


def passage_rows(rng, n, pairs, around=10):
    """Pairs of rows that share a passage of ``n`` lines between lines of their own."""
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(14))
    rows, passages = [], {}
    for k in range(pairs):
        passages[k] = {line() for _ in range(n)}
        rows += [
            (2 * k + copy, "\n".join([*(line() for _ in range(around)), *sorted(passages[k]), *(line() for _ in range(around))]))
            for copy in (0, 1)
        ]
    return rows, passages


@pytest.mark.parametrize(("n", "found", "removed"), [(2, 0.5, 0.5), (3, 1, 0.85), (4, 1, 0.85), (6, 1, 0.9), (8, 1, 0.9), (12, 1, 0.95)])
def test_short_passages_go(texts, n, found, removed):
    """In its second place, and nowhere else, whatever stands around it."""
    pairs = 100
    rows, passages = passage_rows(random.Random(n), n, pairs)
    got = {r.doc_id: r for r in line_dedup.line_dedup(texts(rows, clashing=False)).collect()}
    hits = lines = 0
    for k in range(pairs):
        assert got[2 * k].text == rows[2 * k][1] and got[2 * k].n_removed == 0
        left = got[2 * k + 1].text.split("\n")
        assert [x for x in left if x not in passages[k]] == [x for x in rows[2 * k + 1][1].split("\n") if x not in passages[k]]
        hits += got[2 * k + 1].n_removed > 0
        lines += got[2 * k + 1].n_removed
    assert hits >= found * pairs and lines >= removed * n * pairs


def test_a_shared_passage_goes_wherever_it_stands(texts):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(12))
    passage = [line() for _ in range(40)]
    rows = [(k, "\n".join([line() for _ in range(k % 7)] + passage + [line() for _ in range(k % 5)])) for k in range(60)]
    rows += [(100 + k, "\n".join(line() for _ in range(10))) for k in range(20)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(texts(rows, clashing=False)).collect()}
    texts_of = dict(rows)
    assert got[0].text == texts_of[0]
    assert all(got[100 + k].text == texts_of[100 + k] for k in range(20))
    for k in range(1, 60):
        left = [part for part in got[k].text.split("\n") if part in passage]
        assert len(left) <= 1 and len([p for p in got[k].text.split("\n") if p and p not in passage]) == k % 7 + k % 5


def test_empty_lines_are_no_chunk_and_every_line_stays_somewhere(texts):
    rows = [(1, "a\n\n\nb"), (2, "c\n\n\nd"), (3, "x\na\n\n\nb\ny"), (4, "\n\n"), (5, "k\nk\nk\nk")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(texts(rows)).collect()}
    assert got[1] == "a\n\n\nb" and got[2] == "c\n\n\nd" and got[4] == "\n\n"
    assert {*"\n".join(got.values()).split("\n")} == {*"\n".join(t for _, t in rows).split("\n")}
    assert rows_of(line_dedup.line_dedup(texts(rows)), "doc_id", "text", "n_removed") == brute_lines(rows)


# --- personal data -----------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PII = [
    (1, "a@b.com_c@d.com x@y z@q.r."), (2, "1.2.3.4.5.6.7.8 001.02.3.4 256.1.1.1 1.2.3.0256"), (3, "é@x.y 🙂 z@q.r.s +1 (743) 555-3824 +"),
    (4, "+1+2+33333333 4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-"), (5, "\n".join(f"x{k}@y.com" for k in range(700))),
    (6, "GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33"), (7, "social security 123-45-6789"), (8, "part 123-45-6789 of a set"),
    (9, "a" * 150_000 + "@"), (10, "1." * 30_000), (11, "5" * 60_000), (12, "+1" + "(" * 60_000), (13, "a." * 20_000 + "@b" + ".c" * 20_000),
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute_spans(text):
    text = text or ""
    # The plain patterns take too long over these where they cannot match.
    hopeless = {"email": "@" not in text or text.endswith("a@"), "ip": "." not in text}
    return [
        (k, m.start(), m.end()) for k, p in BASE.items() if not hopeless.get(k)
        for m in re.finditer(p, text) if valid(k, m[0])
    ]


@pytest.mark.parametrize("rows", [[r for r in ODD if r[0] is not None], PII, []], ids=["odd", "hard", "empty"])
def test_base_spans(texts, rows):
    found = pii.find_spans(texts(rows))
    got = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE]) for r in found.collect())
    assert got == sorted((i, brute_spans(t)) for i, t in rows)
    assert found.columns == [c for c in texts(rows).columns if c != "spans"] + ["spans"]


def test_spans_of_documents(small):
    rows, df = small
    found = pii.find_spans(df)
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE] for r in found.collect()} == {
        i: brute_spans(t) for i, t in rows
    }
    assert no_python(found) and no_python(pii.redact(df))


def test_checksums_and_context_decide_the_added_kinds(texts):
    found = {r.doc_id: r.spans for r in pii.find_spans(texts(PII)).collect()}
    assert [(s.kind, s.start, s.end) for s in found[6]] == [("iban", 0, 27)]
    assert [(s.kind, s.match) for s in found[7]] == [("ssn", "123-45-6789")] and found[8] == []
    near = {r.doc_id: r.spans for r in pii.find_spans(texts([(1, "mail me: a@b.cd"), (2, "see a@b.cd")])).collect()}
    assert near[1][0].score > near[2][0].score


def test_redaction(texts):
    df = texts(PII + ODD)
    got = pii.redact(df, length_col="n_chars")
    assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    by_id = {r.doc_id: r for r in got.where("source = 's'").collect() if r.doc_id}
    left = {r.doc_id: r.spans for r in pii.find_spans(got).collect() if r.doc_id}
    assert not any(left.values())
    odd = dict(ODD)
    assert all(by_id[i].text == odd[i] for i in (8, 9) if i not in dict(PII))
    clean = {r.doc_id: r.text for r in pii.redact(texts(ODD)).collect() if r.doc_id}
    assert clean == {i: t for i, t in ODD if i}
    assert {c: by_id[3][c] for c in CLASHING if c != "spans"}["hash"] == "x"
    three = {r.doc_id: r for r in pii.redact(texts(PII), length_col="n_chars").collect()}[3]
    assert three.text == "é@x.y 🙂 [EMAIL] [PHONE] +" and three.n_chars == len(three.text)


# --- quality -----------------------------------------------------------------------------


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_statistics(texts, small):
    for rows, df in ((ODD, texts(ODD)), small, ([], texts([]))):
        got = quality_rules.text_statistics(df)
        want = sorted(((i, *brute_counts(t)) for i, t in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
        assert rows_of(got, "doc_id", *NUMBERS) == want
        assert no_python(got)


def labelled(llm, texts, n=600):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + ("###" if bad else "") for _ in range(80)]
        rows.append((k, " ".join(words) + "."))
        labels.append((k, int(not bad)))
    return texts(rows), llm.createDataFrame(labels, "doc_id long, quality int")


def test_rules_are_learned_and_decide(llm, texts):
    docs, labels = labelled(llm, texts)
    judged, rules = quality_rules.quality_rules(docs, labels)
    assert len(rules) >= 1 and all(1 <= len(rule) <= quality_rules.CONDITIONS for rule in rules)
    got = {r.doc_id: r.kept for r in judged.collect()}
    assert got == {r.doc_id: bool(r.quality) for r in labels.collect()}
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert no_python(judged) and no_python(kept)


@pytest.mark.parametrize("change", ["none", "one kind", "null labels"])
def test_without_lessons_only_the_base_rules_hold(llm, texts, change):
    docs, labels = labelled(llm, texts, 100)
    labels = {
        "none": labels.limit(0), "one kind": labels.where("quality = 1"),
        "null labels": labels.select("doc_id", F.lit(None).cast("int").alias("quality")),
    }[change]
    judged, rules = quality_rules.quality_rules(docs, labels)
    assert rules == [] and judged.where("kept = base_failed").count() == 0


def test_verdict_is_an_ordered_list(llm):
    rules = [(quality_rules.Condition("a", True, 2.0),), (quality_rules.Condition("a", False, 1.0), quality_rules.Condition("b", True, 5.0))]
    rows = llm.createDataFrame([(0.0, 9.0), (0.0, 1.0), (1.5, 9.0), (3.0, 0.0)], "a double, b double")
    assert [r[0] for r in rows.select(quality_rules.verdict(rules)).collect()] == [False, True, True, False]
    assert quality_rules.verdict([])._jc.toString() == "true"
