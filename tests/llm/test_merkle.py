"""The Merkle manifest against a plain tree in Python."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from casepulse.llm.merkle import merkle_manifest

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
CLASHING = ("tree", "pos", "leaf", "at", "_id", "name", "other", "id", "n", "block", "lefts", "root")


def joined_hash(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return joined_hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))


def tree(nodes):
    """The top, and each node's siblings by level."""
    paths, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for k in run:
                for i in under[k]:
                    paths[i].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        nodes, under = [joined_hash(nodes[j] for j in run) for run in runs], [[i for j in run for i in under[j]] for run in runs]
    return nodes[0], paths


def tampered(row):
    return row[4] and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, leaf(row, row[4])))
    if not groups:
        return []
    trees = []
    for name in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[name], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, *tree([h for _, h in own])))
    root, above = tree([top for _, top, _ in trees])
    out = []
    for (own, top, paths), outer in zip(trees, above, strict=True):
        for (row, h), path in zip(own, paths, strict=True):
            node = leaf(row, row[4].translate(str.maketrans(UPPER, UPPER.lower()))) if tampered(row) else h
            for left, right in path + outer:
                node = joined_hash([*left, node, *right])
            proof = joined_hash(x for left, right in path + outer for x in left + right)
            out.append((row[0], h, top, root, proof, node, node == root))
    return ordered(out)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


def manifest(docs, **options):
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    return merkle_manifest(docs, columns=COLUMNS, presented={"text": lowered}, **options)


def frame(llm, rows, clashing=True):
    df = llm.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({name: F.lit(1) for name in CLASHING}) if clashing else df


ODD = [
    (1, None, "en", 3, "Abc"), (1, None, "en", 3, "Abc"), (None, None, None, None, None), (2, "", "x", 0, ""),
    (5, "é", "x", 1, "TEXT"), (6, "z", "x", 1, None), (7, "z", "x", 1, "L" * 300_000),
]


@pytest.mark.parametrize("rows", [
    ODD[:1], [], [(i, "s", "l", 1, f"T{i}") for i in range(700)] + [(k % 3, "k", "l", 1, "Same") for k in range(400)] + ODD,
    [(i, f"s{i}", "l", 1, f"T{i}") for i in range(300)],
])
def test_against_plain_trees(llm, rows):
    assert ordered(r[:7] for r in manifest(frame(llm, rows)).collect()) == brute(rows)


def test_sizes_around_full_levels(llm):
    rows = [(i, f"of {n}", "l", 1, f"T{i}") for n in (1, 15, 16, 17, 255, 256, 257, 4096, 4097) for i in range(n)]
    assert ordered(manifest(frame(llm, rows, False), proofs=False).collect()) == brute(rows)


def test_proofs_lead_to_the_root(llm):
    rows = [(i, f"s{i % 20}" if i % 3 else "hot", "l", 1, f"T{i}") for i in range(900)]
    for r in merkle_manifest(frame(llm, rows), columns=COLUMNS).collect():
        node = r.leaf
        for left, right in zip(r.lefts, r.rights, strict=True):
            node = joined_hash([left, node, right])
        assert node == r.root == r.folded_root and r.verified


def test_documents(llm, small):
    rows = [tuple(r) for r in small[1].select(*COLUMNS).collect()]
    assert ordered(manifest(small[1], proofs=False).collect()) == brute(rows)
    assert {r[-1] for r in brute(rows)} == {True, False}
