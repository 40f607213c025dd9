from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from casepulse.llm.common import join_groups
from casepulse.llm.exact_dedup import exact_dedup
from tests.conftest import rows_of
from tests.llm.conftest import ODD

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))


def test_odd_rows(texts):
    assert rows_of(exact_dedup(texts(ODD)), *COLUMNS) == brute(ODD)


def test_empty_table(texts):
    assert rows_of(exact_dedup(texts([]))) == []


def test_documents(small):
    rows, df = small
    assert rows_of(exact_dedup(df), *COLUMNS) == brute(rows)


def test_texts_with_one_hash_stay_apart(texts):
    rows = [(k, f"text {k % 3}") for k in range(30)]
    same = exact_dedup(texts(rows), digest=lambda text: F.lit(b"one"))
    assert rows_of(same, *COLUMNS) == brute(rows)


def test_hot_groups_are_spread(llm):
    rows = llm.range(5000).select("id", F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    joined = join_groups(rows, groups, ["k"], size="n", spread=["id"])
    assert joined.count() == 5000 and joined.where("n = 4000").count() == 4000
    assert sorted(joined.columns) == ["first", "id", "k", "n"]
