"""The learned list against sequential covering in plain Python."""

from __future__ import annotations

import random
from dataclasses import astuple
from math import log2

import pytest
from pyspark.sql import functions as F

from casepulse.llm import quality_rules
from casepulse.llm.quality_rules import CONDITIONS, PRECISION, SUPPORT, learn_rules, verdict

FEATURES = ("a", "b", "c", "d")


def holds(rule, row):
    return all((row[f] >= t) == at_least for f, at_least, t in rule)


def brute(rows, bins):
    """Rows have the features, bad and grow."""
    def best(rows, without=()):
        found, most = None, 0.0
        bad, good = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not bad or not good:
            return None
        for f in FEATURES:
            for t in bins[f]:
                for at_least in (True, False):
                    own = [r for r in rows if (r[f] >= t) == at_least]
                    b = sum(r["bad"] for r in own)
                    gain = b * (log2(b / len(own)) - log2(bad / (bad + good))) if b else 0.0
                    if (f, at_least) not in without and gain > most + 1e-9:
                        found, most = (f, at_least, t), gain
        return found

    found, left = [], rows
    while sum(r["bad"] and not r["grow"] for r in left) >= SUPPORT:
        refused, accepted = set(), None
        growing, held = [r for r in left if r["grow"]], [r for r in left if not r["grow"]]
        while accepted is None and (first := best(growing, refused)):
            rule = [first]
            while len(rule) < CONDITIONS and (more := best([r for r in growing if holds(rule, r)])):
                rule.append(more)

            def score(k, rule=rule):
                own = [r["bad"] for r in held if holds(rule[:k], r)]
                return (2 * sum(own) - len(own)) / max(1, len(own)), -k

            rule = rule[:-max(score(k) for k in range(1, len(rule) + 1))[1]]
            own = [r["bad"] for r in held if holds(rule, r)]
            if sum(own) >= SUPPORT and sum(own) >= PRECISION * len(own):
                accepted = rule
            else:
                refused.add(first[:2])
        if accepted is None:
            break
        found.append(accepted)
        left = [r for r in left if not holds(accepted, r)]
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_the_list_is_that_of_plain_covering(llm, seed, monkeypatch):
    """Several kinds of bad rows, and some that no rule explains."""
    monkeypatch.setattr(quality_rules, "BINS", 8)
    rng = random.Random(seed)
    made, labels = [], []
    for i in range(1500):
        row = [rng.choice(range(40)) / 2 for _ in FEATURES]
        bad = row[0] >= 17.5 or row[1] < 1.5 or row[2] >= 18 or (row[0] < 5 and row[3] >= 15) or rng.random() < 0.005
        made.append((i, False, *map(float, row)))
        labels.append((i, int(not bad)))
    statistics = llm.createDataFrame(made, "doc_id long, base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES))
    joined = statistics.join(llm.createDataFrame(labels, "doc_id long, quality int"), "doc_id").withColumns(
        {"bad": F.col("quality") == 0, "grow": F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0}
    )
    rows = [r.asDict() for r in joined.collect()]
    want = brute(rows, quality_rules._bins(joined, FEATURES))
    got = learn_rules(statistics, llm.createDataFrame(labels, "doc_id long, quality int"), features=FEATURES)
    assert [[astuple(c) for c in rule] for rule in got] == want and len(want) > 1
    kept = {r.doc_id: r.kept for r in statistics.select("doc_id", verdict(got).alias("kept")).collect()}
    assert kept == {r["doc_id"]: not any(holds(rule, r) for rule in want) for r in rows}


def test_a_refused_rule_does_not_end_the_search(llm):
    """Feature a has the highest gain and is not precise; feature b is, on fewer rows."""
    rows = [(i, False, float(i % 4 == 0), float(i % 40 == 1), 0.0, 0.0) for i in range(4000)]
    labels = [(i, int(not (i % 40 == 1 or (i % 4 == 0 and i % 5 < 3)))) for i in range(4000)]
    statistics = llm.createDataFrame(rows, "doc_id long, base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES))
    got = learn_rules(statistics, llm.createDataFrame(labels, "doc_id long, quality int"), features=FEATURES)
    assert any(condition.feature == "b" for rule in got for condition in rule)


def test_counts_by_bin_are_exact(llm):
    """As many bins as the learner may make, unevenly filled, over many partitions."""
    n = 2 * quality_rules.BINS + 2
    rows = [(i, i % n if i % 3 else i * i % n, i * i % 7 == 1, i % 5 > 0, float(i % 2)) for i in range(6000)]
    df = llm.createDataFrame(rows, "doc_id long, bin_a int, bad boolean, grow boolean, b double").repartition(13)
    rule = (quality_rules.Condition("b", True, 0.5),)
    want: dict = {}
    for _, place, bad, grow, b in rows:
        if grow and b >= 0.5:
            x, y = want.get(place, (0, 0))
            want[place] = (x + bad, y + (not bad))
    assert quality_rules._counted(df, {"a": [float(k) for k in range(n)], "c": []}, rule) == {"a": want}
