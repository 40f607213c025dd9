"""Quality rules: text statistics, and a decision list learned from labels by sequential covering.

All of it is DataFrame expressions and aggregates; only counts by feature and bin, bounded by
``BINS``, come to the driver while a list is learned.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.llm.common import SPACE, settled, whole
from casepulse.sources.writers import stage

#: The base rules.
SYMBOLS, MIN_WORDS, MAX_REPEATED = "#*$%&|<>", 50, 50
#: Candidate thresholds per feature, conditions per rule.
BINS, CONDITIONS = 32, 3
#: Share of rejected rows that must be bad, on rows that did not grow the rule, and the least bad rows.
PRECISION, SUPPORT = 0.95, 5
#: What the learner may test, from the statistics below.
FEATURES = (
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
    "digit_share", "mark_share", "words_per_line", "end_share",
)


def _lacking(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def text_statistics(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """One row of numbers per row of ``docs``: doc_id, the base counts, base_failed, the features.

    n_words: words; word_chars: code points in words; n_symbols: characters of ``SYMBOLS``;
    n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in windows of
    three words that the text has twice or more. Windows are compared by 64-bit hashes inside one
    text. Work per text grows as n log n (one sort); nothing is shuffled. A NULL text is empty. With
    ``carry`` the whole input row comes along in the struct ``_row``.
    """
    text, row = F.col("_text"), ["_row"] if carry else []
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text"),
        *([F.struct("*").alias("_row")] if carry else []),
    )
    rows = rows.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))))
    rows = rows.withColumn(
        "_windows",
        F.when(F.size("_words") < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("_words") - 3, F.lit(0))),
            lambda i: F.struct(
                F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"),
                i.cast("int").alias("i"),
            ),
        ))),
    )
    # Windows whose hash is also a neighbour's in hash order, back in text order.
    rows = rows.withColumn("_repeated", F.sort_array(F.filter(F.transform(
        "_windows",
        lambda w, k: F.when(
            (F.get("_windows", k - 1)["h"] == w["h"]) | (F.get("_windows", k + 1)["h"] == w["h"]), w["i"]
        ),
    ), lambda i: i.isNotNull())))
    counts = rows.select(
        *row, "doc_id", "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _lacking(text, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(
            F.transform("_repeated", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_repeated", k + 1) - i, F.lit(3)))),
            F.lit(0).cast("long"), lambda total, n: total + n,
        ).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.size(F.filter("_lines", lambda line: F.regexp_like(line, F.lit(r"[.!?\"”»)]\s*$")))).cast("long").alias("_ended"),
    )
    words, characters = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("_n_lines", F.lit(1))
    return settled(counts.select(
        *row, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / characters).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / characters).alias("upper_share"),
        (_lacking(text, "0123456789") / characters).alias("digit_share"),
        (_lacking(text, ".,;:!?") / words).alias("mark_share"),
        (F.col("n_words") / lines).alias("words_per_line"),
        (F.col("_ended") / lines).alias("end_share"),
    ))


@dataclass(frozen=True)
class Condition:
    """``feature`` at least (or below) ``threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: Sequence[Rule]) -> Column:
    """The list as one ordered expression: the first rule that holds rejects, else the row is kept."""
    if not rules:
        return F.lit(True)
    out = F.when(covers(rules[0]), F.lit(False))
    for rule in rules[1:]:
        out = out.when(covers(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def _bins(rows: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Thresholds per feature: the quantiles and ends of its values, among bad and among all rows."""
    share = [k / BINS for k in range(BINS + 1)]
    found = rows.agg(
        *(F.percentile_approx(f, share, 2000).alias(f) for f in features),
        *(F.percentile_approx(F.when(F.col("bad"), F.col(f)), share, 2000).alias(f"bad_{f}") for f in features),
    ).first()
    return {f: sorted({*(found[f] or ()), *(found[f"bad_{f}"] or ())}) for f in features}


def _bin(value: Column, thresholds: Sequence[float]) -> Column:
    """How many of the thresholds the value reaches."""
    return F.size(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: t <= value))


#: Bad and good rows by feature and bin.
Counts = dict[str, dict[int, tuple[int, int]]]


def _counted(rows: DataFrame, bins: dict[str, list[float]], rule: Rule) -> Counts:
    """The growing rows that the rule covers: one aggregate of two rows, bad and good, with a histogram for each feature.

    A histogram with room for every bin merges none, so its counts are exact, and no row is multiplied. Where parts
    of one bin are merged, its place may be off by a rounding, and it may come in several parts.
    """
    features = [f for f in bins if bins[f]]
    counts: Counts = {f: {} for f in features}
    if not features:
        return counts
    found = rows.where(covers(rule)).where("grow").groupBy("bad").agg(*(
        F.histogram_numeric(F.col(f"bin_{f}").cast("double"), F.lit(len(bins[f]) + 2)).alias(f"of_{f}") for f in features
    )).collect()
    for row in found:
        for f in features:
            for place in row[f"of_{f}"]:
                k, n = round(place.x), round(place.y)
                bad, good = counts[f].get(k, (0, 0))
                counts[f][k] = (bad + n, good) if row.bad else (bad, good + n)
    return counts


def _best(
    counts: Counts, bins: dict[str, list[float]], without: Collection[tuple[str, bool]] = ()
) -> Condition | None:
    """The condition with the highest information gain; ``without`` names features, each with a side, that are not tested."""
    best, best_gain = None, 0.0
    for f in counts:
        all_bad = sum(b for b, _ in counts[f].values())
        all_good = sum(g for _, g in counts[f].values())
        if not all_bad or not all_good:
            return None
        before = log2(all_bad / (all_bad + all_good))
        for k, threshold in enumerate(bins[f]):
            above = [counts[f][b] for b in counts[f] if b > k]
            bad, good = (sum(c[n] for c in above) for n in (0, 1))
            for at_least, b, g in ((True, bad, good), (False, all_bad - bad, all_good - good)):
                if (f, at_least) in without:
                    continue
                gain = b * (log2(b / (b + g)) - before) if b else 0.0
                if gain > best_gain + 1e-9:
                    best, best_gain = Condition(f, at_least, float(threshold)), gain
    return best


def _held_bad(rows: DataFrame, rule: Rule) -> int:
    """Bad rows under the rule among those that did not grow it; further conditions leave no more."""
    return rows.where("bad and not grow").where(covers(rule)).count()


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The shortest start of the rule that is best on the rows it was not grown on, and its bad and good rows there."""
    starts = [rule[:k] for k in range(1, len(rule) + 1)]
    held = rows.where("not grow")
    found = held.agg(*(
        F.count_if(covers(s) & (F.col("bad") if bad else ~F.col("bad"))).alias(f"{bad}_{k}")
        for k, s in enumerate(starts) for bad in (True, False)
    )).first()
    scored = [((found[f"True_{k}"] - found[f"False_{k}"]) / max(1, found[f"True_{k}"] + found[f"False_{k}"]), -k) for k in range(len(starts))]
    k = -max(scored)[1]
    return starts[k], found[f"True_{k}"], found[f"False_{k}"]


def learn_rules(
    statistics: DataFrame, labels: DataFrame, *, features: Sequence[str] = FEATURES, id_col: str = "doc_id",
    label_col: str = "quality", conditions: int = CONDITIONS,
    precision: float = PRECISION, support: int = SUPPORT,
) -> list[Rule]:
    """A decision list that rejects rows like those labelled 0, from all labelled rows that pass the base rules.

    Sequential covering: a rule grows by the condition with the most information gain on two thirds
    of the rows (by the hash of the id), is pruned on the rest, and is accepted if there at least
    ``precision`` of what it rejects is bad and it has ``support`` bad rows; its rows then leave. After a rule that
    is refused the next one begins with another feature or its other side, until all have been refused in turn or
    fewer than ``support`` bad rows are left to accept a rule; there may be any number of rules.
    Without labels of both kinds the list is empty.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("_label")).where(
        "_label is not null and doc_id is not null"
    ).groupBy("doc_id").agg((F.max("_label") == 0).alias("bad"))
    rows = statistics.where(~F.col("base_failed")).select("doc_id", *features).join(own, "doc_id").withColumn(
        "grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    )
    rows = stage(statistics.sparkSession, rows, "labelled")
    bins, found = _bins(rows, features), []
    left = stage(statistics.sparkSession, rows.withColumns({f"bin_{f}": _bin(F.col(f), bins[f]) for f in features}), "binned")
    while _held_bad(left, ()) >= support:
        rule: Rule = ()
        refused: set[tuple[str, bool]] = set()
        counts = _counted(left, bins, ())
        while not rule and (first := _best(counts, bins, refused)):
            rule = (first,)
            # A rule with too few bad rows is refused however it goes on.
            if _held_bad(left, rule) >= support:
                while len(rule) < conditions and (condition := _best(_counted(left, bins, rule), bins)):
                    rule += (condition,)
            rule, bad, good = _prune(left, rule)
            if bad < support or bad < precision * (bad + good):
                refused.add((first.feature, first.at_least))
                rule = ()
        if not rule:
            break
        found.append(rule)
        left = left.where(~covers(rule))
    return found


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **learn: object
) -> tuple[DataFrame, list[Rule]]:
    """The statistics of every row with ``kept``, and the list that decided it.

    kept is false where base_failed, else what the list says. Statistics are computed once and
    stored. Repeated rows are decided alike; rows without an id have statistics but teach nothing;
    other columns are ignored; empty tables give an empty result or list.
    """
    statistics = stage(docs.sparkSession, text_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    rules = learn_rules(statistics, labels, **learn)
    return statistics.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows are stored with their statistics, which are so computed once and move no text; the list is learned
    from the labelled rows' numbers, and then decides the stored rows.
    """
    rows = stage(docs.sparkSession, text_statistics(docs, id_col=id_col, text_col=text_col, carry=True), "statistics")
    rules = learn_rules(rows, labels)
    return rows.where(~F.col("base_failed") & verdict(rules)).select("_row.*")
