"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Built-in functions only. The matches of a pattern and the gaps between them, which are what a split
by the pattern leaves, have running lengths that give each match's place. The patterns are possessive
and start only where a run of their characters starts, so a text takes time in proportion to its
length; no match spans a line break.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.llm.common import settled, whole

#: Characters around a match in which context words count, what a word adds, and the least score of a span.
NEAR, BONUS, LEAST = 40, 0.3, 0.5
#: No pattern matches fewer characters.
SHORTEST = 2
#: Elements of an array that one running sum goes over; longer arrays are summed block by block.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``hint`` is a cheap pattern that a text with a match always has. ``base`` kinds are spans
    whenever the check holds; the others need a score of ``LEAST``.
    """

    name: str
    hint: str
    pattern: str
    score: float
    context: str
    base: bool = True


#: Countries by the characters of their account numbers: the IBAN registry, and those that use the form without being in it.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "AO|CV|GW|LY|MZ|PT|ST", 26: "DZ|IR|IS|TR", 27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
    28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
#: An account number of its country's length; and any other run, which ends before such a number.
_LISTED = "(?:" + "|".join(
    rf"(?:{countries})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{length - 4}}}" for length, countries in LENGTHS.items()
) + ")(?![A-Za-z0-9])"
_RUN = rf"[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\x20(?!{_LISTED})[A-Z0-9]){{11,30}}+(?![A-Za-z0-9])"
#: The patterns of the base kinds, here without backtracking.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|pay|amex"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", rf"(?<![A-Za-z0-9])(?:{_LISTED}|{_RUN})", 0.6, "iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security", base=False),
)
BY_NAME = {kind.name: kind for kind in KINDS}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number in capitals and digits passes the mod-97 check."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda total, c: F.when(c <= "9", (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    """Whether what the pattern of ``kind`` matched is valid."""
    digits = F.length(_digits(match))
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
        return F.regexp_like(match, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.when(digits.between(16, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return digits.between(8, 15)
    if kind == "iban":
        account = F.regexp_replace(match, " ", "")
        return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(F.lit(False))
    return F.lit(True)


SPANS = "array<struct<kind:string,start:int,end:int,score:double,match:string>>"


def _sums(numbers: Column) -> Column:
    """The sums of what stands before each number of an array, block by block, so about linear."""
    def step(state: Column, n: Column) -> Column:
        return F.struct((state["at"] + n).alias("at"), F.concat(state["sums"], F.array(state["at"])).alias("sums"))

    def block(state: Column, first: Column) -> Column:
        inner = F.aggregate(
            F.slice(numbers, first, F.lit(BLOCK)),
            F.struct(state["at"].alias("at"), F.array().cast("array<int>").alias("sums")), step,
        )
        return F.struct(inner["at"].alias("at"), F.concat(state["sums"], F.array(inner["sums"])).alias("sums"))

    blocks = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(BLOCK))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("sums"))
    return F.flatten(F.aggregate(blocks, start, block)["sums"])


def _matches(rows: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """``rows`` with found: for each kind its matches (m) in the column text and the gaps around them (g), NULL without a match.

    One column for all kinds: the code that Spark generates to carry rows on, and the memory that
    compiling it takes, grow with the columns, and do so again with each step.
    """
    text = F.col("text")
    rows = settled(rows.withColumn("found", F.array(*(F.when(
        F.regexp_like(text, F.lit(k.hint)), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    ) for k in kinds))))

    def parts(place: int, kind: Kind) -> Column:
        matches = F.get("found", F.lit(place))
        return F.when(F.size(matches) > 0, F.struct(matches.alias("m"), F.split(text, kind.pattern, -1).alias("g")))

    return settled(rows.withColumn("found", F.array(*(parts(place, kind) for place, kind in enumerate(kinds)))))


def _found(rows: DataFrame, fields: Sequence[str], build: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``rows`` with what ``build`` makes of the fields of a kind, beside those named in ``fields``."""
    def each(part: Column) -> Column:
        made = {name: part[name] for name in fields} | build(part)
        return F.when(part.isNotNull(), F.struct(*(column.alias(name) for name, column in made.items())))

    return settled(rows.withColumn("found", F.transform("found", each)))


def _around(rows: DataFrame) -> DataFrame:
    """``rows`` with b and a: the ``NEAR`` characters before and after each match.

    They may go over neighbouring matches. Each is put together from as many gaps and matches as
    ``NEAR`` characters can hold, so a text takes time in proportion to its length.
    """
    none = F.lit("")

    def ends(part: Column) -> dict[str, Column]:
        gaps, matches = part["g"], part["m"]
        return {
            "b": F.transform(matches, lambda m, i: F.right(F.concat(F.get(gaps, i), m), F.lit(NEAR))),
            "a": F.transform(matches, lambda m, i: F.left(F.concat(m, F.coalesce(F.get(gaps, i + 1), none)), F.lit(NEAR))),
        }

    def joined(part: Column) -> dict[str, Column]:
        gaps, before, after = part["g"], part["b"], part["a"]
        count = NEAR // SHORTEST

        def of(pieces: Column, place: Column) -> Column:
            return F.coalesce(F.get(pieces, place), none)

        return {
            "b": F.transform(before, lambda _, i: F.right(
                F.concat(*(of(before, i - k) for k in range(count, 0, -1)), F.get(gaps, i)), F.lit(NEAR)
            )),
            "a": F.transform(after, lambda _, i: F.left(
                F.concat(of(gaps, i + 1), *(of(after, i + k) for k in range(1, count + 1))), F.lit(NEAR)
            )),
        }

    return _found(_found(rows, "mg", ends), "mg", joined)


def _score(kind: Kind, part: Column, i: Column) -> Column:
    """The score of match i: that of its kind, more with a context word in the characters around it."""
    words = F.lit(rf"(?i)\b(?:{kind.context})")
    near = F.regexp_like(F.get(part["b"], i), words) | F.regexp_like(F.get(part["a"], i), words)
    return F.lit(kind.score) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))


def _taken(kind: Kind, match: Column, score: Column) -> Column:
    valid = confirmed(kind.name, match)
    return valid if kind.base else valid & (score >= LEAST)


def find_spans(docs: DataFrame, *, text_col: str = "text", as_col: str = "spans") -> DataFrame:
    """``docs`` with ``as_col``: an array of kind, start, end (code points, end exclusive), score and match.

    By kind as listed in ``KINDS``, then by start. Matches that fail their check are dropped, and
    spans of the kinds that are not base ones where the score is below ``LEAST``. A NULL text is
    empty. All columns of ``docs`` stay; one already named ``as_col`` is replaced. No shuffle.
    """
    rows = _matches(docs.select(F.struct("*").alias("row"), whole(text_col).alias("text")), KINDS)
    rows = _around(rows.select("row", "found"))
    rows = _found(rows, "mgba", lambda part: {
        "d": F.zip_with(part["g"], part["m"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    })
    rows = _found(rows, "mgba", lambda part: {"s": _sums(part["d"])})

    def spans(place: int, kind: Kind) -> Column:
        part = F.get("found", F.lit(place))

        def span(match: Column, i: Column) -> Column:
            start = F.get(part["s"], i) + F.length(F.get(part["g"], i))
            return F.struct(
                F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"),
                _score(kind, part, i).alias("score"), match.alias("match"),
            )

        taken = F.filter(F.transform(part["m"], span), lambda s: _taken(kind, s["match"], s["score"]))
        return F.when(part.isNotNull(), taken).otherwise(F.array().cast(SPANS))

    rows = settled(rows.select("row", F.concat(*(spans(*place) for place in enumerate(KINDS))).alias("spans")))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != as_col]
    return rows.select(*kept, F.col("spans").alias(as_col))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the spans of every kind replaced by the kind's name in brackets.

    Kind by kind in the order of ``KINDS``: a kind's spans are found in what the kinds before it
    left, so overlapping spans leave one mark. Texts without a span, and NULL ones, stay as they
    are. ``length_col``, if the table has it, gets the number of characters of a changed text.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    for kind in KINDS:
        rows = _marked(_around(_matches(rows, [kind])), kind)
    text, columns = F.col("text"), []
    changed = ~text.eqNullSafe(F.col(f"row.`{text_col}`"))
    for field in docs.schema:
        own = F.col(f"row.`{field.name}`")
        if field.name == text_col:
            own = text
        elif field.name == length_col:
            own = F.when(changed, F.length(text).cast(field.dataType)).otherwise(own)
        columns.append(own.alias(field.name))
    return rows.select(*columns)


def _marked(rows: DataFrame, kind: Kind) -> DataFrame:
    """row and text, with the name of the kind in place of its spans."""
    part = F.get("found", F.lit(0))

    def mark(match: Column, i: Column) -> Column:
        return F.when(_taken(kind, match, _score(kind, part, i)), F.lit(f"[{kind.name.upper()}]")).otherwise(match)

    rows = settled(rows.withColumn("marks", F.when(part.isNotNull(), F.transform(part["m"], mark))))
    joined = F.array_join(F.zip_with(part["g"], "marks", lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return settled(rows.select("row", F.coalesce(joined, "text").alias("text")))
