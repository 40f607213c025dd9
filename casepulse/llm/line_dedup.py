"""Line deduplication: content-defined chunks of lines that the corpus repeats are removed.

Built-in functions only. From every line with a word on, a cutting may begin; a rolling hash over the
hashes of its first two lines chooses where its first chunk ends. So the chunks inside a passage depend
on the passage alone, whatever stands before or after it, and overlap: a repeated passage of three lines is
always found, whole but for its last line at times. Lines without a word never begin or end a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.llm.common import settled, whole

#: Of so many rolling hashes one lets the chunk go on to a third line.
LONGER = 3
#: Factor of the rolling hash, and hexadecimal digits of MD5 in a line's hash.
FACTOR, DIGITS = 31, 12
#: A line with a word.
WORDED = r"[^\x20\x09-\x0D]"
#: Stands in for the id of rows without one.
LAST = (1 << 63) - 1


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, DIGITS), 16, 10).cast("long")


def with_chunks(rows: DataFrame) -> DataFrame:
    """``rows`` with the lines of the column text, and chunks: arrays of the places of the first and last line.

    One chunk for each line with a word but the last such one. It ends at the next one, or at the one after that
    (if there is one) where the rolling hash of the first two is a multiple of ``LONGER``.
    """
    rows = settled(rows.withColumn("lines", F.split("text", "\n", -1)))
    worded = F.filter(
        F.transform("lines", lambda line, i: F.when(F.regexp_like(line, F.lit(WORDED)), F.struct(i.alias("at"), line_hash(line).alias("h")))),
        lambda line: line.isNotNull(),
    )
    rows = settled(rows.withColumn("worded", worded))
    n = F.size("worded")
    longer = lambda line, k: (FACTOR * line["h"] + F.get("worded", k + 1)["h"]) % LONGER == 0
    chunks = F.transform(F.slice("worded", 1, F.greatest(n - 1, F.lit(0))), lambda line, k: F.struct(
        k.alias("no"), line["at"].alias("first"),
        F.get("worded", F.when(longer(line, k), F.least(k + 2, n - 1)).otherwise(k + 1))["at"].alias("last"),
    ))
    return settled(rows.withColumn("chunks", chunks).drop("worded"))


def chunk_text(lines: str, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def with_repeated(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with lines, chunks and, in again, the numbers of the chunks that are not in alone."""
    rows = with_chunks(rows.withColumn("text", whole(F.col(f"row.`{text_col}`"))))
    alone = F.coalesce("alone", F.array().cast("array<int>"))
    again = F.array_except(F.transform("chunks", lambda c: c["no"]), alone)
    return settled(rows.withColumn("again", again).drop("alone", "text"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its repeated chunks, and n_lines, n_chunks, n_removed (lines) of each row.

    A line goes if a chunk that holds it occurs in the corpus before: in a smaller id, or earlier in
    the row. So each line that goes still stands in an earlier place. Steps: the hashes of all chunks are
    counted, which moves no text; the places of chunks that are alone go back to their rows by id, and what
    is left there is repeated; those chunks' texts are grouped by their bytes, combined before the shuffle,
    which also tells texts with one hash apart; the lines of every place that is not the first of its group go.
    No join is on the hash, so a chunk in a third of all rows meets in no task.

    Rows are told apart by id and text: rows that repeat both are treated alike and keep what the
    first of them keeps. Rows without an id come last. A NULL text stays NULL; a text that is all
    repeated becomes empty; one line alone never goes. All columns of ``docs`` stay; those named like a
    result are replaced.
    """
    key = ["id", "mark"]
    own = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.xxhash64(whole(text_col)).alias("mark"),
    )
    cut = with_chunks(own.select(*key, whole(F.col(f"row.`{text_col}`")).alias("text")))
    places = cut.select(*key, F.explode(F.transform("chunks", lambda c: F.struct(
        c["no"].alias("no"), F.xxhash64(chunk_text("lines", c["first"], c["last"])).alias("hash")
    ))).alias("c"))
    # A group of one: each minimum is that place's own value.
    alone = places.groupBy("c.hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("mark").alias("mark"), F.min("c.no").alias("no")
    ).where("n = 1").groupBy(*key).agg(F.collect_list("no").alias("alone"))
    # Settled, so that both readers below ask the same of the rows and their shuffle runs once.
    rows = with_repeated(settled(own.join(alone, key, "left")), text_col)
    texts = rows.select(*key, F.explode(F.transform("again", lambda no: F.struct(
        no.alias("no"), chunk_text("lines", F.get("chunks", no)["first"], F.get("chunks", no)["last"]).alias("text")
    ))).alias("c"))
    first = texts.groupBy("c.text").agg(
        F.min(F.struct(*key, F.col("c.no").alias("no"))).alias("at")
    ).select("at.*").groupBy(*key).agg(F.collect_list("no").alias("stay"))
    rows = with_repeated(settled(own.join(alone, key, "left").join(first, key, "left")), text_col)
    later = F.array_except("again", F.coalesce("stay", F.array().cast("array<int>")))
    rows = settled(rows.withColumn("later", later).drop("again", "stay"))
    gone = F.array_distinct(F.flatten(F.transform("later", lambda no: F.sequence(
        F.get("chunks", no)["first"], F.get("chunks", no)["last"]
    ))))
    rows = settled(rows.withColumn("gone", gone).drop("later"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    counts = {"n_lines": F.size("lines"), "n_chunks": F.size("chunks"), "n_removed": F.size("gone")}
    done = settled(rows.select(
        "row", F.when(F.size("gone") > 0, text).otherwise(F.col(f"row.`{text_col}`")).alias("text"),
        *(value.cast("long").alias(name) for name, value in counts.items()),
    ))
    kept = [
        F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns if c not in counts
    ]
    return done.select(*kept, *counts)
