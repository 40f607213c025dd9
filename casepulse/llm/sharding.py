"""Shards of near equal bytes: minimax contiguous partition of atomic groups.

Rows with equal texts form a group, and groups are ordered by their text's hash, so a shard is a
range of hashes and a row finds its shard by comparing its hash with at most 15 cuts, without a
join. The cuts give the smallest possible capacity of the largest shard: a binary search over
capacities, each checked greedily - every shard takes groups until the next would not fit. A group
that alone makes the capacity has a shard for itself, and the same search goes on before and after it. Under
the capacity found, each shard ends as near below an even share of what is left as the rest allows.

The greedy check needs the largest running sum up to a number. The driver holds running sums at
some groups only, and knows from them that some capacities are enough and others are not. Between
the two it asks for more running sums, only around where the cuts may be, until the answer is
certain; each time it gets a bounded number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casepulse.llm.common import parts_of, whole
from casepulse.sources.writers import stage

#: Places around one cut at which the driver asks for running sums, four times as many each round.
STEPS = 512
#: Bits of the hash that name a range; running sums start anew in each, and its total comes to the driver.
RANGE_BITS = 12


class Sums:
    """What is known of the running sums: some of them, and where there may be others."""

    def __init__(self, known: Iterable[int]):
        self.known = sorted(set(known))
        #: (low, high): there may be sums between the two, without them.
        self.open = [(a, z) for a, z in zip(self.known, self.known[1:], strict=False) if z - a > 1]
        #: Of ``open``, those that an answer of ``floor`` or ``ceil`` depends on.
        self.doubts: list[tuple[int, int]] = []

    def learn(self, low: int, high: int, found: Iterable[tuple[int, int, int]]) -> None:
        """Above ``low`` and up to ``high`` are these: the first, the last and the number of each bucket."""
        found = list(found)
        left = []
        for a, z in self.open:
            left += [(a, min(z, low + 1))] if a < low else []
            left += [(max(a, high), z)] if z > high + 1 else []
        left += [(a, z) for a, z, n in found if n > 2]
        self.open = sorted((a, z) for a, z in left if z - a > 1)
        self.known = sorted({*self.known, *(x for a, z, _ in found for x in (a, z))})

    def reach(self, most: int, hopeful: bool) -> int:
        """The largest known sum up to ``most``; hopeful, the largest that may be."""
        best = self.known[bisect_right(self.known, most) - 1]
        at = bisect_left(self.open, (most, 0)) - 1
        return max(best, min(most, self.open[at][1] - 1)) if hopeful and at >= 0 else best

    def floor(self, most: int) -> int:
        """The largest known sum up to ``most``; notes whether an unknown one may be larger."""
        at = bisect_left(self.open, (most, 0)) - 1
        if at >= 0 and min(most, self.open[at][1] - 1) > (known := self.known[bisect_right(self.known, most) - 1]):
            self.doubts.append(self.open[at])
            return known
        return self.known[bisect_right(self.known, most) - 1]

    def ceil(self, least: int) -> int:
        """The smallest known sum from ``least`` on; notes whether an unknown one may be smaller."""
        best = self.known[bisect_left(self.known, least)]
        at = bisect_left(self.open, (best, 0)) - 1
        if at >= 0 and max(least, self.open[at][0] + 1) < min(best, self.open[at][1]):
            self.doubts.append(self.open[at])
        return best

    def even(self, capacity: int, shards: int, start: int, stop: int) -> list[int]:
        """Ends of shards of ``capacity`` at most: each takes an even share of what is left, or as much as the rest must leave to it."""
        least = [stop]
        for _ in range(shards - 1):
            least.append(self.ceil(max(start, least[-1] - capacity)))
        at, out = start, []
        for left, low in zip(range(shards, 0, -1), reversed(least), strict=True):
            share = self.floor(at + (stop - at) // left)
            at = max(low, share if share > at or at == stop else self.ceil(at + 1))
            out.append(at)
        return out

    def ends(self, capacity: int, shards: int, hopeful: bool, start: int = 0, stop: int | None = None) -> list[int]:
        """Where the shards from ``start`` on end if each takes all that fits, up to ``stop``."""
        at, out, stop = start, [], self.known[-1] if stop is None else stop
        for _ in range(shards):
            at = self.reach(min(at + capacity, stop), hopeful)
            out.append(at)
        return out

    def needed(self, capacity: int, most: int, hopeful: bool, start: int, stop: int) -> int:
        """How many shards take everything from ``start`` to ``stop``; more than ``most`` if those do not."""
        return sum(end < stop for end in self.ends(capacity, most, hopeful, start, stop)) + 1

    def least(
        self, low: int, high: int, shards: int, hopeful: bool, spans: Sequence[tuple[int, int]] | None = None
    ) -> int:
        """The smallest capacity from ``low`` to ``high`` with which the shards take everything, or all of ``spans``."""
        spans = [(0, self.known[-1])] if spans is None else spans
        while low < high:
            middle = (low + high) // 2
            if sum(self.needed(middle, shards, hopeful, a, z) for a, z in spans) <= shards:
                high = middle
            else:
                low = middle + 1
        return high


def least_capacity(
    running: DataFrame, sums: Sums, largest: int, shards: int, parts: Sequence[tuple[int, int]]
) -> int:
    """The smallest capacity with which ``shards`` take all between the running sums (column upto) of each of ``parts``."""
    steps = STEPS
    low = max(largest, -(-sum(z - a for a, z in parts) // shards))
    high = max(low, *(z - a for a, z in parts))
    while True:
        # Less would not do even if sums stood wherever they may; with the known sums this does.
        low = sums.least(low, high, shards, True, parts)
        high = sums.least(low, high, shards, False, parts)
        if low == high:
            return high
        # Whatever the answer, each shard ends between these.
        spans = [span for a, z in parts for span in zip(
            sums.ends(low, shards, False, a, z), sums.ends(high, shards, True, a, z), strict=True
        )]
        ask(running, sums, spans, steps)
        steps *= 4


def ask(running: DataFrame, sums: Sums, spans: Iterable[tuple[int, int]], steps: int) -> None:
    """Learns the running sums above the start and up to the end of each span, ``steps`` buckets to a span at most.

    Spans that overlap become one, so every running sum is in one span and one bucket at most.
    """
    apart: list[tuple[int, int]] = []
    for a, z in sorted(span for span in spans if span[0] < span[1]):
        if apart and a < apart[-1][1]:
            apart[-1] = apart[-1][0], max(z, apart[-1][1])
        else:
            apart.append((a, z))
    span, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, (a, z) in enumerate(apart):
        inside = (F.col("upto") > a) & (F.col("upto") <= z)
        step = max(1, -(-(z - a) // steps))
        span = F.when(inside, k).otherwise(span)
        bucket = F.when(inside, F.floor((F.col("upto") - a - 1) / F.lit(step))).otherwise(bucket)
    buckets = running.select("upto", span.alias("span"), bucket.alias("bucket")).where("span is not null").groupBy(
        "span", "bucket"
    ).agg(F.min("upto").alias("a"), F.max("upto").alias("z"), F.count(F.lit(1)).alias("n")).collect()
    for k, (a, z) in enumerate(apart):
        sums.learn(a, z, ((b.a, b.z, b.n) for b in buckets if b.span == k))


def spread(running: DataFrame, sums: Sums, capacity: int, shards: int, start: int, stop: int) -> list[int]:
    """The even ends of shards of ``capacity``, from running sums that are certain."""
    while True:
        sums.doubts = []
        ends = sums.even(capacity, shards, start, stop)
        if not sums.doubts:
            return ends
        ask(running, sums, ((a, z - 1) for a, z in sums.doubts), STEPS)


def even_ends(running: DataFrame, sums: Sums, shards: int, start: int, stop: int) -> list[int]:
    """The running sums at which the shards from ``start`` to ``stop`` end: the largest is the smallest possible, the rest even.

    While the largest group alone makes the capacity, it gets a shard for itself, and what stands
    before and after it shares the other shards under their own smallest capacity.
    """
    parts, left, ends = [(start, stop)], shards, []
    while parts:
        inside = reduce(or_, ((F.col("upto") > a) & (F.col("upto") <= z) for a, z in parts))
        size, upto = running.where(inside).agg(F.max(F.struct("size", "upto"))).first()[0]
        capacity = least_capacity(running, sums, size, left, parts)
        if capacity > size:
            break
        before = upto - size
        sums.learn(before - 1, upto, [(before, before, 1), (upto, upto, 1)])
        ends += [before, upto]
        parts = [
            (a, z) for low, high in parts for a, z in ([(low, before), (upto, high)] if low <= before < high else [(low, high)]) if a < z
        ]
        left -= 1
    if parts == [(start, stop)]:
        return spread(running, sums, capacity, shards, start, stop)
    given = {(a, z): sums.needed(capacity, left, False, a, z) for a, z in parts}
    while given and sum(given.values()) < left:
        given[max(given, key=lambda part: (part[1] - part[0]) / given[part])] += 1
    for (a, z), n in given.items():
        ends += even_ends(running, sums, n, a, z)
    return sorted(ends)


def running_sums(groups: DataFrame) -> tuple[DataFrame, Sums]:
    """The groups (hash, size) in order of hash with upto, the sum of sizes up to each; sums at the ranges' ends.

    Each range of hashes is summed by itself. Only the ranges' totals, 2 ** RANGE_BITS at most,
    come to the driver and go back as what to add to each range.
    """
    ranged = groups.withColumn("range", F.shiftright("hash", 64 - RANGE_BITS).cast("int"))
    totals = ranged.groupBy("range").agg(F.sum("size").alias("size")).orderBy("range").collect()
    ends = list(accumulate((t["size"] for t in totals), initial=0))
    before = groups.sparkSession.createDataFrame(
        [(t["range"], end) for t, end in zip(totals, ends, strict=False)], "range int, before long"
    )
    window = Window.partitionBy("range").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumn("within", F.sum("size").over(window)).join(F.broadcast(before), "range")
    return running.select("hash", "size", (F.col("before") + F.col("within")).alias("upto")), Sums(ends)


def cut_hashes(rows: DataFrame, shards: int) -> list[int]:
    """The hash of the last group of each shard but the last, from the rows' hash and size."""
    spark = rows.sparkSession
    groups = stage(spark, rows.groupBy("hash").agg(F.sum("size").alias("size")), "shard-groups")
    running, sums = running_sums(groups)
    if not sums.known[-1]:
        return []
    running = stage(spark, running, "running-sums")
    total = sums.known[-1]
    inner = sorted({end for end in even_ends(running, sums, shards, 0, total) if 0 < end < total})
    return sorted(row["hash"] for row in running.where(F.col("upto").isin(inner)).collect()) if inner else []


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with slot: numbers without gaps from 0 in each of a few groups, whatever their sizes.

    Each group is dealt into parts by the hash of ``order``; rows are numbered in their part, from
    the number of rows in the parts before it. The parts' counts are bounded and broadcast.
    """
    parts = parts_of(rows.sparkSession)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "_part").count().select(
        group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    own = Window.partitionBy(group, "_part").orderBy(*order)
    return rows.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(counts), [group, "_part"]).withColumn(
        "slot", (F.col("_before") + F.col("_own")).cast("long")
    ).drop("_part", "_before", "_own")


def shard_by_bytes(
    docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard and slot (gapless from 0) of every row.

    Equal texts share a shard, and the largest shard is as small as any cut of the groups in hash
    order allows; around a group larger than an even share the rest is spread evenly. Groups are
    told apart by a 64-bit hash: should two texts share one, they share a shard. A NULL text is an
    empty one. Fewer groups than shards leave the last shards empty. Rows that repeat an id get
    slots of their own; other columns are ignored; an empty table gives an
    empty result. The texts are read once: hashes, sizes and checksums are stored.
    """
    rows = stage(docs.sparkSession, docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(text_col)).alias("hash"),
        (F.octet_length(whole(text_col)) + 1).cast("long").alias("size"), F.crc32(whole(text_col)).alias("text_crc32"),
    ), "shard-rows")
    shard = F.lit(0)
    for cut in cut_hashes(rows, shards):
        shard = shard + (F.col("hash") > F.lit(cut)).cast("int")
    return numbered(rows.withColumn("shard", shard), "shard", ["doc_id", "hash"]).select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )
