"""A trie of conversations by their first turns, rolled up over a centroid decomposition.

Conversations that begin alike share nodes. A node is known by an exclusive or of hashes of its
turns, each with its place, so the keys of a conversation's prefixes are running values and no
task reads a conversation as a whole. Nodes that have the same members stand one below the other
and form a segment, named by its smallest member and its number of members; segments are the
forest's vertices, at most two for each different conversation.

Totals of subtrees come from a decomposition of that forest. In each round every component with
more than some vertices splits at its centroid, the deepest vertex with half of the component's weight
below it: the vertices above it are just those with half of the weight, so none is searched. The total
of the centroid's side is added along the path from the centroid to the component's top. Then the
parts below the centroid and the part above are components of at most half the weight. Small
components are finished in tasks that hold many of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casepulse.llm.common import importable, join_groups, map_arrow, parts_of, whole
from casepulse.llm.order import ranked, running
from casepulse.sources.writers import stage

#: Vertices of a component that is finished in one task; such vertices to a task; components that split in a round at most.
SMALL, TOGETHER, SPLITS = 1024, 32_768, 65_536
#: Places of a row's block where a long conversation or segment meets its one row of facts; ids of a chunk of text.
BLOCK = CHUNK = 4096


def by_block(facts: DataFrame, first: Column | str, last: Column | str) -> DataFrame:
    """``facts`` once for every block of places from ``first`` to ``last``, for joins of long keys."""
    first, last = (F.col(c) if isinstance(c, str) else c for c in (first, last))
    return facts.withColumn("block", F.explode(F.sequence(block_of(first), block_of(last))))


def block_of(place: Column) -> Column:
    return F.floor(place / BLOCK).cast("long")


def rebuilt(turns: DataFrame, kept: Column, base: Column, longest: int) -> DataFrame:
    """conv, d (from 1), t1, t2 (hashes of the turn at its place) and bytes of every rebuilt conversation's turns.

    A conversation takes the first ``kept`` turns (``longest`` at most) of conversation ``base``
    and then its own after as many; both are expressions over the column conv. turns: conv, i, n, h1, h2, bytes.
    """
    convs = turns.where("i = 0").select("conv", "n").withColumns({"kept": kept, "base": base})
    there = turns.where("i = 0").select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = stage(turns.sparkSession, convs.join(there, "base", "left").withColumn(
        "head", F.least("kept", F.coalesce("n_base", F.lit(0)))
    ), "convs")
    first = turns.where(F.col("i") < longest).select(F.col("conv").alias("base"), "i", "h1", "h2", "bytes")
    heads = convs.select("conv", "base", "head").join(first, "base").where("i < head").select(
        "conv", F.col("i").alias("place"), "h1", "h2", "bytes"
    )
    own = turns.withColumn("kept", kept).where("i >= kept").withColumn("block", block_of(F.col("i")))
    facts = by_block(convs.select("conv", "head", "n"), F.lit(0).cast("long"), F.col("n") - 1).drop("n")
    tails = own.join(facts, ["conv", "block"]).select(
        "conv", (F.col("head") + F.col("i") - F.col("kept")).alias("place"), "h1", "h2", "bytes"
    )
    return heads.union(tails).select(
        "conv", (F.col("place") + 1).alias("d"), *(F.xxhash64(F.lit(k), "place", "h1", "h2").alias(f"t{k}") for k in (1, 2)), "bytes"
    )


def split(state: DataFrame, big: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components ``big`` split at their centroids: the vertices that remain, and the centroids' totals.

    state: seg, rep, top, comp, weight (below and at it, in its component), leaves, saved (its own) and
    more_leaves, more_saved (from parts split off below it). big: comp, total (weight).
    """
    spark = state.sparkSession
    work = state.join(F.broadcast(big), "comp").withColumn("path", 2 * F.col("weight") >= F.col("total"))
    centre = F.max_by(F.struct("seg", "top", "weight"), "top").alias("centre")
    centres = stage(spark, work.where("path").groupBy("comp").agg(centre), "centres")
    # The conversations that pass a centroid, each with the segment in which it goes on.
    through = paths.join(F.broadcast(centres.select("comp", F.col("centre.seg").alias("seg"))), "seg").select(
        F.col("conv").alias("rep"), "comp", "next", F.lit(True).alias("passes")
    )
    placed = stage(spark, work.join(F.broadcast(centres), "comp").join(through, ["rep", "comp"], "left").withColumns({
        "centroid": F.col("seg") == F.col("centre.seg"),
        "below": F.coalesce("passes", F.lit(False)) & (F.col("top") > F.col("centre.top")),
    }), "split")
    sums = placed.where("centroid or below").groupBy("comp").agg(
        F.sum("leaves").alias("side_leaves"), F.sum("saved").alias("side_saved")
    )
    summed = placed.join(F.broadcast(sums), "comp")
    done = summed.where("centroid").select(
        "seg", (F.col("more_leaves") + F.col("side_leaves")).alias("n_leaves"),
        (F.col("more_saved") + F.col("side_saved")).alias("saved"),
    )
    above = F.col("path") & ~F.col("below")

    def more(name: str) -> Column:
        return (F.col(f"more_{name}") + F.when(above, F.col(f"side_{name}")).otherwise(0)).alias(f"more_{name}")

    left = summed.where("not centroid").withColumns({
        "weight": F.col("weight") - F.when(above, F.col("centre.weight")).otherwise(0),
        "comp": F.when(F.col("below"), F.col("next")).otherwise(F.col("comp")),
    }).withColumns({f"more_{name}": more(name) for name in ("leaves", "saved")})
    return left.select(*state.columns), done


def finished(vertices: DataFrame) -> DataFrame:
    """seg, n_leaves and saved of the vertices of small components."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        place = {key: k for k, key in enumerate(zip(own["rep"], own["n"], strict=True))}
        parents = [place.get(key, -1) for key in zip(own["up_rep"], own["up_n"], strict=True)]
        comps = list(zip(own["comp_rep"], own["comp_n"], strict=True))
        leaves, saved, tops = own["leaves"].tolist(), own["saved"].tolist(), own["top"].tolist()
        for k in sorted(range(len(own)), key=tops.__getitem__, reverse=True):
            up = parents[k]
            if up >= 0 and comps[up] == comps[k]:
                leaves[up] += leaves[k]
                saved[up] += saved[k]
        return pd.DataFrame({
            "rep": own["rep"], "n": own["n"], "n_leaves": own["more_leaves"] + leaves, "saved": own["more_saved"] + saved,
        })

    bundles = -(-vertices.count() // TOGETHER) or 1
    flat = vertices.select(
        F.pmod(F.xxhash64("comp"), F.lit(bundles)).alias("bundle"), "seg.rep", "seg.n", "comp.rep", "comp.n",
        # The root has no parent; no segment has -1 members.
        F.coalesce("up.rep", F.lit(-1)), F.coalesce("up.n", F.lit(-1)), "top", "leaves", "saved", "more_leaves", "more_saved",
    ).toDF("bundle", "rep", "n", "comp_rep", "comp_n", "up_rep", "up_n", "top", "leaves", "saved", "more_leaves", "more_saved")
    return flat.groupBy("bundle").applyInPandas(fold, "rep long, n long, n_leaves long, saved long").select(
        F.struct("rep", "n").alias("seg"), "n_leaves", "saved"
    )


def rolled_up(segments: DataFrame, paths: DataFrame, small: int = SMALL) -> DataFrame:
    """seg, n_leaves and saved: the sums of leaves and saved over the subtree of every segment.

    segments, stored: seg, up (the parent's seg, NULL for the one root), top, weight (sum over the subtree of
    positive weights), leaves, saved. paths, stored: conv, seg, next, for each segment that a conversation passes.
    """
    spark = segments.sparkSession
    root = segments.where("up is null").select("seg").first()
    rep, n = root["seg"] if root else (None, None)
    state = segments.withColumns({
        "rep": F.col("seg.rep"), "comp": F.struct(F.lit(rep).cast("long").alias("rep"), F.lit(n).cast("long").alias("n")),
        "more_leaves": F.lit(0).cast("long"), "more_saved": F.lit(0).cast("long"),
    })
    small = max(small, segments.count() // SPLITS)
    rest, totals = [], []
    while True:
        sizes = state.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.max("weight").alias("total"))
        big = stage(spark, sizes.where(F.col("size") > small).drop("size"), "components")
        rest.append(state.join(F.broadcast(big.select("comp")), "comp", "left_anti").select(*state.columns))
        if big.isEmpty():
            break
        left, done = split(state, big, paths)
        totals.append(done)
        state = stage(spark, left, "vertices")
    together = stage(spark, reduce(DataFrame.unionByName, rest), "small-components")
    return reduce(DataFrame.unionByName, [finished(together), *totals])


def digests(ends: DataFrame) -> DataFrame:
    """rep, n and ends_sha256 from the conversations (conv) that end in each segment.

    The text under the hash is made in chunks over all tasks. A segment with several streams them
    through one task in their order, as the hash is one chain; it holds a batch of them.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"rep": at[0], "n": at[1], "ends_sha256": state.hexdigest()}])

        for batch in batches:
            for rep, n, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "text")), strict=True):
                if (rep, n) != at:
                    if at:
                        yield result()
                    at, state = (rep, n), sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if at:
            yield result()

    spark = ends.sparkSession
    placed = ranked(ends, ["rep", "n"], ["conv"])
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    chunks = stage(spark, placed.groupBy(
        "rep", "n", F.floor((F.col("at") - F.col("tree")) / CHUNK).alias("chunk"), (F.col("n_tree") > CHUNK).alias("many")
    ).agg(F.array_join(ids, ",").alias("text")), "chunks")
    many = chunks.where("many").repartition(parts_of(spark), "rep", "n").sortWithinPartitions("rep", "n", "chunk")
    return chunks.where("not many").select("rep", "n", F.sha2("text", 256).alias("ends_sha256")).union(
        map_arrow(many.select("rep", "n", "text"), chain, "rep long, n long, ends_sha256 string")
    )


def prefix_trie(
    conversations: DataFrame, *, kept: Column | None = None, base: Column | None = None, longest: int = 0,
    small: int = SMALL, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """A row for each different beginning of the conversations: a node of their trie.

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id), n_convs (conversations
    that begin so), n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the
    subtree, n_convs - 1 times the bytes of the last turn's text) and ends_sha256 (of the ascending ids
    of the conversations that end there). The root is the empty beginning, of all conversations.

    ``kept`` and ``base``, expressions over a column conv (the id), rebuild each conversation first: the
    first ``kept`` turns, up to ``longest``, of conversation ``base`` (none if there is no such one), then
    its own after as many. Without them conversations stay as they are.

    Turns ascend, NULL first; equal ones stand by a hash of role and text. A NULL role or text is
    an empty one. Rows without a conversation are ignored. Whole repeated rows are turns of their own. A
    conversation that is left without turns ends at the root. An empty table gives an empty result; other
    columns are ignored. Equal beginnings are told by two 64-bit hashes of all their turns.
    """
    spark = conversations.sparkSession
    importable(spark)
    role, text = whole(role_col), whole(text_col)
    turns = stage(spark, conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"),
    ), "turns")
    turns = stage(spark, ranked(turns, ["conv"], ["turn", "h1", "h2"]).select(
        "conv", (F.col("at") - F.col("tree")).alias("i"), F.col("n_tree").alias("n"), "h1", "h2", "bytes"
    ), "ordered")
    zero = F.lit(0).cast("long")
    convs = turns.where("i = 0").select("conv")
    steps = rebuilt(turns, zero if kept is None else kept, F.col("conv") if base is None else base, longest)
    steps = running(steps, ["conv"], "d", {"x_1": F.col("t1"), "x_2": F.col("t2")}).select("conv", "d", "x_1", "x_2", "bytes")
    steps = stage(spark, steps.unionByName(
        convs.withColumns({name: zero for name in ("d", "x_1", "x_2", "bytes")})
    ), "steps")
    nodes = stage(spark, steps.groupBy("d", "x_1", "x_2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep"), F.max("bytes").alias("bytes")
    ).withColumn("gain", (F.col("n") - 1) * F.col("bytes")), "nodes")

    # The segments that each conversation passes. It passes few: k of them take k other conversations of
    # growing length, so about the square of k in turns.
    passed = join_groups(
        steps.select("conv", "d", "x_1", "x_2"), nodes.select("d", "x_1", "x_2", "n", "rep"), ["d", "x_1", "x_2"],
        size="n", spread=["conv"],
    ).groupBy("conv", F.struct("rep", "n").alias("seg")).agg(F.min("d").alias("top"), F.max("d").alias("bottom"))
    down, up = Window.partitionBy("conv").orderBy("top"), Window.partitionBy("conv").orderBy(F.desc("top"))
    paths = stage(spark, passed.withColumns({
        "up": F.lag("seg").over(down), "next": F.lead("seg").over(down), "below": F.row_number().over(up).cast("long"),
    }), "paths")

    own = paths.where("conv = seg.rep").select("seg", "up", "top", "bottom")
    weights = paths.groupBy("seg").agg(F.sum("below").alias("weight"))
    gains = nodes.groupBy(F.struct("rep", "n").alias("seg")).agg(F.sum("gain").alias("saved"))
    kids = own.where("up is not null").groupBy(F.col("up").alias("seg")).agg(F.count(F.lit(1)).alias("kids"))
    segments = stage(spark, own.join(weights, "seg").join(gains, "seg").join(kids, "seg", "left").withColumn(
        "kids", F.coalesce("kids", zero)
    ).withColumn("leaves", (F.col("kids") == 0).cast("long")), "segments")

    totals = rolled_up(
        segments.select("seg", "up", "top", "weight", "leaves", "saved"), paths.select("conv", "seg", "next"), small
    ).withColumnRenamed("saved", "total")
    ends = digests(stage(spark, paths.where("next is null").select("conv", "seg.rep", "seg.n"), "ends"))
    nothing = F.sha2(F.lit(""), 256)
    facts = segments.join(totals, "seg").select("seg.rep", "seg.n", F.col("up.rep").alias("up_rep"), "top", "bottom", "kids", "n_leaves", "total")
    facts = by_block(facts.join(ends, ["rep", "n"], "left"), "top", "bottom")
    listed = running(nodes.select("d", "n", "rep", "gain"), ["rep", "n"], "d", {"upto": F.col("gain")})
    inner = F.col("d") < F.col("bottom")
    return listed.withColumn("block", block_of(F.col("d"))).join(facts, ["rep", "n", "block"]).select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("top"), F.col("rep")).otherwise(F.col("up_rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(inner, F.lit(1).cast("long")).otherwise(F.col("kids")).alias("n_children"),
        "n_leaves", (F.col("total") - F.col("upto") + F.col("gain")).alias("saved_tokens"),
        F.when(inner, nothing).otherwise(F.coalesce("ends_sha256", nothing)).alias("ends_sha256"),
    )
