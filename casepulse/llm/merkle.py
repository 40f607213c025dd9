"""A Merkle manifest of a dataset: one tree for each group of rows, and one over the groups' tops.

Every row is a leaf. In each group, leaves ascend by id and every sixteen nodes in a row become
their parent, until one is left; the groups' tops, in the order of the groups' names, become the
root alike. A row's proof is its siblings on every level up to the root.

Leaves first get their places over all tasks. A superblock is some whole blocks of 256 places, so a
group with any share of the rows is many superblocks, and many small groups are one. One pass
reduces blocks to their tops, again and again until only the root is left: each pass leaves one
row of 256. The way back hands every block the siblings outside it. Then each superblock's leaves
meet the outer nodes of its blocks in one cogroup, which reduces them once more, joins the
siblings inside and outside to proofs and folds each row's presented content up to the root.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.llm.common import importable, settled
from casepulse.llm.order import ranked
from casepulse.sources.writers import stage

#: Nodes under a parent, and levels of a block: ARITY ** HEIGHT places.
ARITY, HEIGHT = 16, 2
BLOCK = ARITY**HEIGHT


def framed(value: Column) -> Column:
    """A value by its number of UTF-8 bytes and its text, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, columns)), 256)


def digest(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: Column) -> Column:
    """Levels that a block has when its tree has ``n`` nodes: those up to the top, or all."""
    out = F.lit(HEIGHT)
    for height in reversed(range(HEIGHT)):
        out = F.when(n <= ARITY**height, height).otherwise(out)
    return out


def next_level(nodes: Column) -> Column:
    """The parents of an array of nodes."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")),
        lambda k: F.sha2(F.array_join(F.slice(nodes, k * ARITY + 1, ARITY), ""), 256),
    )


def tops(nodes: DataFrame) -> DataFrame:
    """The nodes (tree, pos, n, digest) that stand above the blocks of ``nodes``, numbered and counted anew."""
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("pos"), "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("nodes")
    )
    for level in range(HEIGHT):
        blocks = blocks.withColumn(
            "nodes", F.when(levels_of(F.col("n")) > level, next_level(F.col("nodes"))).otherwise(F.col("nodes"))
        )
    return blocks.select("tree", "pos", F.ceil(F.col("n") / BLOCK).alias("n"), F.get("nodes", F.lit(0)).alias("digest"))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and, stored, the nodes above them, block by block, up to the top of every tree."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stage(nodes.sparkSession, tops(levels[-1]), "nodes"))
        most = -(-most // BLOCK)
    return levels


class Block:
    """The nodes of a block, level by level, up to its top."""

    def __init__(self, leaves: Sequence[str], height: int):
        self.levels = [list(leaves)]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest(below[k:k + ARITY]) for k in range(0, len(below), ARITY)])

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """What stands to the left and to the right of the node on each level below the top."""
        out = []
        for level in self.levels[:-1]:
            first = place - place % ARITY
            run = level[first:first + ARITY]
            out.append(("".join(run[:place - first]), "".join(run[place - first + 1:])))
            place //= ARITY
        return out


def with_proofs(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """tree, pos, subroot and proof (lefts, rights) of ``nodes``, from those of the nodes over their blocks."""

    def prove(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        own, over = own.sort_values("pos"), outer.iloc[0]
        block = Block(own["digest"], int(own["height"].iloc[0]))
        inner = [block.siblings(k) for k in range(len(own))]
        return pd.DataFrame({
            "tree": own["tree"], "pos": own["pos"], "subroot": over["subroot"],
            "lefts": [[a for a, _ in x] + list(over["lefts"]) for x in inner],
            "rights": [[z for _, z in x] + list(over["rights"]) for x in inner],
        })

    alone = nodes.where("n = 1").select("tree", "pos").join(above, ["tree", "pos"])
    inner = nodes.where("n > 1").withColumns(
        {"height": levels_of(F.col("n")), "block": F.floor(F.col("pos") / BLOCK)}
    )
    outer = above.withColumnRenamed("pos", "block").join(
        inner.select("tree", "block").distinct(), ["tree", "block"], "left_semi"
    )
    return inner.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        prove, above.schema
    ).unionByName(alone)


def descended(levels: list[DataFrame], proofs: DataFrame) -> DataFrame:
    """The proofs of the first of the levels, from those of the last."""
    for nodes in reversed(levels[:-1]):
        proofs = stage(nodes.sparkSession, with_proofs(nodes, proofs), "proofs")
    return proofs


def merkle_manifest(
    docs: DataFrame, *, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "source",
    presented: Mapping[str, Column] | None = None, proofs: bool = True,
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and what its presented content folds to.

    Result: id, leaf, subroot, root (of ``docs`` as they are), proof_sha256 (of all siblings, level
    by level, left to right), folded_root (from the row as presented and its siblings), verified (that
    is the root) and, with ``proofs``, lefts and rights: what stands on both sides of the node on
    every level. ``presented`` gives expressions that replace columns in what is presented; without
    it the rows present themselves.

    A leaf hashes ``columns``, each by its number of bytes and its text, NULL as a dash; an empty
    text is ``0:``. Rows without a group are one group, the first; rows without an id come first
    in their group. Rows that repeat an id in a group stand in the order of their leaves. A group of
    one row is its own subroot; a single group's subroot is the root, with no siblings above. An
    empty table gives an empty result. Other columns are ignored, and their names may clash. Ids are
    whole numbers. Only the largest group's size and the root come to the driver.
    """
    spark = docs.sparkSession
    importable(spark)
    own = [F.col(f"`{name}`") for name in columns]
    shown = [(presented or {}).get(name, value) for name, value in zip(columns, own, strict=True)]
    hashed = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("name"),
        leaf_hash(own).alias("leaf"), (leaf_hash(shown) if presented else F.lit(None).cast("string")).alias("other"),
    )
    # What is presented as it is needs no second digest.
    hashed = stage(spark, settled(hashed).withColumn("other", F.nullif("other", "leaf")), "leaves")
    leaves = stage(spark, ranked(hashed, ["name"], ["id", "leaf"]).select(
        F.col("id").cast("string").alias("id"), "leaf", "other", "tree", (F.col("at") - F.col("tree")).alias("pos"),
        F.col("n_tree").alias("n"),
    ), "placed")

    groups = climbed(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    # A tree's number is the place of its first leaf, so they ascend as the groups' names do.
    subroots = stage(spark, groups[-1].select(F.col("tree").alias("group"), F.col("digest").alias("subroot")), "subroots")
    forest = stage(spark, ranked(subroots, [], ["group"]).select(
        "group", "tree", F.col("at").alias("pos"), F.col("n_tree").alias("n"), F.col("subroot").alias("digest")
    ), "forest")
    levels = climbed(forest.drop("group"))
    top = levels[-1].first()
    root = F.lit(top["digest"] if top else None).cast("string")
    none = F.lit(None).cast("string")
    outer = descended(levels, levels[-1].select(
        "tree", "pos", none.alias("subroot"), F.array().cast("array<string>").alias("lefts"),
        F.array().cast("array<string>").alias("rights"),
    )).drop("tree", "subroot").join(forest.drop("tree"), "pos").select(
        F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "lefts", "rights"
    )
    outer = descended(groups[1:], outer) if len(groups) > 1 else outer

    block = F.floor(F.col("pos") / BLOCK)
    inner = leaves.withColumns({"height": levels_of(F.col("n")), "block": block}).withColumn(
        "superblock", F.floor((F.col("tree") + F.col("block") * BLOCK) / BLOCK)
    ).drop("n")
    outer = outer.withColumnRenamed("pos", "block").withColumns(
        {"superblock": F.floor((F.col("tree") + F.col("block") * BLOCK) / BLOCK), "root": root}
    )
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    paths = ", lefts array<string>, rights array<string>" if proofs else ""
    folded = inner.groupBy("superblock").cogroup(outer.groupBy("superblock")).applyInPandas(
        partial(fold, proofs=proofs), schema + paths
    )
    return folded.select(
        F.col("id").cast("long").alias("id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), *(["lefts", "rights"] if proofs else []),
    )


def fold(leaves: pd.DataFrame, outer: pd.DataFrame, *, proofs: bool) -> pd.DataFrame:
    """The result rows of a superblock's leaves, from the outer nodes of its blocks."""
    over = {(o.tree, o.block): o for o in outer.itertuples()}
    rows = []
    for key, own in leaves.sort_values("pos").groupby(["tree", "block"], sort=False):
        above = over[key]
        block = Block(own["leaf"], int(own["height"].iloc[0]))
        outside = list(zip(above.lefts, above.rights, strict=True))
        for place, (row_id, leaf, other) in enumerate(zip(own["id"], own["leaf"], own["other"], strict=True)):
            path = block.siblings(place) + outside
            node = other or leaf
            for left, right in path:
                node = digest((left, node, right))
            siblings = digest([side for level in path for side in level])
            paths = [[a for a, _ in path], [z for _, z in path]] if proofs else []
            rows.append((row_id, leaf, above.subroot, above.root, siblings, node, *paths))
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "lefts", "rights"]
    return pd.DataFrame(rows, columns=names[:8 if proofs else 6])
