"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepulse.sources.writers import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of all nodes in ``links``, which has two columns of longs.

    Each round writes its edges to shared storage, so lineage stays short, and ends when a round
    changes nothing; rounds grow with the logarithm of the size. Only two numbers a round come to
    the driver. Loops and repeated links do no harm; rows with a NULL are ignored. Nodes without
    a link are not in the result.
    """
    spark = links.sparkSession
    a, b = (F.col(c).cast("long") for c in links.columns)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        a.isNotNull() & b.isNotNull() & (a != b)
    ).distinct()
    edges = stage(spark, edges, "links")
    sign = _sign(edges)
    while sign[0]:
        edges = stage(spark, _small_star(_large_star(edges).distinct()).distinct(), "stars")
        before, sign = sign, _sign(edges)
        if sign == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
