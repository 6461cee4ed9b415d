"""Connected components by alternating large-star and small-star steps, in DataFrame operations only.

Both steps are joins of the edges with the least neighbour of each node, so no node's neighbours are ever gathered in one row or task:
the minimum is pre-aggregated before its shuffle and the join may be split where a node has very many edges. Up to FEW bytes of edges the least neighbours are broadcast, and edges aren't dealt by node at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage


#: Bytes of all edges' nodes up to which the least neighbours are broadcast: those of 250,000 edges of two longs.
FEW = 4_000_000


def _large_star(e: DataFrame, hint) -> DataFrame:
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, hint) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(hint(least), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(e: DataFrame) -> tuple:
    """(edges, sum of their hashes, bytes of their nodes)."""
    wide = e.schema["a"].dataType.typeName() in ("string", "binary")
    size = F.octet_length("a") + F.octet_length("b") if wide else F.lit(16)
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.coalesce(F.sum(size), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges: columns a and b of one orderable type. Nulls, loops and repeated edges are ignored; no edge gives no row.
    """
    e = edges.where("a is not null and b is not null and a != b").select("a", "b")
    e = stage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(e)
    while before[0]:
        hint = F.broadcast if before[2] <= FEW else lambda x: x
        old, e = e, stage(_small_star(_large_star(e, hint), hint))
        unstage(old)
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select("b", "b")).distinct()
