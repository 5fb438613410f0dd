"""Connected components of a graph of links, by alternating large and small stars.

Every step is a min-aggregate and a join of edge tables, so no component is gathered anywhere; the
edges of a hub are dealt over many tasks. Each round is cut with a checkpoint; the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.llm.common import dealt_join, durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex points its larger neighbours to the least of itself and its neighbours."""
    both = durable(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
    return dealt_join(both.filter("v > u"), least, "u", "rows").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex points itself and its smaller neighbours to the least of these; edges have v < u."""
    least = durable(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")))
    joined = dealt_join(edges, least, "u", "rows")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every vertex of edges (u, v), root being the least vertex of its component.

    Nulls and loops are passed over; repeated and reversed edges are one. No edges give no rows.
    """
    edges = edges.filter("u is not null and v is not null and u != v")
    edges = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _sum(edges)) != before:
        before = now
        if not now[0]:
            break
        edges = durable(_small_star(durable(_large_star(edges))))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
