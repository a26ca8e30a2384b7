"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u long, v long)``; root is the smallest node reachable.

    Each step joins the edges with the smallest neighbour of each node: minima are partial
    aggregates, and the join's large keys can be split by adaptive execution, so no neighbour list
    is ever gathered. Rounds end when the edges are stars that a round leaves as they were. Edge
    tables live in the shared folder; nothing but two counters reaches the driver.

    Defined results: edges with a null end and loops count for nothing, repeats once; an empty
    table gives no row.
    """
    clean = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u != v")
    # From here on u > v: v is the smaller end.
    now = scratch.keep(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        after = scratch.keep(_small_star(_large_star(now)))
        scratch.drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour, itself included."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    # Only larger neighbours move on: v of an edge (u, v) with v > u.
    return edges.join(least, edges["v"] == least["k"]).select(F.col("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = edges.join(least, edges["u"] == least["k"])
    return moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
