"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node that it reaches.

    A node's least neighbour is found by a partial aggregation, so a node with very many neighbours is no bottleneck. Each
    round is written to the shared folder. Edges from a node to itself, null ends and repeated edges do no harm; no edges give no rows.
    """
    first = stored(edges.filter("a is not null and b is not null").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct())
    loops, now, older = first.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")), first.filter("a > b"), None
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        now = stored(small)
        if older is not None:
            dropped(older)
        older = now
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
