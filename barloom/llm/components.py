"""Connected components of an edge table by alternating large and small stars.

Each round replaces the links of a node by links to the smallest of its neighbourhood, so the edge table never grows and
no component is gathered anywhere. The rounds end when the table is a forest of stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or its own and smaller) neighbours to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))
    joined = both.join(least, both["u"] == least["_u"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(_fp, root) of every node that has a link; root is the smallest node of its component. `edges` has a, b."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        big = written(_star(edges, True))
        new = written(_star(big, False))
        discard(edges), discard(big)
        # the sums change with the table and stand still once every node hangs on its root
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = new
        if now == mark:
            return edges.select(F.col("a").alias("_fp"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        mark = now
    raise RuntimeError("components did not settle")
