"""Connected components of an edge table by alternating stars (Kiveris et al., 2014).

Each round links the larger neighbours of every node to its least neighbour, then
the smaller ones; the edges end as stars about the least node of each component.
Rounds grow with the logarithm of the number of nodes, long chains included.  A
node with very many edges costs no more than its edges: minima are aggregated
before the shuffle, and the joins are plain ones, whose skew Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronarch.llm.tables import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its least node.

    Edges with a null end and edges from a node to itself link nothing.  Repeated
    edges count once.  No edges: an empty table.
    """
    a, b = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    stars = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNull() | b.isNull()).alias("none"))
    stars = cut(stars.where("NOT none AND u <> v").select("u", "v").distinct())
    before = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                stars.select("v", "v").distinct()
            )
        before = state
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("least"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        stars = cut(small.union(least.select("w", "least")).distinct())
