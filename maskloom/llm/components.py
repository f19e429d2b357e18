"""Connected components of an undirected edge table by alternating large and small stars.

Edges, labels and components stay distributed; every round is written to the
shared folder, and the previous round is deleted once the next one exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import drop_saved, save


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` for each node ``u`` that is not the least of its component, with the least node ``v``.

    Nulls, loops and repeated edges change nothing; an empty table gives an empty one.
    """
    now = save(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        new = save(_small_star(_large_star(now)), "edges")
        drop_saved(now)
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return new
        now, state = new, mark
