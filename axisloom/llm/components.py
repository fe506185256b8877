"""Connected components by alternating large-star and small-star.

Each half step is one grouped minimum and one equi-join, so no node's neighbours are ever gathered
in a task, and every round is written to the shared folder. Rounds grow with the logarithm of the
number of nodes; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import drop, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """e has u > v: each u points to some smaller v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component: its smallest node.

    Null ends and loops are ignored, repeated edges count once, and no edges give no rows. The result
    is a table in the shared folder, which drop() deletes.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a.isNotNull().alias("x"), b.isNotNull().alias("y"))
    e = stored(e.filter("x and y and u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        after = stored(_small_star(_large_star(e)), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(e)
        e = after
        if now == seen or not now[0]:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = stored(nodes.unionByName(roots), "components")
    drop(e)
    return out
