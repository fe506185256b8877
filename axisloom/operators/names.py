"""Names that stand for the same thing: classes of synonyms, and tables under one name for each class.

Pairs of synonyms may form chains and cycles of any length. Classes are found by alternating two steps
over the pairs: every name's larger neighbours, then all its smaller ones, are tied to the smallest
name it is tied to. A step is a grouped minimum and an equi-join, so no class is ever gathered, and
rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import delete, kept


def _tied(pairs: DataFrame) -> DataFrame:
    """name, least: distinct pairs of different names, the smaller one second."""
    return pairs.select(F.greatest("name", "least").alias("name"), F.least("name", "least").alias("least")).filter("name <> least").distinct()


def _larger(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("least").alias("name"), F.col("name").alias("least")))
    root = both.groupBy("name").agg(F.min("least").alias("root")).select("name", F.least("name", "root").alias("root"))
    return _tied(both.filter("least > name").join(root, "name").select(F.col("least").alias("name"), F.col("root").alias("least")))


def _smaller(pairs: DataFrame) -> DataFrame:
    root = pairs.groupBy("name").agg(F.min("least").alias("root"))
    moved = pairs.join(root, "name").select(F.col("least").alias("name"), F.col("root").alias("least"))
    return _tied(moved.unionByName(root.select("name", F.col("root").alias("least"))))


def classes(pairs: DataFrame, a: str = "name", b: str = "synonym") -> DataFrame:
    """name, least: every name of a pair of two different names, with the smallest name of its class.

    Pairs with a null are ignored, repeated ones and those the other way round count once, and a name
    that is only its own synonym has no row. The result is a kept table.
    """
    now = kept(_tied(pairs.select(F.col(a).cast("string").alias("name"), F.col(b).cast("string").alias("least")).dropna()))
    mark = None
    while True:
        after = kept(_smaller(_larger(now)))
        state = after.agg(F.count("*"), F.sum(F.xxhash64("name", "least").cast("decimal(38,0)"))).first()
        delete(now)
        now = after
        if state == mark or not state[0]:
            break
        mark = state
    out = kept(now.unionByName(now.select(F.col("least").alias("name"), "least").distinct()))
    delete(now)
    return out


def renamed(df: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """df with the smallest name of its class in each of the columns; other names, and nulls, stay."""
    for c in columns:
        one = found.select(F.col("name").alias("_name"), F.col("least").alias("_least"))
        order = df.columns
        df = df.join(one, F.col(c) == F.col("_name"), "left").withColumn(c, F.coalesce("_least", F.col(c))).select(*order)
    return df
