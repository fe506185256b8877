"""Operators on points: rows with a position instead of a start and an end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra
from ..schema import keys


def normalize(df: DataFrame) -> DataFrame:
    """Each position of an axis once."""
    return df.select(*keys(df), "pos").distinct()


def sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*keys(df), "pos")


def summary(df: DataFrame) -> DataFrame:
    """Per axis: number of points, smallest and largest position."""
    return df.groupBy(*keys(df)).agg(F.count("*").alias("npoints"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"))


def in_intervals(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points that lie in any interval; repeated points stay repeated."""
    return algebra.overlapping(df, intervals)


def count_in_intervals(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per track: points that lie in any interval, repeated ones counted."""
    hit = in_intervals(df, intervals).groupBy("track").agg(F.count("*").alias("n"))
    return df.select("track").distinct().join(hit, "track", "left").select("track", F.coalesce("n", F.lit(0)).cast("long").alias("npoints"))


def count_in_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Per axis: points in one range."""
    return algebra.overlap_with_range(df, start, end)


def insertion_point(df: DataFrame, pos: int) -> DataFrame:
    """Per axis: points before pos; -1 if pos is before the first, and their number if it isn't before the last."""
    n = F.count("*")
    at = F.when(F.min("pos") > pos, -1).when(F.max("pos") <= pos, n).otherwise(F.count_if(F.col("pos") < pos))
    return df.groupBy(*keys(df)).agg(at.cast("long").alias("insertion_point"))
