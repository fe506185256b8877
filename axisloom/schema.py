"""Canonical shapes of the engine's tables.

intervals: track, contig, [isochore], start, end   (half-open, BIGINT coordinates)
points:    track, contig, [isochore], pos
samples:   intervals with sample_id
observed:  counter, track, annotation, observed
sampled:   counter, track, annotation, sample_id, value

Columns beyond these are passed on where rows are kept, and dropped where rows are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ("track", "contig", "isochore", "sample_id")


def keys(df: DataFrame) -> list[str]:
    """The columns that split intervals into independent axes, as far as df has them."""
    return [k for k in GROUP if k in df.columns]


def axis(df: DataFrame) -> list[str]:
    """The columns that two sides of a join on position must share."""
    return [k for k in ("contig", "isochore") if k in df.columns]


def intervals(df: DataFrame, **renamed: str) -> DataFrame:
    """df with canonical names and types; renamed gives canonical=source names."""
    for name, source in renamed.items():
        df = df.withColumnRenamed(source, name)
    if missing := {"contig", "start", "end"} - set(df.columns):
        raise ValueError(f"intervals need {sorted(missing)}")
    return df.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


def null_safe(left: DataFrame, right: DataFrame, names: list[str]):
    """Join condition: equal, or null on both sides."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out
