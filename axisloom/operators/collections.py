"""Operators on collections: several tracks of intervals at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import algebra
from ..schema import keys


def tracks(df: DataFrame) -> DataFrame:
    return df.select("track").distinct()


def totals(df: DataFrame) -> DataFrame:
    """Number of intervals and bases of everything."""
    return df.agg(F.count("*").alias("nsegments"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("length"))


def counts_per_track(df: DataFrame) -> DataFrame:
    return df.groupBy("track").agg(F.count("*").alias("nsegments"))


def restrict(df: DataFrame, *names: str) -> DataFrame:
    """Only these tracks."""
    return df.filter(F.col("track").isin(*names))


def merged_tracks(df: DataFrame, delete: bool = True, name: str = "merged") -> DataFrame:
    """All tracks' rows as one track, not normalized; with the old tracks unless they are deleted."""
    one = df.withColumn("track", F.lit(name))
    return one if delete else df.unionByName(one)


def collapse(df: DataFrame, name: str = "collapsed", exact_pieces: bool = False) -> DataFrame:
    """What all (normalized) tracks cover, on contigs that all of them have.

    By default in maximal stretches. With exact_pieces, tracks are intersected one after another,
    which keeps the borders that any of them has inside a stretch.
    """
    by = [k for k in keys(df) if k != "track"]
    if exact_pieces:
        names = [r.track for r in tracks(df).orderBy("track").collect()]  # as many as the tracks
        out = restrict(df, names[0]).select(*by, "start", "end") if names else df.select(*by, "start", "end")
        for n in names[1:]:
            out = algebra.intersect(out, restrict(df, n).select(*by, "start", "end"))
    else:
        n = df.agg(F.count_distinct("track")).scalar()
        out = algebra.coverage(df.select(*by, "start", "end"), n)
    return out.select(F.lit(name).alias("track"), *by, "start", "end")


def to_isochores(df: DataFrame, isochores: DataFrame, truncate: bool = True) -> DataFrame:
    """df with an isochore column: clipped to the isochores, or whole in each that it touches."""
    strata = isochores.withColumnRenamed("track", "isochore").select("contig", F.col("isochore").alias("stratum"), "start", "end")
    pairs = algebra.overlap_join(df, strata)
    if truncate:
        pairs = pairs.withColumns({"start": F.greatest("start", "start_b"), "end": F.least("end", "end_b")})
    rows = pairs.select("track", "contig", F.col("stratum_b").alias("isochore"), "start", "end")
    return rows if truncate else rows.distinct()


def from_isochores(df: DataFrame) -> DataFrame:
    """Isochores joined again: per contig, with touching pieces merged."""
    if "isochore" not in df.columns:
        return df
    return algebra.merge(df.drop("isochore"), 0)


def bed_merge(df: DataFrame) -> DataFrame:
    """Overlapping rows joined, up to their largest end; touching rows stay apart."""
    return algebra.normalize(df)


def bin_edges(df: DataFrame, bins: int, method: str = "equal-bases", score: str = "score") -> DataFrame:
    """One row: `edges`, the scores at which bins begin, and the largest score plus 1."""
    if method == "equal-range":
        lo, hi = F.min(score), F.max(score)
        step = (hi - lo) / F.lit(bins)
        inner = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: lo + i * step)
        return df.agg(F.concat(inner, F.array(hi + 1)).alias("edges"))
    size = {"equal-bases": F.col("end") - F.col("start"), "equal-intervals": F.lit(1).cast("long")}
    if method not in size:
        raise ValueError("method must be equal-bases, equal-intervals or equal-range")
    # one row per score, so the running sum is over distinct scores and not over intervals
    per = df.groupBy(F.col(score).cast("double").alias("v")).agg(F.sum(size[method]).cast("double").alias("n"))
    order = W.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = per.select("v", F.sum("n").over(order).alias("sums"), F.sum("n").over(W.partitionBy()).alias("total"), F.min("v").over(W.partitionBy()).alias("lo"), F.max("v").over(W.partitionBy()).alias("hi"))
    share = F.ceil(F.col("sums") * bins / F.col("total")) - 1
    opened = per.groupBy(share.alias("k")).agg(F.min("v").alias("v"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    all_ = opened.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_set(F.when(F.col("k") > 0, F.col("v")))).alias("inner"))
    return all_.select(F.concat(F.array("lo"), F.filter("inner", lambda v: v > F.col("lo")), F.array(F.col("hi") + 1)).alias("edges"))


def bin_intervals(df: DataFrame, bins: int = 5, method: str = "equal-bases", edges: list[float] | None = None, score: str = "score") -> DataFrame:
    """contig, start, end, bin: runs of intervals in order of start whose scores fall into one bin."""
    limits = F.array(*[F.lit(float(e)) for e in edges]) if edges else bin_edges(df, bins, method, score).scalar()
    rows = df.select("contig", "start", "end", F.col(score).cast("double").alias("_v")).withColumn("_edges", limits)
    rows = rows.withColumn("bin", F.size(F.filter("_edges", lambda e: e <= F.col("_v"))) - 1).drop("_edges")
    block = algebra._block(F.col("start"), algebra.BLOCK)
    rows = rows.withColumn("_block", block)
    local = W.partitionBy("contig", "_block").orderBy("start", "end", "_v")
    # runs within blocks, then runs of runs: only the first and last of a block can go on
    rows = rows.withColumn("_new", (F.coalesce(F.lag("bin").over(local), F.lit(-1)) != F.col("bin")).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(local.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = rows.groupBy("contig", "_block", "_run", "bin").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end", "_v")).alias("end"))
    order = W.partitionBy("contig").orderBy("_block", "_run")
    runs = runs.withColumn("_new", (F.coalesce(F.lag("bin").over(order), F.lit(-1)) != F.col("bin")).cast("int"))
    runs = runs.withColumn("_all", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.groupBy("contig", "_all", "bin").agg(F.min("start").alias("start"), F.max_by("end", F.struct("_block", "_run")).alias("end")).select("contig", "start", "end", "bin")


def common(df: DataFrame, needed: DataFrame) -> DataFrame:
    """What at least `depth` rows of an axis cover; needed: the axis' columns and depth. Stretches that touch are joined."""
    by = keys(needed)
    deep = algebra.depths(df.select(*by, "start", "end")).join(needed, by).filter("n >= depth")
    return algebra.merge(deep, 0)


def inverted(df: DataFrame, key: str, value: str) -> DataFrame:
    """value and the sorted keys that have it."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias(key))


def flattened(df: DataFrame, column: str) -> DataFrame:
    """One row per element of a nested array column."""
    return df.withColumn(column, F.explode(F.flatten(column)))


def converted(df: DataFrame, column: str) -> DataFrame:
    """column as integer and float where the text is one, else null."""
    return df.withColumns({column + "_int": F.expr(f"try_cast(trim(`{column}`) as bigint)"), column + "_float": F.expr(f"try_cast(trim(`{column}`) as double)")})
