"""Aggregates over intervals, counts and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import algebra
from ..schema import keys
from ..storage import kept


def _length() -> Column:
    return F.col("end") - F.col("start")


def bounds(df: DataFrame, by: tuple[str, ...] = ("track", "contig")) -> DataFrame:
    """Bases, and smallest and largest coordinate (0 of nothing)."""
    zero = F.lit(0).cast("long")
    return df.groupBy(*by).agg(F.coalesce(F.sum(_length()), zero).alias("length"), F.coalesce(F.min("start"), zero).alias("min_start"), F.coalesce(F.max("end"), zero).alias("max_end"))


def largest(df: DataFrame, by: tuple[str, ...] = ("track", "contig")) -> DataFrame:
    """The longest interval, the first of equals."""
    best = F.max_by(F.struct("start", "end"), F.struct(_length(), -F.col("start"))).alias("best")
    return df.groupBy(*by).agg(best).select(*by, F.col("best.start").alias("start"), F.col("best.end").alias("end"))


def length_summary(df: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Mean, smallest, largest and total length."""
    return df.groupBy(*by).agg(F.avg(_length()).alias("mean_length"), F.min(_length()).alias("min_length"), F.max(_length()).alias("max_length"), F.sum(_length()).alias("total_length"))


def length_histogram(df: DataFrame, bucket_size: int = 1, nbuckets: int = 100_000, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Intervals by ceil(length / bucket_size); 0 takes the least size that fits all. A bucket beyond nbuckets is an error."""
    size = F.lit(bucket_size) if bucket_size else df.agg(F.greatest(F.lit(1), F.ceil(F.max(_length()) / nbuckets))).scalar()
    bucket = F.floor((_length() + size - 1) / size).cast("long")
    legal = F.when(bucket >= nbuckets + (0 if bucket_size else 1), F.raise_error(F.lit("an interval is too long for the histogram")).cast("long")).otherwise(bucket)
    return df.select(*by, legal.alias("bucket")).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


_BUCKETS = 1024


def order_statistics(df: DataFrame, value: Column, ranks: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Per group `nval` and, for each name, the sorted values' element at a rank from 0, a column of nval.

    Between two elements, fractional ranks interpolate. Equal values are counted first; a histogram of each group's
    values then tells which buckets hold the ranks, and only those buckets' values are put in order, so neither an
    array nor a task holds a group.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = df.select(*by, key.alias("_key"), value.cast("double").alias("_v")).filter("_v is not null")
    counts = kept(rows.groupBy("_key", *by, "_v").agg(F.count("*").alias("_k")))
    span = counts.groupBy("_key", *by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_k").alias("nval"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    placed = counts.select("_key", "_v", "_k").join(span.select("_key", "_lo", "_hi"), "_key").withColumn("_bucket", F.floor(share * (_BUCKETS - 1)))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    heads = placed.groupBy("_key", "_bucket").agg(F.sum("_k").alias("_in"))
    heads = heads.withColumn("_before", F.sum("_in").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(*so_far)) - F.col("_in"))
    asked = [F.struct(F.lit(name).alias("name"), end(at).cast("long").alias("rank")) for name, at in ranks.items() for end in (F.floor, F.ceil)]
    wanted = span.select("_key", F.inline(F.array_distinct(F.array(*asked))))
    wanted = wanted.join(heads, (wanted["_key"] == heads["_key"]) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_in"))).select(wanted["_key"], "name", "rank", "_bucket", "_before")
    opened = placed.join(wanted.select("_key", "_bucket", "_before").distinct(), ["_key", "_bucket"])
    upto = F.sum("_k").over(Window.partitionBy("_key", "_bucket").orderBy("_v").rowsBetween(*so_far)) + F.col("_before")
    opened = opened.select("_key", "_bucket", "_v", (upto - F.col("_k")).alias("_from"), upto.alias("_upto"))
    hit = wanted.drop("_before").join(opened, ["_key", "_bucket"]).filter("rank >= _from and rank < _upto")
    both = hit.groupBy("_key", "name").agg(F.min(F.struct("rank", "_v")).alias("a"), F.max(F.struct("rank", "_v")).alias("b"))
    out = both.groupBy("_key").agg(*[F.max(F.when(F.col("name") == name, F.struct("a", "b"))).alias("_" + name) for name in ranks])
    out = span.join(out, "_key", "left")
    part = lambda name, at: F.col(f"_{name}.a._v") + (F.col(f"_{name}.b._v") - F.col(f"_{name}.a._v")) * (at - F.floor(at))
    return out.select(*by, "_key", "nval", *[part(name, at).alias(name) for name, at in ranks.items()])


def summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, min, max, mean, median, population deviation, sum, and quartiles as elements of the sorted values."""
    v, n = F.col(value).cast("double"), F.col("nval")
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    out = df.filter(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("nval"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.sum(v).alias("sum"))
    ranks = {"median": (n - 1) / 2, "q1": F.floor(n / 4), "q3": F.floor(n * 3 / 4)}
    found = order_statistics(df, v, ranks, by).select("_key", *ranks)
    return out.withColumn("_key", key).join(found, "_key").select(*by, "nval", "min", "max", "mean", "median", "stddev", "sum", "q1", "q3")


def percentiles(df: DataFrame, value: Column, at: list[float], by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Linearly interpolated percentiles, one row each."""
    found = order_statistics(df, value, {f"p{i}": (F.col("nval") - 1) * p for i, p in enumerate(at)}, by)
    return found.select(*by, F.inline(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"p{i}").alias("value")) for i, p in enumerate(at)])))


def stats_rollup(df: DataFrame) -> DataFrame:
    """Intervals and bases of each contig of each track, and of each track as contig `total`."""
    out = df.rollup("track", "contig").agg(F.count("*").alias("nsegments"), F.sum(_length()).alias("length"))
    return out.filter(F.col("track").isNotNull()).select("track", F.coalesce("contig", F.lit("total")).alias("contig"), "nsegments", "length")


def overlap_stats(df: DataFrame, workspace: DataFrame) -> DataFrame:
    """Per track and contig of the workspace: bases in it, workspace bases, and their ratio."""
    size = workspace.groupBy("contig").agg(F.sum(_length()).alias("length")).filter("length > 0")
    common = algebra.intersect(df, workspace).groupBy("track", "contig").agg(F.sum(_length()).alias("overlap"))
    present = df.select("track", "contig").distinct()
    out = present.join(size, "contig").join(common, ["track", "contig"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    return out.select("track", "contig", "overlap", "length", (F.col("overlap") / F.col("length")).alias("density"))


def segment_metrics(df: DataFrame, workspace: DataFrame) -> DataFrame:
    """Per axis of normalized segments: how they lie in, across and outside the normalized workspace.

    Segments that overlap the workspace are counted by piece, so one across two of its intervals counts twice,
    and "outside" may be negative. All figures are sums of what is looked up where segments begin and end in one
    sweep along the workspace: its intervals, bases and gaps so far.
    """
    by = keys(df)
    ax = [k for k in ("contig", "isochore") if k in by and k in workspace.columns]
    space = algebra.numbered(workspace.select(*ax, "start", "end"))
    # at their ends, what begins there is not yet of the workspace
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(True).alias("_first")), F.struct((F.col("end") - 1).alias("pos"), F.lit(False).alias("_first")))
    points = df.filter("end > start").select(*by, "start", "end", F.inline(ends))
    found = algebra.lookup(points, space, ax)
    zero = F.lit(0).cast("long")
    w = lambda c: F.coalesce(F.col("before." + c), zero)
    reach = w("end")
    upto = F.when(F.col("_first"), F.col("start")).otherwise(F.col("end"))
    # of the workspace's intervals that begin before: how many, their bases below the position, the gaps that ended
    begun = F.when(F.col("before").isNotNull(), w("n") + 1).otherwise(zero)
    bases = F.when(F.col("before").isNotNull(), w("bases") + F.least(reach, upto) - w("start")).otherwise(zero)
    first, last = F.col("_first"), ~F.col("_first")
    held = first & (reach > F.col("start"))
    pieces = F.when(last, begun).otherwise(-begun + held.cast("long"))
    beyond = F.when(last, w("gaps") + (reach < F.col("end")).cast("long")).otherwise(-w("gaps"))
    touches = held | (first & F.coalesce(F.col("after.start") < F.col("end"), F.lit(False)))
    out = found.groupBy(*by).agg(
        F.count_if("_first").alias("all_n"),
        F.sum(F.when(first, _length())).alias("all_bases"),
        F.sum(pieces).alias("inside_n"),
        F.sum(F.when(last, bases).otherwise(-bases)).alias("inside_bases"),
        F.sum(beyond).alias("beyond_n"),
        F.coalesce(F.sum(F.when(touches, _length())), zero).alias("touching_bases"),
    )
    size = workspace.groupBy(*ax).agg(F.sum(_length()).alias("_space"))
    out = out.withColumn("beyond_bases", F.col("all_bases") - F.col("inside_bases")).join(size, ax, "left")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        *by,
        F.col("all_n").alias("all_segments"),
        F.col("all_bases").alias("all_nucleotides"),
        F.col("inside_n").alias("segments_overlapping_workspace"),
        F.col("inside_bases").alias("nucleotides_overlapping_workspace"),
        (F.col("all_n") - F.col("inside_n")).alias("segments_outside_workspace"),
        (F.col("all_bases") - F.col("inside_bases")).alias("nucleotides_outside_workspace"),
        F.col("beyond_n").alias("truncated_segments"),
        F.col("beyond_bases").alias("truncated_nucleotides"),
        ratio("inside_bases", "_space").alias("density_workspace"),
        ratio("beyond_n", "inside_n").alias("proportion_truncated_segments"),
        ratio("beyond_bases", "touching_bases").alias("proportion_extending_nucleotides"),
    )


METRICS = ("all_segments", "all_nucleotides", "segments_overlapping_workspace", "nucleotides_overlapping_workspace", "nucleotides_outside_workspace", "truncated_segments", "truncated_nucleotides", "density_workspace", "proportion_truncated_segments", "proportion_extending_nucleotides")


def metrics_table(metrics: DataFrame, section: str = "segments") -> DataFrame:
    """track, section, metric and the summary of the metric over the track's axes."""
    long = metrics.select("track", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(["track"], list(METRICS), "metric", "value")
    return summary(long, "value", ("track", "metric")).withColumn("section", F.lit(section))


def sample_stats(samples: DataFrame) -> DataFrame:
    """Length statistics of each sample of each track, and of all samples as sample_id null."""
    by = ("track", "sample_id")
    rows = samples.select("track", "sample_id", _length().alias("_n"))
    rows = rows.unionByName(rows.withColumn("sample_id", F.lit(None).cast(rows.schema["sample_id"].dataType))).filter("track is not null")
    n = F.col("_n")
    out = rows.groupBy(*by).agg(F.count("*").alias("nsegments"), F.sum(n).alias("length"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("stddev"), F.min(n).alias("min"), F.max(n).alias("max"))
    ranks = {name: (F.col("nval") - 1) * p for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    found = order_statistics(rows, n, ranks, by).select("_key", *ranks)
    return out.withColumn("_key", F.to_json(F.struct(*by))).join(found, "_key").select(*by, "nsegments", "length", "mean", "stddev", "min", "q1", "median", "q3", "max")
