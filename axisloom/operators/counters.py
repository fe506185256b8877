"""Measures of association between segment tracks and annotation tracks.

A counter maps (segments, annotations, workspace) to (track, annotation, [sample_id], value), summed
over contigs and isochores, with a row for each pair that has any. observed() and sampled() add the
pairs that have none, as 0, from the short lists of tracks. Other counters can be registered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra
from ..schema import axis

Counter = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
COUNTERS: dict[str, Counter] = {}


def register(name: str) -> Callable[[Counter], Counter]:
    def add(f: Counter) -> Counter:
        COUNTERS[name] = f
        return f

    return add


def _ids(segments: DataFrame) -> list[str]:
    return ["track", *(["sample_id"] if "sample_id" in segments.columns else [])]


def _named(annotations: DataFrame) -> DataFrame:
    """Annotations with their track under another name, so that rows of the join tell both."""
    return annotations.withColumnRenamed("track", "annotation")


def _bases(segments: DataFrame, annotations: DataFrame, by: list[str]) -> DataFrame:
    pairs = algebra.overlap_join(segments, _named(annotations))
    size = F.lit(1) if "pos" in annotations.columns else F.least("end", "end_b") - F.greatest("start", "start_b")
    return pairs.groupBy(*by, F.col("annotation_b").alias("annotation")).agg(F.sum(size).cast("double").alias("value"))


@register("nucleotide-overlap")
def nucleotide_overlap(segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> DataFrame:
    """Bases that both cover; of point annotations, points in segments."""
    return _bases(segments, annotations, _ids(segments))


def _density(per: str) -> Counter:
    def count(segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> DataFrame:
        on = [c for c in axis(segments) if c in workspace.columns]
        size = workspace.groupBy(*on).agg(F.expr(per).alias("_size"))
        bases = _bases(segments, annotations, [*_ids(segments), *on]).join(size, on)
        return bases.groupBy(*_ids(segments), "annotation").agg(F.sum(F.when(F.col("_size") > 0, F.col("value") / F.col("_size")).otherwise(0.0)).alias("value"))

    return count


#: Overlap as a share of the workspace's bases on each axis.
COUNTERS["nucleotide-density"] = _density("sum(`end` - `start`)")
#: The same per interval of the workspace.
COUNTERS["nucleotide-density-compat"] = _density("count(*)")


def _count(left: DataFrame, right: DataFrame, by_left: list[str], by_right: list[str], mid: bool, first_only: bool) -> DataFrame:
    """Left rows that overlap the right rows of each group: one row per (left row, group), counted."""
    pairs = algebra.overlap_join(left, right)
    own = [c for c in left.columns if c in ("track", "annotation", "contig", "isochore", "sample_id", "start", "end", "pos")]
    group = [c + "_b" for c in by_right]
    if mid and "pos" not in left.columns:
        point = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("long")
        lo, hi = (F.col("pos_b"), F.col("pos_b") + 1) if "pos" in right.columns else (F.col("start_b"), F.col("end_b"))
        if first_only:
            best = pairs.groupBy(*own, *group).agg(F.min(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("_f"))
            hits = best.filter((point >= F.col("_f.lo")) & (point < F.col("_f.hi")))
        else:
            hits = pairs.filter((point >= lo) & (point < hi)).select(*own, *group).distinct()
    else:
        hits = pairs.select(*own, *group).distinct()
    # rows of left that are equal count as often as they are there
    times = left.groupBy(*own).agg(F.count("*").alias("_times"))
    renamed = times.select(*[F.col(c).alias("_" + c) for c in own], "_times")
    match = F.lit(True)
    for c in own:
        match = match & (hits[c].eqNullSafe(renamed["_" + c]) if c == "isochore" else hits[c] == renamed["_" + c])
    joined = hits.join(renamed, match) if "pos" in left.columns else hits.withColumn("_times", F.lit(1))
    return joined.groupBy(*by_left, *[F.col(g).alias(g.removesuffix("_b")) for g in group]).agg(F.sum("_times").cast("double").alias("value"))


def _segments(mid: bool, first_only: bool = False) -> Counter:
    def count(segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> DataFrame:
        return _count(segments, _named(annotations), _ids(segments), ["annotation"], mid, first_only)

    return count


def _annotations(mid: bool, first_only: bool = False) -> Counter:
    def count(segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> DataFrame:
        return _count(_named(annotations), segments, ["annotation"], _ids(segments), mid, first_only).select(*_ids(segments), "annotation", "value")

    return count


#: Normalized segments that overlap an annotation, or whose midpoint lies in one.
COUNTERS["segment-overlap"] = _segments(False)
COUNTERS["segment-midoverlap"] = _segments(True)
COUNTERS["segment-midoverlap-compat"] = _segments(True, first_only=True)
#: Normalized annotations that overlap a segment, or whose midpoint lies in one.
COUNTERS["annotation-overlap"] = _annotations(False)
COUNTERS["annotation-midoverlap"] = _annotations(True)
COUNTERS["annotation-midoverlap-compat"] = _annotations(True, first_only=True)


def pairs_of(segments: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every (track, annotation): names only, at most some thousand of each."""
    names = annotations.agg(F.array_sort(F.collect_set("track"))).scalar()
    return segments.select("track").distinct().withColumn("annotation", F.explode(names))


def observed(counter: str, segments: DataFrame, annotations: DataFrame, workspace: DataFrame) -> DataFrame:
    """counter, track, annotation, observed for all pairs, 0 where they don't meet."""
    found = COUNTERS[counter](segments, annotations, workspace)
    out = pairs_of(segments, annotations).join(found, ["track", "annotation"], "left")
    return out.select(F.lit(counter).alias("counter"), "track", "annotation", F.coalesce("value", F.lit(0.0)).alias("observed"))


def sampled(counter: str, samples: DataFrame, annotations: DataFrame, workspace: DataFrame, nsamples: int, pairs: DataFrame) -> DataFrame:
    """counter, track, annotation, sample_id, value for all pairs and samples, 0 where they don't meet."""
    return completed(counter, COUNTERS[counter](samples, annotations, workspace), nsamples, pairs)


def completed(counter: str, found: DataFrame, nsamples: int, pairs: DataFrame) -> DataFrame:
    """The same from values that were counted elsewhere (track, annotation, sample_id, value)."""
    full = pairs.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(nsamples - 1))))
    out = full.join(found, ["track", "annotation", "sample_id"], "left")
    return out.select(F.lit(counter).alias("counter"), "track", "annotation", "sample_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def nearest_distance(segments: DataFrame, annotations: DataFrame, radius: int | None = None) -> DataFrame:
    """Extension: per segment and annotation track, the distance to the nearest annotation (0: they overlap), however far.

    Both sides normalized; pairs without any on the contig have no row, nor have those at radius or farther, if given.
    """
    names = annotations.agg(F.array_sort(F.collect_set("track"))).scalar()
    points = segments.select("track", "contig", "start", "end", (F.col("end") - 1).alias("pos"), F.explode(names).alias("annotation"))
    found = algebra.lookup(points, annotations.select(F.col("track").alias("annotation"), "contig", "start", "end"), ["annotation", "contig"])
    # the last one that begins before the segment's end also ends last; least() passes over nulls
    before = F.when(F.col("before").isNotNull(), F.greatest(F.col("start") - F.col("before.end"), F.lit(0).cast("long")))
    gap = F.least(before, F.col("after.start") - F.col("end"))
    out = found.select("track", "contig", "start", "end", "annotation", gap.alias("distance")).filter("distance is not null")
    return out if radius is None else out.filter(F.col("distance") < radius)
