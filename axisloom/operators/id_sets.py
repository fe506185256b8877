"""Annotations that are sets of ids, where ids have intervals: clean-up, support, counts in subsets of axes.

sets: annotation, id (repeated rows count once). ids: id, contig, start, end, several rows an id if
need be. Work that follows the intervals is done per id first; only then do ids meet the sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import algebra, names


def _bases() -> Column:
    return F.col("end") - F.col("start")


def _common() -> Column:
    return F.least("end", "end_b") - F.greatest("start", "start_b")


def _pairs(sets: DataFrame) -> DataFrame:
    return sets.select("annotation", "id").filter("annotation is not null and id is not null").distinct()


def _placed(ids: DataFrame) -> DataFrame:
    return algebra.normalize(ids.select(F.col("id").alias("track"), "contig", "start", "end"))


def one_name(sets: DataFrame, ids: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets and ids with the smallest of its synonyms (pairs name, synonym) for each id, for all that follows.

    Intervals of synonyms become those of one id, and sets that differ by synonyms only become alike.
    """
    found = names.classes(synonyms)
    return names.renamed(sets, found, "id"), names.renamed(ids, found, "id")


def unused(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """id: those with intervals that no set names."""
    return ids.select("id").distinct().join(_pairs(sets), "id", "left_anti")


def report(sets: DataFrame, ids: DataFrame, workspace: DataFrame) -> DataFrame:
    """What clean-up makes of each annotation.

    annotation, n_ids, n_undefined (ids without intervals), n_outside (none of whose bases lie in the
    workspace), n_left, same_as (the smallest annotation with exactly the same ids left, null where
    that is itself or none are left), kept (some ids are left, and it is the smallest of its like).
    An annotation's ids are gathered to compare them; no more than there are ids.
    """
    space = workspace.drop("track")
    known = ids.select("id").distinct().withColumn("known", F.lit(True))
    inside = algebra.overlapping(_placed(ids), space).select(F.col("track").alias("id")).distinct().withColumn("inside", F.lit(True))
    pairs = _pairs(sets).join(known.join(inside, "id", "left"), "id", "left")
    each = pairs.groupBy("annotation").agg(F.count("*").alias("n_ids"), F.count_if(F.col("known").isNull()).alias("n_undefined"), F.count_if(F.col("known") & F.col("inside").isNull()).alias("n_outside"), F.count_if("inside").alias("n_left"), F.array_sort(F.collect_list(F.when(F.col("inside"), F.col("id")))).alias("left"))
    first = each.filter("n_left > 0").groupBy("left").agg(F.min("annotation").alias("first"))
    out = each.join(first, "left", "left")
    same = F.when(F.col("first") != F.col("annotation"), F.col("first"))
    return out.select("annotation", "n_ids", "n_undefined", "n_outside", "n_left", same.alias("same_as"), ((F.col("n_left") > 0) & same.isNull()).alias("kept"))


def cleaned(sets: DataFrame, ids: DataFrame, workspace: DataFrame) -> DataFrame:
    """annotation, id: the sets that report() keeps, with the ids that lie in the workspace."""
    inside = algebra.overlapping(_placed(ids), workspace.drop("track")).select(F.col("track").alias("id")).distinct()
    good = report(sets, ids, workspace).filter("kept").select("annotation")
    return _pairs(sets).join(inside, "id", "left_semi").join(good, "annotation", "left_semi")


def supported(observed: DataFrame, sampled: DataFrame, least: float | Column) -> DataFrame:
    """Observed rows of the pairs whose observed value and mean of samples are both `least` or more."""
    on = ["counter", "track", "annotation"]
    enough = sampled.groupBy(*on).agg(F.avg("value").alias("mean")).filter(F.col("mean") >= least)
    return observed.filter(F.col("observed") >= least).join(enough.select(*on), on, "left_semi")


def mutual_overlap(strata: DataFrame) -> DataFrame:
    """contig, track, other, bases: what strata, which should be disjoint, have in common."""
    s = algebra.normalize(strata)
    return algebra.overlap_join(s, s).filter("track < track_b").groupBy("contig", "track", F.col("track_b").alias("other")).agg(F.sum(_common()).alias("bases"))


def support(segments: DataFrame, workspace: DataFrame) -> DataFrame:
    """How each axis of the workspace is filled by each track that has bases there.

    track, contig, size (of the workspace), n_pieces, bases, density, mean and sd of the pieces' lengths.
    """
    w = algebra.normalize(workspace.drop("track"))
    size = w.groupBy("contig").agg(F.sum(_bases()).alias("size"))
    parts = algebra.intersect(algebra.normalize(segments), w)
    per = parts.groupBy("track", "contig").agg(F.count("*").alias("n_pieces"), F.sum(_bases()).alias("bases"), F.avg(_bases()).alias("mean"), F.stddev_pop(_bases()).alias("sd"))
    return per.join(size, "contig").select("track", "contig", "size", "n_pieces", "bases", (F.col("bases") / F.col("size")).alias("density"), "mean", "sd")


def subset_counts(segments: DataFrame, sets: DataFrame, ids: DataFrame, workspace: DataFrame, subsets: DataFrame) -> DataFrame:
    """Bases that the ids of each annotation share with segments in the workspace, by subset of axes.

    subsets: subset, contig; a contig may be in several. track, annotation (subset.annotation, or the
    annotation itself where the subset is ''), bases, share (of the segments' bases in the workspace
    and subset). Bases of two ids count for both; pairs that share none have a row of 0.
    """
    subsets = subsets.select("subset", "contig").distinct()
    inside = algebra.intersect(algebra.normalize(segments), algebra.normalize(workspace.drop("track")))
    total = inside.groupBy("track", "contig").agg(F.sum(_bases()).alias("total")).join(subsets, "contig").groupBy("track", "subset").agg(F.sum("total").alias("total"))
    per = algebra.overlap_join(inside, _placed(ids)).groupBy("track", "contig", F.col("track_b").alias("id")).agg(F.sum(_common()).alias("bases"))
    per = per.join(subsets, "contig").groupBy("track", "subset", "id").agg(F.sum("bases").alias("bases"))
    got = per.join(_pairs(sets), "id").groupBy("track", "subset", "annotation").agg(F.sum("bases").alias("bases"))
    # zeros come from the list of names, which is as long as the result
    names = _pairs(sets).agg(F.array_sort(F.collect_set("annotation"))).scalar()
    full = total.withColumn("annotation", F.explode(names)).join(got, ["track", "subset", "annotation"], "left")
    name = F.when(F.col("subset") == "", F.col("annotation")).otherwise(F.concat_ws(".", "subset", "annotation"))
    bases = F.coalesce("bases", F.lit(0).cast("long"))
    return full.select("track", name.alias("annotation"), bases.alias("bases"), F.when(F.col("total") > 0, bases / F.col("total")).otherwise(0.0).alias("share"))
