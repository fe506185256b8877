"""Monte-Carlo sampling: random sets of intervals per track, axis and sample number.

Segments, workspace and annotations are written once as sorted arrays by axis (axis_files); a task is
a row (track, axis, first sample), which maps the arrays it needs, so no input is shuffled again for samples,
tracks or batches. A sample's random stream depends on the seed, the track, the axis and the sample number only,
so results don't change with partitions, retries or batches. Samples can be returned as rows, or counted
where they are made (fused), which returns one number per pair, sample and axis instead of intervals.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import algebra
from ..functions.placement import PLACERS, Placer, Rows, Sorted, Space, across, merged, touching
from .axis_files import Axis, AxisFiles, written

BATCH = 25  # samples of a task that returns intervals
FRAME = 1 << 16  # intervals that it hands over at once
PER_CORE = 4  # tasks that count, for each core


def register(name: str):
    """Decorator: a function of options that returns a placer."""

    def add(f):
        PLACERS[name] = f
        return f

    return add


def _generator(seed: int, key: tuple, sample: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode()), sample])


def _dealt(axes: DataFrame, nsamples: int, batch: int) -> DataFrame:
    """A row for each batch of samples of each row, each in a partition of its own: few bytes can be hours of sampling."""
    n = axes.count() * -(-nsamples // batch)
    rows = axes.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(nsamples - 1), F.lit(batch))))
    return rows.repartition(max(1, min(n, 20_000)))


def _axes(segments: AxisFiles, workspace: AxisFiles) -> DataFrame:
    """track, contig, isochore where a track has segments and there is a workspace."""
    return segments.sets.select(F.col("name").alias("track"), "contig", "isochore").join(workspace.sets.select("contig", "isochore"), ["contig", "isochore"]).select("track", "contig", "isochore")


def _samples(track: str, contig: str, isochore: str, number: int, x: np.ndarray):
    """One sample's rows in frames of bounded size, as names repeated in every row take many times what intervals do."""
    for at in range(0, len(x), FRAME):
        part = x[at : at + FRAME]
        yield pd.DataFrame({"track": track, "contig": contig, "isochore": isochore or None, "sample_id": np.int32(number), "start": part[:, 0], "end": part[:, 1]})


_SAMPLES = "track string, contig string, isochore string, sample_id int, start long, end long"


def sample(segments: DataFrame, workspace: DataFrame, nsamples: int, sampler: str | Placer = "annotator", seed: int = 1, batch: int = BATCH, files: list[AxisFiles] | None = None, **options) -> DataFrame:
    """track, contig, isochore, sample_id, start, end: nsamples random sets per track, within the workspace.

    Segments that don't touch the workspace take no part; both sides are taken as normalized. files: gets what
    the samples are made of, to be deleted when they have been read.
    """
    placer = PLACERS[sampler](**options) if isinstance(sampler, str) else sampler
    s, w = written(segments), written(workspace, None)
    if files is not None:
        files += [s, w]
    rows = _dealt(_axes(s, w), nsamples, batch)
    segment_files, workspace_files = s.base, w.base

    def place(batches):
        for rows in batches:
            for track, contig, isochore, first in rows.itertuples(index=False):
                make, _ = _maker(placer, segment_files, workspace_files, track, contig, isochore)
                for k in range(int(first), min(int(first) + batch, nsamples)):
                    for x in make(_generator(seed, (track, contig, isochore), k), k):
                        yield from _samples(track, contig, isochore, k, x)

    return rows.mapInPandas(place, _SAMPLES)


def _maker(placer: Placer, segments: str, workspace: str, track: str, contig: str, isochore: str):
    """What makes a sample of an axis in parts of bounded size (of placers that work by shards; else in one), and the workspace's bases."""
    if hasattr(placer, "fill"):
        space = Space(AxisFiles(segments, None).axis(contig, isochore).rows(track), AxisFiles(workspace, None).axis(contig, isochore).rows(""))
        return lambda rng, k: placer.fill(rng, space), int(space.sizes.sum())
    ss, ww = _pair(segments, workspace, track, contig, isochore)
    return lambda rng, k: [placer(rng, ss, ww, k)] if len(ss) else [], Sorted.of(ww).bases()


def _pair(segments: str, workspace: str, track: str, contig: str, isochore: str) -> tuple[np.ndarray, np.ndarray]:
    """A track's segments that touch the workspace, and that."""
    ww = AxisFiles(workspace, None).axis(contig, isochore)[""].array()
    return touching(AxisFiles(segments, None).axis(contig, isochore)[track].array(), ww), ww


def sample_across(segments: DataFrame, workspace: DataFrame, nsamples: int, seed: int = 1, batch: int = BATCH, bucket: int = 1) -> DataFrame:
    """The same for segments and workspace in strata of each contig, which are filled together.

    The bases of a track on a contig are kept exactly, those of a stratum on average: segments are drawn by
    what the strata lack, and may reach over their borders.
    """
    s, w = written(segments), written(workspace, None)
    axes = _axes(s, w).groupBy("track", "contig").agg(F.array_sort(F.collect_set("isochore")).alias("isochores"))
    rows = _dealt(axes, nsamples, batch)
    segment_files, workspace_files = s.base, w.base

    def place(batches):
        for rows in batches:
            for track, contig, isochores, first in rows.itertuples(index=False):
                pairs = [_pair(segment_files, workspace_files, track, contig, i) for i in isochores]
                for k in range(int(first), min(int(first) + batch, nsamples)):
                    for i, x in zip(isochores, across(_generator(seed, (track, contig), k), pairs, bucket), strict=True):
                        yield from _samples(track, contig, i, k, x)

    return rows.mapInPandas(place, _SAMPLES)


def _value(counter: str, s: Sorted, islands: Sorted, a: Sorted, workspace_bases: int) -> float:
    if counter.startswith("nucleotide"):
        bases = float((a.below(s.ends) - a.below(s.starts)).sum())
        return bases if counter == "nucleotide-overlap" else bases / max(1, workspace_bases)
    of, by = (s, a) if counter.startswith("segment") else (a, islands)
    return float(by.middles_of(of) if "mid" in counter else by.touched_by(of))


def count(counter: str, s: np.ndarray, a: np.ndarray, w: np.ndarray) -> float:
    """A counter's value on one axis; s may overlap itself, a may not."""
    return _value(counter, Sorted.of(s), Sorted.of(merged(s)), Sorted.of(a), Sorted.of(w).bases())


def _sets(axis: Axis, by_shard: bool) -> dict[str, Rows | Sorted]:
    """An axis's annotations by name, mapped or read in stretches."""
    return {n: axis.rows(n) if by_shard else axis[n] for n in axis}


def _met(y: Rows, x: np.ndarray) -> tuple[Sorted, int]:
    """The annotations between the first and last of some intervals, and the number of the first."""
    first, last = int(y.before(x[:1, 0])[0]), int(y.begun(x[-1:, 1])[0])
    return Sorted.of(y.stretch(first, last)), first


def _again(ends: dict[str, tuple[int, bool]], name: str, islands: Sorted, y: Sorted, at: int) -> int:
    """1 if the first annotation of a shard overlapped intervals of one before and does so again: it counts once."""
    hit = lambda j: bool(islands.touched_by(Sorted.of(y.array()[j : j + 1])))
    number, was = ends.get(name, (-1, False))
    was = was and number == at
    twice = was and hit(0)
    ends[name] = at + len(y) - 1, hit(len(y) - 1) or was and len(y) == 1
    return int(twice)


def batch_for(axes: DataFrame, nsamples: int) -> int:
    """Samples of a task that counts: as many as leave every core PER_CORE tasks."""
    wanted = -(-PER_CORE * axes.sparkSession.sparkContext.defaultParallelism // max(1, axes.count()))
    return max(1, -(-nsamples // wanted))


def sampled_counts(segments: DataFrame, annotations: DataFrame, workspace: DataFrame, nsamples: int, counters: tuple[str, ...] = ("nucleotide-overlap",), sampler: str | Placer = "annotator", seed: int = 1, batch: int | None = None, files: list[AxisFiles] | None = None, **options) -> DataFrame:
    """counter, track, annotation, sample_id, value: counted in the tasks that sample, all pairs with zeros.

    Values don't depend on batch, by default batch_for(). files: as in sample().
    """
    placer = PLACERS[sampler](**options) if isinstance(sampler, str) else sampler
    s, a, w = written(segments), written(annotations), written(workspace, None)
    if files is not None:
        files += [s, a, w]
    axes = _axes(s, w)
    size = batch or batch_for(axes, nsamples)
    rows = _dealt(axes, nsamples, size)
    segment_files, annotation_files, workspace_files = s.base, a.base, w.base
    names = "counter track annotation sample_id value"

    def run(batches):
        for rows in batches:
            for track, contig, isochore, first in rows.itertuples(index=False):
                make, bases = _maker(placer, segment_files, workspace_files, track, contig, isochore)
                by_shard, read = hasattr(placer, "fill"), _sets(AxisFiles(annotation_files, None).axis(contig, isochore), hasattr(placer, "fill"))
                out = []
                for k in range(int(first), min(int(first) + size, nsamples)):
                    values, ends = {}, {}
                    for x in make(_generator(seed, (track, contig, isochore), k), k):
                        xs = Sorted.of(x)
                        islands = Sorted.of(merged(x)) if any(c.startswith("annotation") for c in counters) else xs
                        for n, ys in read.items() if len(x) or not by_shard else ():
                            y, at = _met(ys, x) if by_shard else (ys, 0)
                            for c in counters:
                                values[c, n] = values.get((c, n), 0.0) + _value(c, xs, islands, y, bases)
                                if by_shard and c == "annotation-overlap" and len(y):
                                    values[c, n] -= _again(ends, n, islands, y, at)
                    out += [(c, track, n, k, v) for (c, n), v in values.items()]
                yield pd.DataFrame(out, columns=names.split())

    parts = rows.mapInPandas(run, "counter string, track string, annotation string, sample_id int, value double")
    sums = parts.groupBy("counter", "track", "annotation", "sample_id").agg(F.sum("value").alias("value"))
    from .counters import pairs_of

    full = pairs_of(segments, annotations).withColumn("counter", F.explode(F.array(*map(F.lit, counters)))).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(nsamples - 1))))
    keys = ["counter", "track", "annotation", "sample_id"]
    return full.join(sums, keys, "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"))


# --- sampling by portable hashes: the same numbers in any engine, for checks -------------------------


def lehmer(*terms) -> Column:
    """One step of a Lehmer generator on whole numbers: weak, but equal in every engine."""
    x = F.pmod(sum((t * m for t, m in zip(terms, (7919, 104729, 1299709), strict=False)), F.lit(17)), F.lit(2147483647))
    return F.pmod(x * 48271, F.lit(2147483647))


def _shift(start: str, end: str, reach: int) -> Column:
    by = F.pmod(lehmer(F.col(start), F.col("sample_id").cast("long"), F.col(end)), F.lit(2 * reach + 1)) - reach
    return F.greatest(by, -F.col(start))


def _numbers(nsamples: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(nsamples - 1)))


def shift_by_hash(segments: DataFrame, nsamples: int, reach: int = 100) -> DataFrame:
    """Every segment moved by a hashed offset below `reach` in either direction, not below 0."""
    rows = segments.withColumn("sample_id", _numbers(nsamples)).withColumn("_by", _shift("start", "end", reach))
    return rows.withColumns({"start": F.col("start") + F.col("_by"), "end": F.col("end") + F.col("_by")}).drop("_by")


def shift_by_hash_overlap(segments: DataFrame, annotations: DataFrame, nsamples: int, reach: int = 100) -> DataFrame:
    """track, annotation, sample_id, value: the bases that samples of shift_by_hash share with annotations.

    Segments meet all that their shifts can reach in one join, and are moved there: samples are never shuffled.
    """
    wide = segments.withColumns({"_s": F.col("start"), "_e": F.col("end"), "start": F.greatest(F.col("start") - reach, F.lit(0).cast("long")), "end": F.col("end") + reach})
    pairs = algebra.overlap_join(wide, annotations, nested=algebra.is_kept(segments) and algebra.is_kept(annotations))
    moved = pairs.select("track", F.col("track_b").alias("annotation"), "_s", "_e", "start_b", "end_b", _numbers(nsamples).alias("sample_id")).withColumn("_by", _shift("_s", "_e", reach))
    bases = F.least(F.col("_e") + F.col("_by"), "end_b") - F.greatest(F.col("_s") + F.col("_by"), "start_b")
    return moved.withColumn("_bases", bases).filter("_bases > 0").groupBy("track", "annotation", "sample_id").agg(F.sum("_bases").cast("double").alias("value"))


def segments_by_hash(segments: DataFrame, nsamples: int, span: int) -> DataFrame:
    """Every segment at a hashed start in [0, span)."""
    rows = segments.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(nsamples - 1))))
    at = F.pmod(lehmer(F.col("start"), F.col("sample_id").cast("long"), F.col("end")), F.lit(span))
    return rows.withColumn("_at", at).withColumns({"end": F.col("_at") + F.col("end") - F.col("start"), "start": F.col("_at")}).drop("_at")


def clip_samples(samples: DataFrame, workspace: DataFrame) -> DataFrame:
    return algebra.intersect(samples, workspace)

