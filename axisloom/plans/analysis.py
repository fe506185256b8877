"""Whole analyses: inputs, scope, observed and sampled counts, statistics, corrections.

Inputs that several steps read, and the counts, are computed once and kept as tables; the rest is
planned as one query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special, statistics
from ..operators import algebra, collections, counters, samplers, workspaces
from ..storage import delete, kept
from .metrics import Metrics

MOST_TRACKS = 1000


@dataclass
class Options:
    counters: tuple[str, ...] = ("nucleotide-overlap",)
    nsamples: int = 1000
    sampler: str = "annotator"
    sampler_options: dict = field(default_factory=dict)
    seed: int = 1
    pseudo_count: float = 1.0
    pvalue_method: str = "empirical"
    qvalue_method: str = "storey"
    fused: bool = True
    overlapping_annotations: bool = False
    truncate_segments_to_workspace: bool = False
    workspace_generator: str = "unconditional"
    workspace_options: dict = field(default_factory=dict)


def build_inputs(segments: DataFrame, annotations: DataFrame, workspaces_: DataFrame, overlapping_annotations: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalized segments and annotations, and what all workspaces share."""
    names = segments.select("track").distinct().limit(MOST_TRACKS + 1).count()
    if not names:
        raise ValueError("there are no segments")
    if names > MOST_TRACKS:
        raise ValueError(f"more than {MOST_TRACKS} tracks of segments")
    space = collections.collapse(kept(algebra.normalize(workspaces_), tidy=True))  # its steps read them several times
    return algebra.normalize(segments), annotations if overlapping_annotations else algebra.normalize(annotations), space


def apply_scope(segments: DataFrame, annotations: DataFrame, workspace: DataFrame, isochores: DataFrame | None = None, truncate: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments (whole, or cut with truncate), annotations (cut) and workspace (cut) in their strata."""
    if isochores is not None:
        strata = algebra.intersect(algebra.normalize(isochores), workspace)
        return collections.to_isochores(segments, strata, truncate), collections.to_isochores(annotations, strata, True), collections.to_isochores(workspace, strata, True)
    inside = algebra.intersect(segments, workspace) if truncate else algebra.overlapping(segments, workspace)
    return inside, algebra.intersect(annotations, workspace), workspace


def apply_spaces(segments: DataFrame, annotations: DataFrame, spaces: DataFrame, by: tuple[str, ...], isochores: DataFrame | None = None, truncate: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same in workspaces that depend on names (by), each on axes of its own."""
    s = workspaces.within(segments, spaces, by, "track", truncate and isochores is None)
    a, w = workspaces.within(annotations, spaces, by, "annotation"), workspaces.labelled(spaces, by)
    if isochores is None:
        return s, a, w
    strata = workspaces.within(algebra.normalize(isochores), spaces, by)
    return collections.to_isochores(s, strata, truncate), collections.to_isochores(a, strata, True), collections.to_isochores(w.withColumn("track", F.lit("")), strata, True).drop("track")


def extended(results: DataFrame, segments: DataFrame, annotations: DataFrame, workspace: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Results with counts, sizes, densities and overlap percentages of track and annotation.

    by: of what the workspace depends on; its parts then have sizes of their own.
    """
    length = F.col("end") - F.col("start")

    def totals(df: DataFrame, own: str) -> tuple[DataFrame, list[str]]:
        rest = tuple(c for c in by if c != own)
        on = [own, *rest]
        df = df.withColumnRenamed("track", own)
        named = workspaces.scope_of(df, by) if rest else df
        return named.groupBy(*on).agg(F.count("*").alias(own + "_nsegments"), F.sum(length).alias(own + "_size")), on

    pairs = algebra.overlap_join(segments, annotations)
    common = pairs.groupBy("track", F.col("track_b").alias("annotation")).agg(F.count("*").alias("overlap_nsegments"), F.sum(F.least("end", "end_b") - F.greatest("start", "start_b")).alias("overlap_size"))
    (of_tracks, on_t), (of_annotations, on_a) = totals(segments, "track"), totals(annotations, "annotation")
    out = results.join(of_tracks, on_t, "left").join(of_annotations, on_a, "left").join(common, ["track", "annotation"], "left")
    size = workspace.agg(F.sum(length)).scalar()
    if by:
        out = out.join(workspaces.scope_of(workspace, by).groupBy(*by).agg(F.sum(length).alias("_space")), [*by], "left")
        size = F.col("_space")
    out = out.fillna(0, ["track_nsegments", "track_size", "annotation_nsegments", "annotation_size", "overlap_nsegments", "overlap_size"])
    share = lambda a, b: F.when(b > 0, F.col(a) * 100.0 / b)
    for name in ("track", "annotation", "overlap"):
        out = out.withColumn(name + "_density", share(name + "_size", size))
    for of in ("track", "annotation"):
        out = out.withColumn(f"percent_overlap_nsegments_{of}", share("overlap_nsegments", F.col(of + "_nsegments"))).withColumn(f"percent_overlap_size_{of}", share("overlap_size", F.col(of + "_size")))
    return out.drop("_space")


def run(segments: DataFrame, annotations: DataFrame, workspaces_: DataFrame, isochores: DataFrame | None = None, options: Options | None = None, reference: DataFrame | None = None, metrics: Metrics | None = None) -> DataFrame:
    """One row per counter, track and annotation, with all result columns.

    Where the workspace depends on the track or annotation, each has its own copy of what it is judged
    with, and of no more, on axes of its own: intervals, samples and counts of one workspace never meet another's.
    metrics takes down what inputs, scope and results hold, and the seconds until they are kept.
    """
    o, m = options or Options(), metrics or Metrics()

    def watched(tables: tuple[DataFrame, ...], what: str) -> list[DataFrame]:
        with m.timed(what):
            return [kept(m.watch(x, f"{name} {what}"), tidy=True) for x, name in zip(tables, ("segments", "annotations", "workspace"), strict=True)]

    given = s, a, w = watched(build_inputs(segments, annotations, workspaces_, o.overlapping_annotations), "given")
    by = workspaces.CONDITIONS.get(o.workspace_generator, ())
    if by:
        # zeros are completed for these names, also where a scope leaves nothing of them
        names = kept(counters.pairs_of(s, a), tidy=True)
        spaces = kept(workspaces.SPACES[o.workspace_generator](**o.workspace_options)(s, a, w), tidy=True)
        s, a, w = watched(apply_spaces(s, a, spaces, by, isochores, o.truncate_segments_to_workspace), "in scope")
        delete(spaces)
    else:
        s, a, w = workspaces.WORKSPACES[o.workspace_generator](**o.workspace_options)(s, a, w)
        s, a, w = watched(apply_scope(s, a, w, isochores, o.truncate_segments_to_workspace), "in scope")
    # tables and files go as soon as nothing reads them, as each is a good part of what all take on disk
    for x in given:
        delete(x)
    observed, sampled, files = None, None, []
    for c in o.counters:
        seen = counters.observed(c, s, a, w)
        observed = seen if observed is None else observed.unionByName(seen)
    observed = kept(observed, tidy=True)
    if o.fused:
        sampled = samplers.sampled_counts(s, a, w, o.nsamples, o.counters, o.sampler, o.seed, files=files, **o.sampler_options)
    else:
        sets = kept(samplers.sample(s, w, o.nsamples, o.sampler, o.seed, files=files, **o.sampler_options))
        for c in o.counters:
            values = counters.sampled(c, sets, a, w, o.nsamples, counters.pairs_of(s, a))
            sampled = values if sampled is None else sampled.unionByName(values)
    if by:
        observed, sampled = _with_zeros(observed, names, o), _with_zeros(sampled, names, o, True)
    with m.timed("results"):
        out = finish(observed, m.watch(sampled, "sampled counts"), o, reference, (s, a, w, by))
    for x in files:
        x.delete()
    if not o.fused:
        delete(sets)
    return out


def _with_zeros(counts: DataFrame, pairs: DataFrame, o: Options, sampled: bool = False) -> DataFrame:
    """Counts with rows of 0 for the pairs of names that no scope has left."""
    on = ["counter", "track", "annotation", *(["sample_id"] if sampled else [])]
    value = "value" if sampled else "observed"
    full = pairs.withColumn("counter", F.explode(F.array(*map(F.lit, o.counters))))
    if sampled:
        full = full.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(o.nsamples - 1))))
    return full.join(counts, on, "left").select(*on, F.coalesce(value, F.lit(0.0)).alias(value))


def finish(observed: DataFrame, sampled: DataFrame, o: Options, reference: DataFrame | None = None, inputs=None) -> DataFrame:
    """Statistics, p-values and q-values of counts, however they came about."""
    results = statistics.enrichment(observed, sampled, o.pseudo_count, reference)
    results = statistics.q_values(kept(statistics.update_p(results, o.pvalue_method), tidy=True), o.qvalue_method)
    return extended(results, *inputs) if inputs else results


# --- closed forms ----------------------------------------------------------------------------------


def great_counts(segments: DataFrame, annotations: DataFrame, workspace: DataFrame, midpoint: bool = True) -> DataFrame:
    """Per track and annotation, summed over contigs: pieces of segments in the workspace, hits, and bases."""
    length = F.col("end") - F.col("start")
    on = [c for c in ("contig", "isochore") if c in workspace.columns and c in segments.columns]
    # several branches read each
    segments, annotations, workspace = kept(segments), kept(annotations), kept(workspace)
    space = workspace.groupBy(*on).agg(F.sum(length).alias("w"))
    inside = algebra.intersect(segments, workspace)
    s = inside.groupBy("track", *on).agg(F.count("*").alias("n"), F.sum(length).alias("s"))
    a = annotations.groupBy(F.col("track").alias("annotation"), *on).agg(F.count("*").alias("na"), F.sum(length).alias("a"))
    pairs = algebra.overlap_join(segments, annotations)
    mid = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("long")
    hit = (mid >= F.col("start_b")) & (mid < F.col("end_b")) if midpoint else F.lit(True)
    # one join: first by segment, which counts once for an annotation however often they meet
    each = pairs.groupBy("track", "track_b", *on, "start", "end").agg(F.max(hit.cast("int")).alias("k"), F.sum(F.least("end", "end_b") - F.greatest("start", "start_b")).alias("x"), F.count("*").alias("na_hit"))
    met = each.groupBy("track", F.col("track_b").alias("annotation"), *on).agg(*(F.sum(c).alias(c) for c in ("k", "x", "na_hit")))
    # zeros are completed after summing over contigs, so no row stands for a pair on a contig without either
    a = a.join(space.select(*on), on, "left_semi")
    both = met.join(s.filter("n > 0").select("track", *on), ["track", *on], "left_semi").join(a.filter("na > 0").select("annotation", *on), ["annotation", *on], "left_semi")
    per = both.groupBy("track", "annotation").agg(*(F.sum(c).alias(c) for c in ("k", "x", "na_hit")))
    of_tracks = s.groupBy("track").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    of_annotations = a.groupBy("annotation").agg(F.sum("a").alias("a"), F.sum("na").alias("na"))
    full = counters.pairs_of(segments, annotations).join(of_tracks, "track", "left").join(of_annotations, "annotation", "left").join(per, ["track", "annotation"], "left")
    w = F.coalesce(space.agg(F.sum("w")).scalar(), F.lit(0))
    return full.fillna(0, ["n", "s", "na", "a", "k", "x", "na_hit"]).select("track", "annotation", "n", "s", "a", w.alias("w"), "na", "k", "x", "na_hit")


def great(segments: DataFrame, annotations: DataFrame, workspace: DataFrame, counter: str = "binom") -> DataFrame:
    """Binomial test over segments, or hypergeometric test over bases."""
    c = great_counts(segments, annotations, workspace)
    share = F.when(F.col("w") > 0, F.col("a") / F.col("w")).otherwise(F.lit(0.0))
    if counter == "binom":
        observed, expected, p = F.col("k"), share * F.col("n"), special.binomial_tail("k", "n", "_share")
    elif counter == "hyperg":
        observed, expected, p = F.col("x"), share * F.col("s"), special.hypergeometric_tail(F.col("x") + 1, F.col("w"), F.col("a"), F.col("s"))
    else:
        raise ValueError("counter must be binom or hyperg")
    out = c.withColumn("_share", share)
    f = F.when(expected != 0, observed / expected).otherwise(F.lit(1.0))
    return out.select(F.lit(counter).alias("counter"), "track", "annotation", observed.cast("double").alias("observed"), expected.alias("expected"), F.col("n").alias("nsegments_in_workspace"), F.col("na").alias("nannotations_in_workspace"), F.col("k").alias("nsegments_overlapping_annotation"), F.col("na_hit").alias("nannotations_overlapping_segments"), F.col("x").alias("basecoverage_intersection"), F.col("s").alias("basecoverage_segments"), F.col("a").alias("basecoverage_annotation"), F.col("w").alias("basecoverage_workspace"), F.col("_share").alias("fraction_coverage_annotation"), f.alias("fold"), p.alias("pvalue"))


def geneset(segments: DataFrame, genes: DataFrame, terms: DataFrame) -> DataFrame:
    """Hypergeometric test of gene terms among (segment, gene) overlaps. genes: track is gene_id; terms: gene_id, term."""
    known = genes.select("track").distinct().withColumnRenamed("track", "gene_id")
    total = known.agg(F.count("*")).scalar()
    own = terms.distinct().join(known, "gene_id", "left_semi")
    annotated = own.groupBy("term").agg(F.count_distinct("gene_id").alias("annotated"))
    hits = algebra.overlap_join(segments, genes).groupBy("track", F.col("track_b").alias("gene_id")).agg(F.count("*").alias("hits"))
    drawn = hits.groupBy("track").agg(F.sum("hits").alias("drawn"))
    per = hits.join(own, "gene_id").groupBy("track", "term").agg(F.sum("hits").alias("observed"))
    names = annotated.agg(F.array_sort(F.collect_set("term"))).scalar()
    full = segments.select("track").distinct().withColumn("term", F.explode(names))
    out = full.join(annotated, "term").join(drawn, "track", "left").join(per, ["track", "term"], "left").fillna(0, ["drawn", "observed"]).withColumn("total", total)
    expected = F.col("drawn") * F.col("annotated") / F.col("total")
    f = F.when((F.col("observed") > 0) & (expected > 0), F.col("observed") / expected).otherwise(F.lit(1.0))
    # pairs can be drawn more often than there are genes; the test then takes every gene as drawn
    tail = special.hypergeometric_tail("observed", "total", "annotated", F.least("drawn", "total"))
    p = F.when(F.col("observed") > 0, tail).otherwise(F.lit(1.0))
    return out.select("track", F.col("term").alias("annotation"), "total", "annotated", "drawn", "observed", expected.alias("expected"), f.alias("fold"), p.alias("pvalue"))


# --- comparisons ---------------------------------------------------------------------------------------


def _keyed(observed: DataFrame, sampled: DataFrame, pseudo_count: float, run_: str = "") -> tuple[DataFrame, DataFrame]:
    key = F.concat_ws("\t", F.lit(run_), "track", "annotation").alias("key")
    observed, sampled = kept(observed), kept(sampled)
    stats = kept(statistics.enrichment(observed, sampled, pseudo_count))
    return stats.select(key, "track", "annotation", "observed", "fold"), sampled.select(key, "sample_id", "value")


def compare_within(observed: DataFrame, sampled: DataFrame, pseudo_count: float = 1.0) -> DataFrame:
    """Fold differences of all pairs of annotations of one track of segments."""
    if observed.select("track").distinct().limit(2).count() > 1:
        raise NotImplementedError("several tracks of segments")
    o, s = _keyed(observed, sampled, pseudo_count)
    a, b = (o.select(F.col("annotation").alias(n), F.col("key").alias(n[0] + "_key")) for n in ("a_name", "b_name"))
    pairs = a.join(b, F.col("a_name") < F.col("b_name")).select(F.lit("na").alias("counter"), F.col("a_name").alias("track"), F.col("b_name").alias("annotation"), "a_key", "b_key")
    seen, values = statistics.fold_difference(s, o, pairs, pseudo_count)
    return statistics.enrichment(seen, values, 0.0)


def compare_between(runs: list[tuple[DataFrame, DataFrame]], pseudo_count: float = 1.0) -> DataFrame:
    """Fold differences of the pairs that each two runs share."""
    out = None
    for i in range(len(runs)):
        for j in range(i + 1, len(runs)):
            (o1, s1), (o2, s2) = _keyed(*runs[i], pseudo_count, str(i)), _keyed(*runs[j], pseudo_count, str(j))
            a = o1.select("track", "annotation", F.col("key").alias("a_key"))
            b = o2.select("track", "annotation", F.col("key").alias("b_key"))
            pairs = a.join(b, ["track", "annotation"]).select(F.lit(f"{i}-{j}").alias("counter"), "track", "annotation", "a_key", "b_key")
            seen, values = statistics.fold_difference(s1.unionByName(s2), o1.unionByName(o2), pairs, pseudo_count)
            one = statistics.enrichment(seen, values, 0.0)
            out = one if out is None else out.unionByName(one)
    return out
