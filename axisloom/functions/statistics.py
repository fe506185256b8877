"""Enrichment statistics, p-values and their correction for multiple tests.

Everything per pair is one grouped aggregation of the sampled values; only corrections look at all
pairs at once, of which there are at most tracks times annotations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import special

PAIR = ["counter", "track", "annotation"]


def fold(observed: Column, expected: Column, pseudo_count: float) -> Column:
    """(observed + pseudo count) / (expected + pseudo count), or 1 where nothing is expected."""
    return F.when(expected != 0, (observed + pseudo_count) / (expected + pseudo_count)).otherwise(F.lit(1.0))


def empirical_p(lt: Column, le: Column, n: Column, observed: Column, expected: Column) -> Column:
    """Of n samples, lt are below and le at most the observed value; the tail of the side it lies on."""
    ties = le > lt
    over = F.when(ties & (lt > 0), n - lt).when(ties, n - 1).otherwise(n - lt - 1)
    k = F.when(lt == n, F.lit(1)).when(observed > expected, over).otherwise(le)
    return F.greatest(F.lit(1.0) / n, k / n)


def enrichment(observed: DataFrame, sampled: DataFrame, pseudo_count: float = 1.0, reference: DataFrame | None = None) -> DataFrame:
    """One row per pair: observed, expected, stddev, ci95low, ci95high, fold, l2fold, pvalue, nsamples.

    With a reference (counter, track, annotation, fold), expected values and the confidence range are
    multiplied by its fold, and the p-value is that of the observed value divided by it.
    """
    obs = observed.select(*PAIR, F.col("observed").cast("double").alias("observed"))
    if reference is None:
        obs = obs.withColumn("ref", F.lit(1.0))
    else:
        obs = obs.join(reference.select(*PAIR, F.col("fold").alias("ref")), PAIR)
        obs = obs.withColumn("ref", F.when(F.col("ref") <= 0, F.raise_error(F.lit("a reference fold is not positive")).cast("double")).otherwise(F.col("ref")))
    value = F.col("value").cast("double")
    scaled = F.col("observed") / F.col("ref")
    stats = sampled.join(obs, PAIR).groupBy(*PAIR, "observed", "ref").agg(
        F.count("*").alias("nsamples"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("stddev"),
        F.count_if(value < scaled).alias("lt"),
        F.count_if(value <= scaled).alias("le"),
        F.array_sort(F.collect_list(value)).alias("all"),
    )
    n, off = F.col("nsamples"), F.floor(F.col("nsamples") * 0.05).cast("int")
    last = F.element_at("all", -1)
    low = F.when(off > 0, F.element_at("all", F.least(off + 1, n.cast("int")))).otherwise(F.element_at("all", 1))
    high = F.when(off > 0, F.element_at("all", F.greatest(n.cast("int") - off + 1, F.lit(1)))).otherwise(last)
    expected = F.col("mean") * F.col("ref")
    folds = fold(F.col("observed"), expected, pseudo_count)
    # the side is judged by what the p-value is taken of
    p = empirical_p(F.col("lt"), F.col("le"), n, scaled, expected)
    return stats.select(*PAIR, "observed", expected.alias("expected"), (low * F.col("ref")).alias("ci95low"), (high * F.col("ref")).alias("ci95high"), "stddev", folds.alias("fold"), F.when(folds > 0, F.log2(folds)).otherwise(F.lit(float("-inf"))).alias("l2fold"), p.alias("pvalue"), "nsamples")


def normal_p(results: DataFrame) -> DataFrame:
    """pvalue from the normal distribution, one-tailed; 1 where the samples don't differ."""
    z = F.abs(F.col("observed") - F.col("expected")) / F.col("stddev")
    return results.withColumn("pvalue", F.when(F.col("stddev") > 0, special.normal_sf(F.when(F.col("stddev") > 0, z).otherwise(F.lit(0.0)))).otherwise(F.lit(1.0)))


def two_sided_p(observed: DataFrame, sampled: DataFrame) -> DataFrame:
    """counter, track, annotation, observed, below, upto, nsamples, pvalue: a tail chosen by rank instead of by the mean.

    Of n samples, `below` are smaller than the observed value and `upto` no larger. Where more than half are
    smaller it is the share from the last smaller one on (if any equals the value) or of the larger ones
    (if none does), else that of those no larger; 1/n at least, as it is where all are smaller.
    """
    v, o = F.col("value"), F.col("observed")
    per = observed.join(sampled, PAIR).groupBy(*PAIR, "observed").agg(F.count_if(v < o).alias("below"), F.count_if(v <= o).alias("upto"), F.count("*").alias("nsamples"))
    n, below, upto = F.col("nsamples"), F.col("below"), F.col("upto")
    last = F.when(upto > below, below - 1).otherwise(below)
    tail = F.when(below == n, 1 / n).when(below > n / 2, 1 - last / n).otherwise(upto / n)
    return per.withColumn("pvalue", F.greatest(1 / n, tail))


def update_p(results: DataFrame, method: str = "empirical") -> DataFrame:
    if method in ("norm", "normal"):
        return normal_p(results)
    if method == "empirical":
        return results
    raise ValueError(f"unknown p-value method {method}")


METHODS = ("bonferroni", "holm", "hochberg", "BH", "fdr", "BY", "none")


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; beyond 100 terms by Euler and Maclaurin, whose next term is below 1e-14 there."""
    terms = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(100)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    x = 1 / n.cast("double")
    return F.when(n > 100, F.log(n.cast("double")) + float(np.euler_gamma) + x / 2 - x * x / 12 + x * x * x * x / 120).otherwise(terms)


def adjust_p(df: DataFrame, method: str = "fdr", pvalue: str = "pvalue", qvalue: str = "qvalue") -> DataFrame:
    """df with p-values adjusted over all rows."""
    method = "BH" if method == "fdr" else method
    p = F.col(pvalue)
    if method == "none":
        return df.withColumn(qvalue, F.least(p, F.lit(1.0)))
    everything = W.partitionBy()
    n = F.count("*").over(everything)
    if method == "bonferroni":
        return df.withColumn(qvalue, F.least(p * n, F.lit(1.0)))
    if method == "hommel":
        # defined for up to two tests, where it equals hochberg's
        size = df.limit(3).count()
        if size > 2:
            raise NotImplementedError("hommel's method for more than two tests")
        method = "hochberg"
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    up, down = W.orderBy(p.asc()), W.orderBy(p.desc())
    so_far = (W.unboundedPreceding, W.currentRow)
    ranked = df.withColumn("_up", F.row_number().over(up)).withColumn("_n", n)
    if method == "holm":
        q = F.max((F.col("_n") - F.col("_up") + 1) * p).over(W.orderBy("_up").rowsBetween(*so_far))
    else:
        harmonic = _harmonic(F.col("_n")) if method == "BY" else F.lit(1.0)
        scale = F.col("_n") - F.col("_up") + 1 if method == "hochberg" else harmonic * F.col("_n") / F.col("_up")
        q = F.min(scale * p).over(W.orderBy(F.col("_up").desc()).rowsBetween(*so_far))
    return ranked.withColumn(qvalue, F.least(q, F.lit(1.0))).drop("_up", "_n")


def pi0(df: DataFrame, pvalue: str = "pvalue", grid: list[float] | None = None, method: str = "smoother", log: bool = False, seed: int = 1) -> Column:
    """Share of true null hypotheses, as a scalar of one aggregation over all p-values."""
    grid = [i * 0.05 for i in range(19)] if grid is None else list(grid)
    if len(grid) in (2, 3):
        raise ValueError("a grid needs one value, or four at least")
    if min(grid) < 0 or max(grid) >= 1:
        raise ValueError("grid values must lie within [0, 1)")
    p = F.col(pvalue)
    shares = [F.count_if(p >= x) / F.count("*") / (1 - x) for x in grid]
    if len(grid) == 1:
        return df.agg(F.least(shares[0], F.lit(1.0)).alias("pi0")).scalar()
    if method == "smoother":
        weights = special.storey_weights(np.array(grid)).tolist()
        value = sum((F.log(s) if log else s) * w for s, w in zip(shares, weights, strict=True))
        return df.agg(F.least(F.exp(value) if log else value, F.lit(1.0)).alias("pi0")).scalar()
    if method != "bootstrap":
        raise ValueError("method must be smoother or bootstrap")
    # 100 resamples: how often each row is drawn comes from Poisson weights of a hash, so it can be repeated
    draws = df.select(p.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("b"))
    u = (F.pmod(F.xxhash64("p", "b", F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cumulative = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1)) if k else 1) for k in range(8)]).tolist()
    draws = draws.withColumn("w", sum(F.when(u > c, 1).otherwise(0) for c in cumulative))
    boots = draws.groupBy("b").agg(F.array(*[F.sum(F.when(F.col("p") > x, F.col("w")).otherwise(0)) / F.sum("w") / (1 - x) for x in grid]).alias("v"))
    # per grid value: its squared distance from the smallest share, over all resamples
    boots = boots.withColumn("whole", df.agg(F.array(*shares).alias("v")).scalar())
    apart = boots.select(F.posexplode("v").alias("i", "v"), "whole").withColumn("share", F.get("whole", F.col("i"))).withColumn("least", F.array_min("whole"))
    errors = apart.groupBy("i", "share").agg(F.sum((F.col("v") - F.col("least")) * (F.col("v") - F.col("least"))).alias("mse"))
    return errors.agg(F.least(F.min_by("share", F.struct("mse", "share")), F.lit(1.0)).alias("pi0")).scalar()


def storey_q(df: DataFrame, pvalue: str = "pvalue", qvalue: str = "qvalue", pi0_value: float | Column | None = None, robust: bool = False, fdr_level: float | None = None, **options) -> DataFrame:
    """df with Storey q-values over all rows; with fdr_level also `passed`."""
    if fdr_level is not None and not 0 < fdr_level <= 1:
        raise ValueError("fdr_level must lie within (0, 1]")
    share = pi0(df, pvalue, **options) if pi0_value is None else pi0_value
    share = share if isinstance(share, Column) else F.lit(float(share))
    p = F.col(pvalue)
    n = F.count("*").over(W.partitionBy())
    upto = F.count("*").over(W.orderBy(p).rangeBetween(W.unboundedPreceding, W.currentRow))
    raw = p * share * n / upto
    if robust:
        raw = raw / (1 - F.pow(1 - p, n))
    out = df.withColumn("_raw", raw)
    q = F.min("_raw").over(W.orderBy(p.desc()).rangeBetween(W.unboundedPreceding, W.currentRow))
    out = out.withColumn(qvalue, F.least(q, F.lit(1.0))).drop("_raw")
    return out if fdr_level is None else out.withColumn("passed", F.col(qvalue) <= fdr_level)


def q_values(results: DataFrame, method: str = "storey", **options) -> DataFrame:
    """Results with q-values by Storey's method or as adjusted p-values; 1 where Storey's share can't be estimated."""
    if method == "storey":
        out = storey_q(results, **options)
        return out.withColumn("qvalue", F.when(F.col("qvalue") > 0, F.col("qvalue")).when(F.col("pvalue") == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    return adjust_p(results, method)


def empirical_fdr(observed: DataFrame, sampled: DataFrame) -> DataFrame:
    """Per result: the expected number of samples' values as extreme as its p-value, over the results that are."""
    results = enrichment(observed, sampled)
    n = F.count("*").over(W.partitionBy(*PAIR))
    rank = W.partitionBy(*PAIR).orderBy("value")
    lt = F.rank().over(rank) - 1
    le = F.count("*").over(rank.rangeBetween(W.unboundedPreceding, W.currentRow))
    mean = F.avg("value").over(W.partitionBy(*PAIR))
    each = sampled.select(*PAIR, "sample_id", empirical_p(lt, le, n, F.col("value"), mean).alias("p"))
    # how many of the samples' p-values are at most each result's: one sorted run over both
    both = each.select("p", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(results.select(F.col("pvalue").alias("p"), F.lit(0).alias("s"), F.lit(1).alias("r")))
    per = both.groupBy("p").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    upto = W.orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = per.select("p", F.sum("s").over(upto).alias("false_positives"), F.sum("r").over(upto).alias("positives"))
    samples = each.agg(F.count_distinct("sample_id")).scalar()
    out = results.join(per, results["pvalue"] == per["p"])
    rate = F.col("false_positives") / samples / F.col("positives")
    return out.select(*PAIR, "pvalue", F.least(rate, F.lit(1.0)).alias("fdr"))


def predecessor_stats(observed: DataFrame, sampled: DataFrame) -> DataFrame:
    """Mean, sample variance, z, 2.5 % range, representation relative to the mean, and p with one added to both counts."""
    v = F.col("value").cast("double")
    stats = sampled.join(observed, PAIR).groupBy(*PAIR, "observed").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.count_if(v >= F.col("observed")).alias("ge"), F.count_if(v <= F.col("observed")).alias("le"), F.array_sort(F.collect_list(v)).alias("all"))
    n = F.col("n")
    at = lambda share: F.element_at("all", F.greatest(F.lit(1), F.least(n.cast("int"), (F.floor(n * share) + 1).cast("int"))))
    z = F.when(F.col("variance") > 0, (F.col("observed") - F.col("mean")) / F.sqrt("variance")).otherwise(F.lit(0.0))
    relative = F.when(F.col("mean") > 0, (F.col("observed") - F.col("mean")) / F.col("mean")).otherwise(F.lit(0.0))
    return stats.select(*PAIR, "observed", "mean", "variance", z.alias("z"), at(0.025).alias("low"), at(0.975).alias("high"), relative.alias("relative"), (F.least(F.col("ge"), F.col("le")) + 1).alias("extreme"), ((F.least(F.col("ge"), F.col("le")) + 1) / (n + 1)).alias("pvalue"))


def false_discovery_summary(observed: DataFrame, sampled: DataFrame, cutoffs: tuple[float, ...], z_least: float = 0.0) -> DataFrame:
    """How many pairs are significant at each cut-off, and how many are so by chance.

    A sample is significant for a pair at a cut-off if it is among its floor(cutoff * samples) highest
    (over) or lowest (under) values, of ties the earlier sample; where it is both, the better rank
    decides. cutoff, level, category (significant, over, under), observed, and over the samples the
    average, median and upper (95 %) number of pairs; nulls where level is 0. An observed pair counts
    by predecessor_stats' p-value, if its z lies beyond z_least.
    """
    n = sampled.agg(F.count_distinct("sample_id")).scalar()
    cut = F.explode(F.array(*(F.lit(float(c)) for c in cutoffs)))
    ranks = {name: F.row_number().over(W.partitionBy(*PAIR).orderBy(order, "sample_id")) for name, order in (("hi", F.desc("value")), ("lo", F.asc("value")))}
    each = sampled.select("sample_id", *(r.alias(name) for name, r in ranks.items())).withColumn("cutoff", cut).withColumn("level", F.floor(F.col("cutoff") * n + 1e-9))
    over = (F.col("hi") <= F.col("level")) & (F.col("hi") <= F.col("lo"))
    under = (F.col("lo") <= F.col("level")) & ~over
    per = each.groupBy("cutoff", "level", "sample_id").agg(F.count_if(over | under).alias("significant"), F.count_if(over).alias("over"), F.count_if(under).alias("under"))
    kinds = ("significant", "over", "under")
    long = per.select("cutoff", "level", F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.col(k).alias("v")) for k in kinds))).alias("x")).select("cutoff", "level", "x.*")
    drawn = long.groupBy("cutoff", "level", "category").agg(F.avg("v").alias("average"), F.array_sort(F.collect_list("v")).alias("all"))
    at = lambda num, of: F.get("all", F.floor(F.size("all") * num / of).cast("int")).cast("long")
    any_ = F.col("level") > 0
    drawn = drawn.select("cutoff", "level", "category", F.when(any_, F.col("average")).alias("average"), F.when(any_, at(1, 2)).alias("median"), F.when(any_, at(19, 20)).alias("upper"))
    more = F.count_if(F.col("value") >= F.col("observed")) < F.count_if(F.col("value") <= F.col("observed"))
    sides = sampled.join(observed, PAIR).groupBy(*PAIR).agg(more.alias("more"))
    found = predecessor_stats(observed, sampled).filter(F.abs("z") > z_least).join(sides, PAIR).select("pvalue", "more").withColumn("cutoff", cut).filter(F.col("pvalue") <= F.col("cutoff"))
    seen = found.select("cutoff", F.explode(F.array(F.lit("significant"), F.when(F.col("more"), "over").otherwise("under"))).alias("category")).groupBy("cutoff", "category").agg(F.count("*").alias("observed"))
    return drawn.join(seen, ["cutoff", "category"], "left").select("cutoff", F.col("level").cast("long").alias("level"), "category", F.coalesce("observed", F.lit(0).cast("long")).alias("observed"), "average", "median", "upper")


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bin (from 0), lower, n: values in `bins` equal ranges of [low, high], the last closed; others and nulls are left out."""
    width = (high - low) / bins
    kept = values.filter(F.col(column).between(low, high))
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return kept.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n")).select(*by, "bin", (F.lit(low) + F.col("bin") * width).alias("lower"), "n")


def rank_index(sampled: DataFrame) -> DataFrame:
    """Per pair and distinct value of its samples: below (samples under it) and upto (under or equal)."""
    per = sampled.groupBy(*PAIR, "value").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy(*PAIR).orderBy("value"))
    return per.select(*PAIR, "value", (upto - F.col("k")).alias("below"), upto.alias("upto"))


def fold_difference(sampled: DataFrame, observed: DataFrame, pairs: DataFrame, pseudo_count: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(observed, sampled) differences of fold between two annotations or runs.

    pairs: counter, track, annotation, a_key, b_key, where sampled and observed have key. The sampled
    difference is ln(fold1 / fold2) plus the observed one, fold2 - fold1.
    """
    value = lambda side: F.col("observed_" + side) / (F.col("value_" + side) + pseudo_count) + 1e-4
    base = pairs
    for side in "ab":
        o = observed.select(F.col("key").alias(side + "_key"), F.col("observed").alias("observed_" + side), F.col("fold").alias("fold_" + side))
        base = base.join(o, side + "_key")
    delta = F.col("fold_b") - F.col("fold_a")
    seen = base.select(*PAIR, delta.alias("observed"))
    for side in "ab":
        s = sampled.select(F.col("key").alias(side + "_key"), "sample_id", F.col("value").alias("value_" + side))
        base = base.join(s, [side + "_key"] if side == "a" else ["b_key", "sample_id"])
    return seen, base.select(*PAIR, "sample_id", (F.log(value("a") / value("b")) + delta).alias("value"))
