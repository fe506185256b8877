"""Statistics against anchors, closed forms and plain loops."""

import math
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.functions import placement, special, statistics
from axisloom.operators import aggregates, samplers


def counts(spark, samples, observed):
    s = spark.createDataFrame([("c", "t", "a", i, float(v)) for i, v in enumerate(samples)], "counter string, track string, annotation string, sample_id int, value double")
    return spark.createDataFrame([("c", "t", "a", float(observed))], "counter string, track string, annotation string, observed double"), s


def test_p_value_of_largest(spark):
    samples = [0] * 66 + [1] * 2 + [2] * 20 + [3] + [4] * 6 + [6] * 2 + [8] * 2 + [16]
    r = statistics.enrichment(*counts(spark, samples, 16)).first()
    assert r.pvalue == 0.01 and r.expected == pytest.approx(np.mean(samples)) and r.fold == pytest.approx(17 / (np.mean(samples) + 1))


def rule(samples, obs):
    n, lt, le, mean = len(samples), sum(v < obs for v in samples), sum(v <= obs for v in samples), sum(samples) / len(samples)
    if lt == n:
        k = 1
    elif obs > mean:
        k = (n - lt if lt else n - 1) if le > lt else n - lt - 1
    else:
        k = le
    return max(1 / n, k / n)


def test_p_value_rule(spark):
    rng = np.random.default_rng(5)
    obs, rows, want = [], [], {}
    for i in range(40):
        samples = rng.integers(0, 8, 20)
        o = float(rng.integers(-1, 10)) if i % 2 else float(rng.random() * 9)
        obs.append(("c", str(i), "a", o))
        rows += [("c", str(i), "a", j, float(v)) for j, v in enumerate(samples)]
        want[str(i)] = rule([float(v) for v in samples], o)
    o = spark.createDataFrame(obs, "counter string, track string, annotation string, observed double")
    s = spark.createDataFrame(rows, "counter string, track string, annotation string, sample_id int, value double")
    got = {r.track: r.pvalue for r in statistics.enrichment(o, s).collect()}
    assert got == pytest.approx(want)


def test_benjamini_hochberg(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.04, 0.5, 0.001])], "i int, pvalue double")
    got = [r.qvalue for r in statistics.adjust_p(d).orderBy("i").collect()]
    assert got == pytest.approx([0.03, 0.048, 0.048, 0.048, 0.5, 0.006])
    with pytest.raises(NotImplementedError):
        statistics.adjust_p(d, "hommel")


def test_tails_against_exact_sums():
    for n, p in ((20, 0.3), (300, 0.02)):
        for k in (0, 1, 5, 12, n):
            exact = sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k, n + 1))
            assert special.binomial_sf(k, n, p) == pytest.approx(float(exact), rel=1e-9)
    for total, marked, drawn in ((50, 20, 15), (1000, 30, 400)):
        for k in (0, 1, 5, 12, 15):
            exact = sum(Fraction(math.comb(marked, i) * math.comb(total - marked, drawn - i), math.comb(total, drawn)) for i in range(k, min(marked, drawn) + 1) if drawn - i <= total - marked)
            assert special.hypergeometric_sf(k, total, marked, drawn) == pytest.approx(float(exact), rel=1e-8, abs=1e-15)
    assert special.normal_tail(0) == 0.5


def test_storey_weights_are_those_of_a_cubic_fit():
    grid = np.arange(0, 0.95, 0.05)
    y = np.random.default_rng(0).random(len(grid))
    assert special.storey_weights(grid) @ y == pytest.approx(np.polyval(np.polyfit(grid, y, 3), grid[-1]))


def test_summary_and_histogram(spark):
    d = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3]], "v double")
    r = aggregates.summary(d, "v").first()
    assert (r.nval, r.min, r.max, r.median, r.q1, r.q3) == (5, 1, 5, 3, 2, 4)
    i = spark.createDataFrame([("t", 0, 10), ("t", 0, 11)], "track string, start long, end long")
    assert sorted((r.bucket, r.n) for r in aggregates.length_histogram(i, 5).collect()) == [(2, 1), (3, 1)]
    with pytest.raises(Exception, match="too long"):
        aggregates.length_histogram(i, 1, 10).collect()


W = np.array([[x, x + 990] for x in range(0, 20000, 1000)])
S = np.array([[x, x + 100] for x in range(0, 20000, 2000)])


@pytest.mark.parametrize("name", ["annotator", "brute-force", "global-permutation", "local-permutation"])
def test_samplers_keep_bases(name):
    for k in range(20):
        x = placement.PLACERS[name]()(np.random.default_rng([1, k]), S, W, k)
        assert placement.size(placement.clipped(x, W)) == placement.size(placement.clipped(S, W))
        assert (x[1:, 0] >= x[:-1, 1]).all()


def test_annotator_is_uniform():
    hits = np.zeros(20000)
    n = 600
    for k in range(n):
        for a, b in placement.annotator()(np.random.default_rng([2, k]), S, W, k):
            hits[a:b] += 1
    inside = np.concatenate([hits[a:b] for a, b in W])
    assert inside.mean() == pytest.approx(n * placement.size(S) / placement.size(W), rel=0.02)
    by_tile = np.array([hits[a:b].mean() for a, b in W])
    assert by_tile == pytest.approx(np.full(len(W), inside.mean()), rel=0.2)


def test_unit_segments_follow_the_hypergeometric_mean():
    w, s, a = np.array([[0, 1000]]), np.column_stack([np.arange(0, 100, 10), np.arange(0, 100, 10) + 1]), np.array([[0, 100]])
    values = [samplers.count("nucleotide-overlap", placement.annotator()(np.random.default_rng([3, k]), s, w, k), a, w) for k in range(3000)]
    assert np.mean(values) == pytest.approx(1.0, abs=0.06)


def test_trimming_wraps():
    x = np.array([[0, 10], [20, 30]])
    assert placement.trimmed(x, 15, 1, True).tolist() == [[5, 10]]
    assert placement.trimmed(x, 15, 0, False).tolist() == [[20, 25]]


def test_samples_do_not_depend_on_partitions(spark):
    s = spark.createDataFrame([("t", "c", int(a), int(b)) for a, b in S], "track string, contig string, start long, end long")
    w = spark.createDataFrame([("c", int(a), int(b)) for a, b in W], "contig string, start long, end long")
    one = samplers.sample(s, w, 4, batch=2).select("sample_id", "start", "end")
    two = samplers.sample(s.repartition(7), w.repartition(3), 4, batch=3).select("sample_id", "start", "end")
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_fused_counts_equal_counts_of_samples(spark):
    from axisloom.operators import counters

    s = spark.createDataFrame([("t", "c", int(a), int(b)) for a, b in S], "track string, contig string, start long, end long")
    w = spark.createDataFrame([("w", "c", int(a), int(b)) for a, b in W], "track string, contig string, start long, end long")
    a = spark.createDataFrame([("a", "c", 0, 500), ("a", "c", 900, 1500), ("b", "c", 5000, 9000)], "track string, contig string, start long, end long")
    sets = samplers.sample(s, w, 3, "global-permutation").drop("isochore")
    for name in ("nucleotide-overlap", "nucleotide-density", "segment-overlap", "segment-midoverlap", "annotation-overlap", "annotation-midoverlap"):
        fused = samplers.sampled_counts(s, a, w, 3, (name,), "global-permutation")
        rows = counters.sampled(name, sets, a, w, 3, counters.pairs_of(s, a))
        key = lambda d: {(r.annotation, r.sample_id): round(r.value, 9) for r in d.collect()}
        assert key(fused) == key(rows)
    assert fused.select(F.count("*")).first()[0] == 6


def test_benjamini_yekutieli_takes_one_step_a_row(spark):
    n = 200_000
    df = spark.range(1, n + 1).select(((F.col("id") - 0.5) / (100 * n)).alias("pvalue"))
    # a sum over all ranks for each row would take some 4e10 steps
    began = time.time()
    rows = statistics.adjust_p(df, "BY").agg(F.max("qvalue").alias("q"), F.min("qvalue").alias("least")).first()
    assert time.time() - began < 60
    harmonic = sum(1 / k for k in range(1, n + 1))
    assert rows["least"] == pytest.approx(harmonic / 200, rel=1e-12)
    assert rows["q"] == pytest.approx(harmonic / 100 * (1 - 0.5 / n), rel=1e-12)


@pytest.mark.parametrize("n", [1, 2, 99, 100, 101, 5000])
def test_sum_of_reciprocals(spark, n):
    got = spark.range(1).select(statistics._harmonic(F.lit(n).cast("long")).alias("h")).first()["h"]
    assert got == pytest.approx(sum(1 / k for k in range(1, n + 1)), rel=1e-14)
