"""Annotations as sets of ids, and summaries of samples, on small cases and against plain loops."""

import math
from collections import Counter

import numpy as np

from axisloom.functions import placement, statistics
from axisloom.operators import id_sets, samplers

SETS = "annotation string, id string"
IDS = "id string, contig string, start long, end long"
SPACE = "track string, contig string, start long, end long"


def test_report_and_cleaned(spark):
    ids = spark.createDataFrame([("in", "c", 10, 20), ("in", "c", 15, 30), ("edge", "c", 95, 120), ("out", "c", 100, 110), ("far", "d", 0, 5), ("spare", "c", 0, 1)], IDS)
    space = spark.createDataFrame([("w", "c", 0, 100)], SPACE)
    rows = [("a", "in"), ("a", "in"), ("a", "edge"), ("a", "out"), ("b", "edge"), ("b", "in"), ("b", "ghost"), ("c", "far"), ("c", "ghost"), ("d", "in"), (None, "in"), ("e", None)]
    sets = spark.createDataFrame(rows, SETS)
    got = {r.annotation: tuple(r)[1:] for r in id_sets.report(sets, ids, space).collect()}
    assert got == {"a": (3, 0, 1, 2, None, True), "b": (3, 1, 0, 2, "a", False), "c": (2, 1, 1, 0, None, False), "d": (1, 0, 0, 1, None, True)}
    assert sorted(map(tuple, id_sets.cleaned(sets, ids, space).collect())) == [("a", "edge"), ("a", "in"), ("d", "in")]
    assert [r.id for r in id_sets.unused(ids, sets).collect()] == ["spare"]


def test_empty_tables(spark):
    none, ids, space = spark.createDataFrame([], SETS), spark.createDataFrame([], IDS), spark.createDataFrame([], SPACE)
    subsets = spark.createDataFrame([], "subset string, contig string")
    assert id_sets.report(none, ids, space).count() == 0
    assert id_sets.cleaned(none, ids, space).count() == 0
    assert id_sets.support(space, space).count() == 0
    assert id_sets.subset_counts(space, none, ids, space, subsets).count() == 0


def test_subset_counts_have_zeros_and_count_an_id_once_per_set(spark):
    segments = spark.createDataFrame([("s", "c", 0, 50), ("s", "d", 0, 10)], SPACE)
    ids = spark.createDataFrame([("x", "c", 40, 60), ("x", "c", 45, 70), ("y", "d", 5, 8)], IDS)
    sets = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("a", "y")], SETS)
    space = spark.createDataFrame([("w", "c", 0, 48), ("w", "d", 0, 10)], SPACE)
    subsets = spark.createDataFrame([("", "c"), ("", "d"), ("only", "c")], "subset string, contig string")
    got = {r.annotation: (r.bases, r.share) for r in id_sets.subset_counts(segments, sets, ids, space, subsets).collect()}
    assert got == {"a": (11, 11 / 58), "b": (3, 3 / 58), "only.a": (8, 8 / 48), "only.b": (0, 0.0)}


def _counts(spark, seed=3, n=40, pairs=12):
    draw = np.random.default_rng(seed)
    values = {f"a{k}": draw.integers(0, 9, n).astype(float).tolist() for k in range(pairs)}
    seen = {k: float(draw.integers(0, 14)) for k in values}
    pair = "counter string, track string, annotation string"
    s = spark.createDataFrame([("c", "t", k, i, v) for k, all_ in values.items() for i, v in enumerate(all_)], f"{pair}, sample_id int, value double")
    return seen, values, spark.createDataFrame([("c", "t", k, v) for k, v in seen.items()], f"{pair}, observed double"), s


def test_false_discovery_summary_against_a_loop(spark):
    seen, values, o, s = _counts(spark)
    n = 40
    got = {(r.cutoff, r.category): r for r in statistics.false_discovery_summary(o, s, (0.01, 0.05, 0.2)).collect()}
    assert len(got) == 9
    for cutoff in (0.01, 0.05, 0.2):
        level = math.floor(cutoff * n + 1e-9)
        over, under = Counter(), Counter()
        for all_ in values.values():
            high = sorted(range(n), key=lambda i, a=all_: (-a[i], i))
            low = sorted(range(n), key=lambda i, a=all_: (a[i], i))
            for i in range(n):
                h, w = high.index(i), low.index(i)
                if h < level and h <= w:
                    over[i] += 1
                elif w < level:
                    under[i] += 1
        for name, of in (("over", over), ("under", under), ("significant", over + under)):
            r, counts = got[cutoff, name], sorted(of[i] for i in range(n))
            if level:
                assert (r.level, r.median, r.upper) == (level, counts[n // 2], counts[19 * n // 20])
                assert math.isclose(r.average, sum(counts) / n)
            else:
                assert (r.level, r.average, r.median, r.upper) == (0, None, None, None)
        found = Counter()
        for k, v in seen.items():
            ge, le = sum(x >= v for x in values[k]), sum(x <= v for x in values[k])
            if v != sum(values[k]) / n and (min(ge, le) + 1) / (n + 1) <= cutoff:
                found.update(["significant", "over" if ge < le else "under"])
        assert all(got[cutoff, c].observed == found[c] for c in ("significant", "over", "under"))


def test_rank_index_and_histogram(spark):
    _, values, _, s = _counts(spark)
    for r in statistics.rank_index(s).collect():
        all_ = values[r.annotation]
        assert (r.below, r.upto) == (sum(v < r.value for v in all_), sum(v <= r.value for v in all_))
    h = {r["bin"]: r.n for r in statistics.histogram(s, "value", 0.0, 8.0, 4).collect()}
    flat = [v for all_ in values.values() for v in all_]
    assert h == {b: sum(b == min(3, int(v // 2)) for v in flat) for b in range(4)}


def test_sampled_counts_do_not_depend_on_batches(spark):
    draw = np.random.default_rng(1)
    rows = [(t, c, int(x) * 50, int(x) * 50 + int(draw.integers(5, 40))) for t in "st" for c in "cd" for x in draw.choice(200, 40, replace=False)]
    s, a = spark.createDataFrame(rows, SPACE), spark.createDataFrame([("a", "c", 0, 3000), ("b", "d", 2000, 9000)], SPACE)
    w = spark.createDataFrame([("w", c, b, b + 4000) for c in "cd" for b in (0, 5000)], SPACE).drop("track")
    runs = [sorted(map(tuple, samplers.sampled_counts(s, a, w, 60, seed=4, batch=b).collect())) for b in (None, 7, 60)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 2 * 2 * 60


def test_annotator_covers_exactly_the_bases(spark):
    draw = np.random.default_rng(2)
    for k in range(60):
        make = lambda n, most: placement.merged(np.column_stack([b := draw.integers(0, 4000, n), b + draw.integers(1, most, n)]))
        s, w = make(int(draw.integers(1, 80)), 20), make(int(draw.integers(5, 40)), 200)
        x = placement.PLACERS["annotator"]()(np.random.default_rng(k), s, w, 0)
        assert placement.size(x) == placement.size(placement.clipped(s, w)) == placement.size(placement.clipped(x, w))
        assert (x[1:, 0] > x[:-1, 1]).all()
