"""Laws of lengths, positions and budgets, and the files that sampling tasks map."""

import time

import numpy as np
import pytest

from axisloom.functions import placement
from axisloom.functions.placement import EdgePositions, HistogramLengths, Positions, Sorted
from axisloom.operators import algebra, axis_files, counters, samplers


def chi_squared(seen, expected):
    return ((seen - expected) ** 2 / expected).sum()


@pytest.mark.parametrize("bucket", [1, 5])
def test_histogram_lengths_follow_the_observed(bucket):
    rng = np.random.default_rng(1)
    length = rng.choice([3, 10, 11, 25, 40], 2000, p=[0.1, 0.3, 0.2, 0.25, 0.15])
    s = np.column_stack([np.zeros_like(length), length])
    drawn = HistogramLengths(s, bucket).draw(rng, 50_000)
    buckets = -(-length // bucket)
    share = np.bincount(buckets) / len(buckets)
    seen = np.bincount(-(-drawn // bucket), minlength=len(share))
    some = share > 0
    assert seen[~some].sum() == 0
    # four or fewer degrees of freedom; the 0.999 quantile is 18.5
    assert chi_squared(seen[some], share[some] * 50_000) < 18.5
    if bucket > 1:  # within a bucket all lengths alike: 4 degrees of freedom
        inside = np.bincount((drawn[-(-drawn // 5) == 2] - 6).astype(int), minlength=5)
        assert chi_squared(inside, inside.sum() / 5) < 18.5
    again = HistogramLengths.of(np.bincount(buckets), bucket)
    assert (again.draw(np.random.default_rng(7), 500) == HistogramLengths(s, bucket).draw(np.random.default_rng(7), 500)).all()


def test_histograms_are_bounded():
    s = np.array([[0, 5], [0, 1000]])
    with pytest.raises(ValueError, match="too long"):
        HistogramLengths(s, 1, most=100)
    assert HistogramLengths(s, 0, most=100).bucket == 10


def covered(positions, length, n=60_000):
    start = positions.draw(np.random.default_rng(3), np.full(n, length))
    out = np.zeros(300)
    for a in range(length):
        np.add.at(out, start + a, 1)
    return out / n


def test_edges():
    w, length = np.array([[100, 160]]), 20
    even = covered(Positions(w), length)[100:160]
    assert even == pytest.approx(np.full(60, length / 79), rel=0.06)
    edged = covered(EdgePositions(w), length)[100:160]
    x = np.arange(60)
    law = np.maximum(0, length - np.abs(x[:, None] - x[None, :])).sum(axis=0) / length / 60
    assert edged == pytest.approx(law, rel=0.06)
    assert edged[0] < 0.6 * edged[30]


def test_strata_are_filled_together():
    w = [np.array([[x, x + 100] for x in range(0, 20_000, 200)]), np.array([[x + 100, x + 200] for x in range(0, 20_000, 200)])]
    s = [np.array([[x, x + 60] for x in range(0, 4000, 200)]), np.array([[x + 110, x + 150] for x in range(0, 12_000, 200)])]
    totals = np.array([[placement.size(x) for x in placement.across(np.random.default_rng(k), list(zip(s, w, strict=True)))] for k in range(300)])
    assert (totals.sum(axis=1) == 20 * 60 + 60 * 40).all()
    assert totals.std(axis=0).min() > 20  # no stratum is kept exactly
    # lengths of a stratum reach over its borders: about a third of what starts in the one lands in the other
    assert totals.mean(axis=0) == pytest.approx([1500, 2100], rel=0.15)


def test_strata_far_apart_keep_their_shares():
    w = [np.array([[0, 50_000]]), np.array([[100_000, 150_000]])]
    s = [np.array([[x, x + 60] for x in range(0, 4000, 200)]), np.array([[x + 100_000, x + 100_040] for x in range(0, 12_000, 200)])]
    totals = np.array([[placement.size(x) for x in placement.across(np.random.default_rng(k), list(zip(s, w, strict=True)))] for k in range(200)])
    assert (totals.sum(axis=1) == 3600).all()
    assert totals.mean(axis=0) == pytest.approx([1200, 2400], rel=0.03)


def test_growing_sets():
    rng = np.random.default_rng(5)
    make = lambda n: np.column_stack([b := rng.integers(0, 900, n), b + rng.integers(1, 20, n)])
    for _ in range(100):
        found, plain = placement.Growing(), placement.EMPTY
        for n in (30, 5, 1, 0, 12, 1):
            more = make(n)
            before, plain = placement.size(plain), placement.merged(np.vstack([plain, more]))
            assert found.add(more) == placement.size(plain) - before
        assert found.all().tolist() == plain.tolist()


def test_axis_files_over_several_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(t, c, None if c == "c1" else "low", int(a) * 10, int(a) * 10 + 7) for t in ("t", "u") for c in ("c1", "c2") for a in rng.permutation(500)]
    d = spark.createDataFrame([*rows, ("t", "c1", None, 3, 3)], "track string, contig string, isochore string, start long, end long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    files = axis_files.written(d)
    spark.conf.set("spark.sql.adaptive.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.contig, r.isochore, r.name): r.n for r in files.sets.collect()} == {(c, i, t): 500 for t in "tu" for c, i in (("c1", ""), ("c2", "low"))}
    axis = files.axis("c2", "low")
    assert sorted(axis) == ["t", "u"] and max(len(r) for r in axis.runs.values()) > 1
    x = axis["u"]
    assert x.array().tolist() == [[a * 10, a * 10 + 7] for a in range(500)] and x.bases() == 3500
    assert len(files.axis("c9", "")["t"]) == 0


def test_counts_of_every_kind_against_plain_ones():
    rng = np.random.default_rng(9)
    for _ in range(60):
        draw = lambda n: placement.merged(np.column_stack([b := rng.integers(0, 400, n), b + rng.integers(1, 25, n)]))
        s, a, w = draw(12), draw(15), np.array([[0, 500]])
        cover = lambda x: {p for lo, hi in x.tolist() for p in range(lo, hi)}
        meets = lambda x, y: sum(any(lo < d and c < hi for c, d in y.tolist()) for lo, hi in x.tolist())
        middle = lambda x, y: sum(lo + (hi - lo) // 2 in cover(y) for lo, hi in x.tolist())
        common = len(cover(s) & cover(a))
        want = {"nucleotide-overlap": common, "nucleotide-density": common / 500, "segment-overlap": meets(s, a), "annotation-overlap": meets(a, s), "segment-midoverlap": middle(s, a), "annotation-midoverlap": middle(a, s)}
        assert {c: samplers.count(c, s, a, w) for c in want} == pytest.approx(want)
    assert Sorted.of(placement.EMPTY).below(np.array([5])).tolist() == [0]


@pytest.mark.parametrize("options", [{}, {"extension": 31}, {"radius": 5.0}])
def test_shifted_segments_stay_around_the_workspace_near_them(options):
    s = np.array([[5, 12], [20, 26], [48, 63], [70, 71], [90, 99], [300, 310]])
    w = np.array([[0, 10], [15, 30], [40, 50], [55, 80], [95, 120]])
    for k in range(200):
        got = placement.shift(**options)(np.random.default_rng([1, k]), s, w, k)
        rng, parts = np.random.default_rng([1, k]), []
        for a, b in s.tolist():
            reach = options["extension"] // 2 if "extension" in options else int((b - a) * options.get("radius", 2.0) / 2)
            mid = a + (b - a) // 2
            near = [x for u, v in w.tolist() for x in range(max(u, mid - reach, 0), min(v, mid + reach))]
            if near:
                at = int(rng.integers(len(near)))
                parts += [near[(at + i) % len(near)] for i in range(min(b - a, len(near)))]
        assert sorted(set(parts)) == [x for a, b in got.tolist() for x in range(a, b)]


def test_local_permutation_keeps_the_bases_of_each_interval():
    rng = np.random.default_rng(3)
    w = np.column_stack([np.arange(50_000) * 300, np.arange(50_000) * 300 + 250])
    s = placement.merged(np.column_stack([w[:, 0] + rng.integers(0, 100, len(w)), w[:, 0] + rng.integers(120, 250, len(w))]))
    s = placement.merged(np.vstack([s, [[251, 260]], np.column_stack([w[::3, 0] + 270, w[::3, 0] + 280])]))
    out = placement.local_permutation()(np.random.default_rng(1), s, w, 0)
    of = lambda x: placement.covered_before(x, w[:, 1]) - placement.covered_before(x, w[:, 0])
    assert (of(out) == of(s)).all() and placement.size(out) == int(of(s).sum())


@pytest.mark.parametrize("name", ["shift", "local-permutation"])
def test_placing_takes_no_step_of_python_for_a_segment(name):
    at = np.arange(100_000) * 300
    s, w = np.column_stack([at + 10, at + 50]), np.column_stack([at, at + 250])
    place = placement.PLACERS[name]()
    began = time.process_time()
    assert placement.size(place(np.random.default_rng(1), s, w, 0)) == 40 * len(s)
    assert time.process_time() - began < 2


def test_samples_are_handed_over_in_frames_of_bounded_size():
    x = np.column_stack([np.arange(150_000) * 10, np.arange(150_000) * 10 + 4])
    frames = list(samplers._samples("a", "c", "", 3, x))
    assert max(map(len, frames)) <= samplers.FRAME and sum(map(len, frames)) == len(x)
    assert (np.concatenate([f["start"].to_numpy() for f in frames]) == x[:, 0]).all() and (np.concatenate([f["end"].to_numpy() for f in frames]) == x[:, 1]).all()
    assert set(frames[-1]["sample_id"]) == {3} and frames[0]["isochore"].isna().all()


def test_shifted_segments_are_counted_where_they_meet_annotations(spark):
    rng = np.random.default_rng(5)
    made = lambda names, n: [(str(rng.choice(names)), str(rng.choice(["c1", "c2"])), int(s), int(s + k)) for s, k in zip(rng.integers(0, 9000, n), rng.integers(1, 400, n), strict=True)]
    schema = "track string, contig string, start long, end long"
    s, a = (algebra.normalize(spark.createDataFrame(made(*x), schema)) for x in ((["t", "u"], 60), (["x", "y", "z"], 40)))
    pairs = counters.pairs_of(s, a)
    moved = counters.sampled("nucleotide-overlap", samplers.shift_by_hash(s, 7, 150), a, None, 7, pairs)
    there = counters.completed("nucleotide-overlap", samplers.shift_by_hash_overlap(s, a, 7, 150), 7, pairs)
    assert sorted(map(tuple, there.collect())) == sorted(map(tuple, moved.collect())) and there.count() == 42
    # a sample's number is given after the join, so that no shuffle of segments holds samples
    plan = samplers.shift_by_hash_overlap(s, a, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(") < plan.index("SortMergeJoin")


def _axis(n, reach=25):
    """Workspace intervals of all kinds, some of which touch, and segments that hang over them."""
    rng = np.random.default_rng(8)
    low = np.cumsum(rng.choice([0, 5, 60], n, p=[0.1, 0.2, 0.7]) + 40)
    w = np.column_stack([low - 40, low - rng.choice([0, 10], n)])
    start = np.sort(rng.choice(low[-1], n // 2, replace=False))
    return placement.merged(np.column_stack([start, start + rng.integers(1, reach, len(start))])), w


@pytest.mark.parametrize("name, options", [("annotator", {}), ("annotator", {"positions": "edge"}), ("annotator", {"lengths": "histogram", "bucket": 5}), ("brute-force", {"inner": 2000})])
@pytest.mark.parametrize("shard", [7, 64, 5000])
def test_shards_keep_bases_and_bounds(name, options, shard):
    s, w = _axis(2000)
    space = placement.Space(placement.Held(s), placement.Held(w), shard)
    assert space.target == placement.size(placement.clipped(s, w))
    placer = placement.PLACERS[name](**options)
    for k in range(5):
        x = np.vstack(list(placer.fill(np.random.default_rng([2, k]), space)))
        assert placement.size(x) == space.target and (x[1:, 0] >= x[:-1, 1]).all()
        assert placement.size(placement.clipped(x, w)) == space.target


@pytest.mark.parametrize("name", ["annotator", "brute-force"])
def test_shards_do_not_change_the_law(name):
    s, w = _axis(400)
    s = s[s[:, 0] < s[-1, 1] // 3]  # room is left, whose share of each base is to be the same
    placer = placement.PLACERS[name]()

    def share(shard):
        space, out = placement.Space(placement.Held(s), placement.Held(w), shard), []
        for k in range(400):
            x = np.vstack(list(placer.fill(np.random.default_rng([shard, k]), space)))
            out.append(np.diff(placement.covered_before(x, np.linspace(0, w[-1, 1], 21).astype(int))))
        return np.array(out)

    few, one = share(9), share(1000)
    error = np.sqrt(few.var(axis=0) / len(few) + one.var(axis=0) / len(one))
    assert (np.abs(few.mean(axis=0) - one.mean(axis=0)) < 4.5 * error).all()
    assert few.std(axis=0) == pytest.approx(one.std(axis=0), rel=0.2)


def test_annotations_over_several_shards_count_once(spark):
    s, w = _axis(600)
    a = placement.merged(np.column_stack([x := np.arange(0, w[-1, 1], 300), x + 280]))
    frame = lambda x, track: spark.createDataFrame([(track, "c", int(b), int(e)) for b, e in x], "track string, contig string, start long, end long")
    kinds = ("nucleotide-overlap", "nucleotide-density", "segment-overlap", "segment-midoverlap", "annotation-overlap", "annotation-midoverlap")
    space = placement.Space(placement.Held(s), placement.Held(w), 5)
    values, ends, found = dict.fromkeys(kinds, 0.0), {}, []
    for x in placement.annotator().fill(np.random.default_rng(4), space):
        found.append(x)
        if len(x):
            y, at = samplers._met(placement.Held(a), x)
            for c in kinds:
                values[c] += samplers._value(c, Sorted.of(x), Sorted.of(x), y, int(space.sizes.sum()))
            values["annotation-overlap"] -= samplers._again(ends, "a", Sorted.of(x), y, at) if len(y) else 0
    whole = np.vstack(found)
    assert values == pytest.approx({c: samplers.count(c, whole, a, w) if not c.startswith("segment") else samplers._value(c, Sorted.of(whole), Sorted.of(whole), Sorted.of(a), 1) for c in kinds})
    got = samplers.sampled_counts(frame(s, "t"), frame(a, "a"), frame(w, "w"), 2, kinds).collect()
    assert len(got) == 12 and all(r.value > 0 for r in got)


def test_large_sets_are_read_in_stretches(spark, monkeypatch):
    s, w = _axis(3000)
    frame = lambda x: spark.createDataFrame([("t", "c", int(b), int(e)) for b, e in x], "track string, contig string, start long, end long")
    axis = axis_files.written(frame(s)).axis("c", "")
    held = axis.rows("t")
    monkeypatch.setattr(axis_files, "HELD", 10)
    read = axis.rows("t")
    assert isinstance(held, placement.Held) and isinstance(read, axis_files.Runs) and len(read) == len(s)
    at = np.arange(0, int(s[-1, 1]) + 50, 37)
    assert (read.before(at) == held.before(at)).all() and (read.begun(at) == held.begun(at)).all()
    assert read.stretch(5, 900).tolist() == s[5:900].tolist() and read.stretch(len(s) - 3, len(s) + 5).tolist() == s[-3:].tolist()
    few = placement.Shelf(most=100)
    for i, n in enumerate((60, 50, 0, 30)):
        few.put(i, s[:n])
    few.put(0, s[:200])
    assert [few.get(i).tolist() for i in range(4)] == [s[:n].tolist() for n in (200, 50, 0, 30)] and few.file is not None and few.held <= 100


@pytest.mark.parametrize("far, longest", [(0, 20), (1 << 50, 20), (0, 1 << 21)])
def test_merging_near_far_and_long_intervals(far, longest):
    rng = np.random.default_rng(3)
    x = np.column_stack([b := rng.integers(0, 900, 60) + far, b + rng.integers(0, longest, 60)])
    want = []
    for lo, hi in sorted(map(tuple, x[x[:, 1] > x[:, 0]].tolist())):
        if want and lo <= want[-1][1]:
            want[-1][1] = max(want[-1][1], hi)
        else:
            want.append([lo, hi])
    assert placement.merged(x).tolist() == want


def test_filling_sorts_no_places():
    s, w = _axis(150_000)
    began = time.process_time()
    space = placement.Space(placement.Held(s), placement.Held(w))
    assert sum(placement.size(x) for x in placement.annotator().fill(np.random.default_rng(1), space)) == space.target
    assert time.process_time() - began < 2
