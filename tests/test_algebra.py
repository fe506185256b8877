"""Interval algebra against known answers and against a bitmap model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.storage import new_path
from axisloom.operators import algebra, collections, points

SCHEMA = "track string, contig string, start long, end long"


def df(spark, pairs, track="t", contig="c"):
    return spark.createDataFrame([(track, contig, int(a), int(b)) for a, b in pairs], SCHEMA)


def rows(d):
    return sorted((r.start, r.end) for r in d.select("start", "end").collect())


TEN = [(x, x + 10) for x in range(0, 1000, 100)]
TOUCHING = [(x, x + 100) for x in range(0, 1000, 100)]


@pytest.mark.parametrize(
    "pairs, count, bases",
    [([(x, x + 1000) for x in range(0, 1000, 100)], 1, 1900), (TOUCHING, 10, 1000), ([(0, 0)], 0, 0), ([(0, x) for x in range(10, 110, 10)], 1, 100)],
)
@pytest.mark.parametrize("block", [1 << 18, 64])
def test_normalize(spark, pairs, count, bases, block):
    out = rows(algebra.normalize(df(spark, pairs), block))
    assert (len(out), sum(b - a for a, b in out)) == (count, bases)


def test_merge_distance(spark):
    assert rows(algebra.merge(df(spark, TOUCHING), 0)) == [(0, 1000)]
    for distance, count in ((89, 10), (90, 1)):
        assert len(rows(algebra.merge(df(spark, TEN), distance))) == count


@pytest.mark.parametrize("distance", [-1, 0, 7])
def test_merge_against_a_loop(spark, distance):
    rng = np.random.default_rng(distance + 1)
    every, want = [], []
    for contig, most in (("a", 12), ("b", 200), (None, 40)):
        starts = rng.integers(0, 3000, 120)
        pairs = sorted((int(s), int(s + n)) for s, n in zip(starts, rng.integers(0, most, 120), strict=True) if not 900 < s < 1400)
        every += [("t", contig, s, e) for s, e in pairs]
        isles = []
        for s, e in pairs:
            if e > s and isles and s - distance <= isles[-1][1]:
                isles[-1][1] = max(isles[-1][1], e)
            elif e > s:
                isles.append([s, e])
        want += [(contig, s, e) for s, e in isles]
    data = spark.createDataFrame(every, SCHEMA)
    for block in (16, 64, 1 << 18):
        got = [(r.contig, r.start, r.end) for r in algebra.merge(data, distance, block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_merge_shuffles_rows_once(spark):
    data = spark.range(100).selectExpr("'t' as track", "'c' as contig", "id * 10 as start", "id * 10 + 15 as end")
    with_rows = algebra.normalize(data)._jdf.queryExecution().executedPlan().toString()
    # summaries of blocks are unioned with the rows, not joined with them
    assert "Join" not in with_rows and "Union" in with_rows


def test_expand_extend_shift(spark):
    assert sum(b - a for a, b in rows(algebra.expand(df(spark, TEN), 2.0))) == 195
    assert rows(algebra.extend(df(spark, [(5, 10)]), 7)) == [(0, 17)]
    assert rows(algebra.shift(df(spark, [(5, 10)]), -5)) == [(0, 5)]
    with pytest.raises(Exception, match="below 0"):
        rows(algebra.shift(df(spark, [(5, 10)]), -6))
    with pytest.raises(ValueError):
        algebra.expand(df(spark, TEN), 0)


def test_pairs_of_sets(spark):
    a = df(spark, TEN)
    halves = df(spark, [p for x in range(0, 1000, 100) for p in ((x, x + 5), (x + 5, x + 10))], "u")
    assert rows(algebra.intersect(df(spark, [(0, 1000)], "u"), a)) == TEN
    assert algebra.overlapping(a, halves).count() == 10 and algebra.overlapping(halves, a).count() == 20
    assert rows(algebra.overlapping(df(spark, [(x, x + 5) for x in range(500, 2000, 100)], "u"), a)) == [(x, x + 5) for x in range(500, 1000, 100)]
    assert rows(algebra.overlapping(df(spark, [(0, 56)]), df(spark, [(0, 50), (75, 125)], "u"))) == [(0, 56)]


@pytest.mark.parametrize(
    "left, right, want",
    [([(0, 1000)], TEN, [(x + 10, x + 100) for x in range(0, 1000, 100)]), ([(0, 12000)], [(0, 10000)], [(10000, 12000)]), ([(0, 5)], [(6, 7)], [(0, 5)]), ([(0, 5), (20, 30), (40, 50)], [(1, 2)], [(0, 1), (2, 5), (20, 30), (40, 50)])],
)
def test_subtract(spark, left, right, want):
    assert rows(algebra.subtract(df(spark, left), df(spark, right, "u").drop("track"))) == want


def test_subtract_without_other_contig(spark):
    assert rows(algebra.subtract(df(spark, [(0, 5)]), df(spark, [(0, 5)], "u", "d").drop("track"))) == [(0, 5)]


def test_check(spark):
    algebra.check(df(spark, TOUCHING))
    for bad in ([(0, 10), (9, 20)], [(3, 3)]):
        with pytest.raises(ValueError):
            algebra.check(df(spark, bad))


def test_isochores_round_trip(spark):
    a = df(spark, [(x, x + 250) for x in range(0, 2000, 500)])
    tiles = df(spark, [(x, x + 100) for x in range(0, 3000, 200)], "high").unionByName(df(spark, [(x, x + 100) for x in range(100, 3000, 200)], "low"))
    for cut in (True, False):
        assert rows(collections.from_isochores(collections.to_isochores(a, tiles, cut))) == rows(a)


def test_points(spark):
    p = spark.createDataFrame([("t", "c", x) for x in list(range(0, 1000, 100)) * 2], "track string, contig string, pos long")
    assert points.normalize(p).count() == 10
    assert points.count_in_range(p, 100, 110).first().overlap == 2
    assert points.in_intervals(p, df(spark, [(100, 110), (105, 201)], "u")).count() == 4


def bitmap(pairs, n=260):
    out = np.zeros(n, bool)
    for a, b in pairs:
        out[a:b] = True
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_bitmaps(spark, seed):
    rng = np.random.default_rng(seed)
    some = lambda n: [(int(a), int(a + k)) for a, k in zip(rng.integers(0, 200, n), rng.integers(0, 30, n), strict=True)]
    x, y = some(15), some(15)
    a, b = algebra.normalize(df(spark, x), 32), algebra.normalize(df(spark, y, "u"), 32).drop("track")
    assert (bitmap(rows(a)) == bitmap(x)).all()
    assert (bitmap(rows(algebra.intersect(a, b, 16))) == (bitmap(x) & bitmap(y))).all()
    assert (bitmap(rows(algebra.subtract(a, b, 16))) == (bitmap(x) & ~bitmap(y))).all()
    both = algebra.coverage(df(spark, rows(a)).unionByName(df(spark, rows(b))), 2, 32)
    assert (bitmap(rows(both)) == (bitmap(x) & bitmap(y))).all()
    gaps = rows(algebra.gaps(a, 0, 260, 32))
    assert (bitmap(gaps) == ~bitmap(x)).all()


def test_null_isochore_is_a_value(spark):
    d = df(spark, [(0, 10), (5, 20)]).withColumn("isochore", F.lit(None).cast("string"))
    assert rows(algebra.normalize(d)) == [(0, 20)]
    assert rows(algebra.intersect(algebra.normalize(d), d.limit(0).unionByName(d))) != []


def test_empty(spark):
    none = df(spark, [])
    some = df(spark, TEN)
    assert rows(algebra.normalize(none)) == rows(algebra.subtract(none, some)) == rows(algebra.intersect(some, none)) == []
    assert rows(algebra.subtract(some, none)) == TEN


def test_nested_bins(spark):
    import random

    rng = random.Random(4)
    sizes = [1, 50, 5000, 200_000, 3_000_000, 10**8, 1 << 31]
    make = lambda n: [(rng.choice("xy"), "c", a := rng.randrange(1 << 31), a + rng.choice(sizes) * rng.randint(1, 3)) for _ in range(n)]
    names = "track string, contig string, start long, end long"
    left, right = make(150), make(150)
    a, b = spark.createDataFrame(left, names), spark.createDataFrame(right, names)
    got = algebra.overlap_join(a, b, nested=True).select("track", "start", "end", "track_b", "start_b", "end_b").collect()
    want = [(t, s, e, u, c, d) for t, _, s, e in left for u, _, c, d in right if s < d and c < e]
    assert sorted(map(tuple, got)) == sorted(want)
    points = spark.createDataFrame([("p", "c", s) for _, _, s, _ in left], "track string, contig string, pos long")
    assert algebra.overlap_join(points, b, nested=True).count() == sum(c <= s < d for _, _, s, _ in left for _, _, c, d in right)
    assert algebra.overlap_join(points, points, nested=True).count() == len(left)


def test_a_long_interval_takes_few_rows(spark):
    from pyspark.sql import functions as F

    long = spark.createDataFrame([("t", "c", 5, 1 << 31)], "track string, contig string, start long, end long")
    short = spark.range(10_000).select(F.lit("u").alias("track"), F.lit("c").alias("contig"), (F.col("id") * 200_000).alias("start"), (F.col("id") * 200_000 + 30).alias("end"))
    highest = algebra._highest(long, algebra.BIN)
    assert algebra._binned(long, algebra.BIN, highest).count() <= 33
    assert algebra._binned(short, algebra.BIN, highest).count() < 5 * 10_000
    assert algebra._binned(short, algebra.BIN, algebra._highest(short, algebra.BIN)).count() < 1.1 * 10_000
    assert algebra.overlap_join(short, long, nested=True).count() == 10_000


def test_lookups(spark):
    import random

    rng = random.Random(5)
    rows = [("t" if rng.random() < 0.7 else None, rng.randrange(3_000_000), i) for i in range(300)] + [("t", 7, 1), ("t", 7, 0)]
    points = [(rng.choice(["t", "v", None]), rng.randrange(3_100_000), i) for i in range(200)] + [("t", 7, 900), ("t", 6, 901)]
    r = spark.createDataFrame(rows, "contig string, start long, x int")
    p = spark.createDataFrame(points, "contig string, pos long, y int")
    for block in (1 << 10, 1 << 18, 1 << 24):
        for q in algebra.lookup(p, r, ["contig"], block).collect():
            own = sorted((s, x) for c, s, x in rows if c == q.contig)
            before, after = [o for o in own if o[0] <= q.pos], [o for o in own if o[0] > q.pos]
            assert (tuple(q.before) if q.before else None) == (before[-1] if before else None)
            assert (tuple(q.after) if q.after else None) == (after[0] if after else None)
    assert algebra.lookup(p, r, ["contig"]).count() == len(points)
    assert algebra.lookup(p, r.filter("false"), ["contig"]).filter("before is null and after is null").count() == len(points)


def test_pairs_are_not_broadcast_by_the_size_of_files(spark):
    rows = [("t", "chr0", i * 10, i * 10 + 5) for i in range(50)]
    df = spark.createDataFrame(rows, "track string, contig string, start long, end long")
    path = new_path(spark)
    df.write.parquet(path)
    a = b = spark.read.parquet(path)
    for out in (algebra.overlap_join(a, b), algebra.overlapping(a, b), algebra.intersect(a, b)):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert algebra.overlapping(a, b).count() == 50
