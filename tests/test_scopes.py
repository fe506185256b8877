"""Workspaces that depend on names: what is in each, and what a run of them shuffles and leaves on disk."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from axisloom.operators import algebra, workspaces
from axisloom.plans import analysis
from axisloom.plans import queries as plans
from axisloom.storage import kept

SF = "/root/testdata/sf0.001"
SCOPES = [("cooccurance", {}), ("annotation-centered", {"extension": 15}), ("segment-centered", {"extension": 15})]


def intervals(spark, seed, tracks, n, longest):
    r = random.Random(seed)
    rows = [(r.choice(tracks), r.choice("xy"), s := r.randrange(3000), s + r.randrange(1, longest)) for _ in range(n)]
    return kept(algebra.normalize(spark.createDataFrame(rows, "track string, contig string, start long, end long")))


@pytest.fixture(scope="module")
def sets(spark):
    return intervals(spark, 1, "ST", 60, 40), intervals(spark, 2, "ABC", 40, 60), intervals(spark, 3, "w", 30, 90).withColumn("track", F.lit("collapsed"))


def touching(x, y):
    return x[-3] == y[-3] and x[-2] < y[-1] and y[-2] < x[-1]


@pytest.mark.parametrize("name, options", SCOPES)
def test_scopes_of_all_names_are_those_of_each_pair(spark, sets, name, options):
    by = workspaces.CONDITIONS[name]
    found = analysis.apply_spaces(*sets[:2], workspaces.SPACES[name](**options)(*sets), by)
    s, a, w = (sorted(map(tuple, x.select("track", "contig", "start", "end").collect())) for x in sets)
    wanted = [set(), set(), set()]
    for t in "ST":
        for n in "ABC":
            own_s, own_a = [x for x in s if x[0] == t], [x for x in a if x[0] == n]
            if name == "cooccurance":
                space = [x[1:] for x in w if any(touching(x, y) for y in own_s) and any(touching(x, y) for y in own_a)]
            else:
                wide = {(c, p) for _, c, lo, hi in (own_a if "annotation" in by else own_s) for p in range(max(lo - 15, 0), hi + 15)}
                # single bases, as pieces are compared by what they cover
                space = [(c, p, p + 1) for _, c, lo, hi in w for p in range(lo, hi) if (c, p) in wide]
            label = "\x1f".join({"track": t, "annotation": n}[c] for c in by) + "\x1f"
            wanted[0] |= {(t, label + x[1], *x[2:]) for x in own_s if any(touching(x, y) for y in space)}
            wanted[1] |= {(n, label + c, p) for _, c, lo, hi in own_a for y in space if y[0] == c for p in range(max(lo, y[1]), min(hi, y[2]))}
            wanted[2] |= {(label + c, p) for c, lo, hi in space for p in range(lo, hi)}
    got = [list(map(tuple, x.select(*c, "contig", "start", "end").collect())) for x, c in zip(found, (["track"], ["track"], []), strict=True)]
    bases = [[(*x[:-2], p) for x in rows for p in range(*x[-2:])] for rows in got[1:]]
    assert sorted(got[0]) == sorted(wanted[0])
    assert [sorted(x) for x in bases] == [sorted(x) for x in wanted[1:]]


def stages(spark):
    """Shuffled rows of all stages so far."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}


# rows that a run may shuffle for each row of lineitem, orders and part (five contigs): they take 8 and 6, and took 52 and 19 with copies of all rows for all names
SHUFFLED = {"run_cooccurrence": 16, "run_annotation_centered": 11}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SHUFFLED)
def test_runs_shuffle_no_copies_for_names_and_leave_no_files(spark, name):
    files = lambda: set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/axisloom-*/run-*.npy"))
    before, there = stages(spark), files()
    plans.QUERIES[name](spark, SF).collect()
    shuffled = sum(n for k, n in stages(spark).items() if k not in before)
    given = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() * times for t, times in (("lineitem", 1), ("orders", 1), ("part", 5)))
    assert 0 < shuffled <= SHUFFLED[name] * given
    assert files() <= there
