"""Synonyms against a plain union, samples of the older format, metrics of steps, two-sided p."""

import os

import numpy as np
import pytest

from axisloom import storage
from axisloom.functions import statistics
from axisloom.operators import id_sets, names
from axisloom.plans.metrics import Metrics
from axisloom.sources import bed, tables

PAIRS = "name string, synonym string"
SPACE = "track string, contig string, start long, end long"


def _plain(pairs):
    group = {}
    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        both = group.get(a, {a}) | group.get(b, {b})
        for x in both:
            group[x] = both
    return {x: min(g) for x, g in group.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_plain_unions(spark, seed):
    draw = np.random.default_rng(seed)
    chain = [(f"c{k}", f"c{k + 1}") for k in draw.permutation(60)]
    pairs = [(f"n{a}", f"n{b}") for a, b in draw.integers(0, 80, (60, 2))] + chain + chain[:5] + [(b, a) for a, b in chain[5:9]] + [("x", "x"), (None, "n1"), ("n2", None)]
    got = {r.name: r.least for r in names.classes(spark.createDataFrame(pairs, PAIRS)).collect()}
    assert got == _plain(pairs)


def test_no_pairs_and_names_without_any(spark):
    none = names.classes(spark.createDataFrame([], PAIRS))
    assert none.count() == 0
    df = spark.createDataFrame([("a", "b"), (None, "c")], "id string, least string")
    assert sorted(map(tuple, names.renamed(df, none, "id").collect()), key=repr) == [("a", "b"), (None, "c")]
    found = names.classes(spark.createDataFrame([("b", "a")], PAIRS))
    # columns may have any name, also that of the classes' own
    assert sorted(map(tuple, names.renamed(df, found, "id", "least").collect()), key=repr) == [("a", "a"), (None, "c")]


def test_sets_that_differ_by_synonyms_become_alike(spark):
    sets = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", "z"), ("r", "x"), ("r", "y")], "annotation string, id string")
    ids = spark.createDataFrame([("x", "c", 0, 5), ("y", "c", 200, 210), ("z", "c", 7, 9)], "id string, contig string, start long, end long")
    space = spark.createDataFrame([("w", "c", 0, 100)], SPACE)
    sets, ids = id_sets.one_name(sets, ids, spark.createDataFrame([("y", "x")], PAIRS))
    got = {r.annotation: tuple(r)[1:] for r in id_sets.report(sets, ids, space).collect()}
    assert got == {"p": (1, 0, 0, 1, None, True), "q": (1, 0, 0, 1, "p", False), "r": (2, 0, 0, 2, None, True)}


def test_deleted_tables_leave_others(spark):
    a, b = storage.kept(spark.range(3)), storage.kept(spark.range(4))
    storage.delete(a)
    storage.delete(a)
    assert not os.path.exists(a._axisloom_path.removeprefix("file:")) and b.count() == 4


def test_iterations_in_small_splits(spark, tmp_path):
    text, want = "##Segments\tc\t(1,2)\n", [(None, "c", 1, 2)]
    for k in range(40):
        text += f"##Iteration\t{k}\n"
        for c in "cd":
            spans = [(k * 10 + j * 3, k * 10 + j * 3 + 2) for j in range(k % 4)]
            want += [(k, c, *s) for s in spans]
            text += "\t".join(["##Segments", c, *(f"({s}, {e})" for s, e in spans)]) + "\n"
    (tmp_path / "one.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = [tuple(r)[1:] for r in bed.load_iterations(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_metrics_of_a_written_table(spark):
    m = Metrics()
    with m.timed("both"):
        storage.kept(m.watch(spark.createDataFrame([("t", "c", 3, 9), ("t", "c", 0, 1)], SPACE), "some"))
        storage.kept(m.watch(spark.createDataFrame([], SPACE), "none"))
    got = {(r.step, r.metric): r.value for r in m.table(spark).collect()}
    assert got.pop(("both", "seconds")) > 0
    assert got == {("some", "rows"): 2, ("some", "bases"): 7, ("none", "rows"): 0, ("none", "bases"): 0}


def test_wanted_sections(spark):
    sections = dict.fromkeys(["segments", "annotations", "work"])
    for patterns, found in ((["all"], sections), (["^seg", "k$"], ["segments", "work"]), ([], []), (["nothing"], [])):
        assert list(tables.wanted(sections, patterns)) == list(found)


def test_two_sided_p_against_sorted_samples(spark):
    draw = np.random.default_rng(5)
    values = {f"a{k}": sorted(draw.integers(0, 8, 11).astype(float).tolist()) for k in range(30)}
    seen = {k: float(draw.integers(-1, 10)) for k in values}
    pair = "counter string, track string, annotation string"
    s = spark.createDataFrame([("c", "t", k, i, v) for k, all_ in values.items() for i, v in enumerate(all_)], f"{pair}, sample_id int, value double")
    o = spark.createDataFrame([("c", "t", k, v) for k, v in seen.items()], f"{pair}, observed double")
    for r in statistics.two_sided_p(o, s).collect():
        x, v, n = values[r.annotation], seen[r.annotation], 11
        lt, le = sum(y < v for y in x), sum(y <= v for y in x)
        if lt == n:
            p = 0
        elif lt > n / 2:
            p = 1 - (lt - 1 if v in x else lt) / n
        else:
            p = le / n
        assert np.isclose(r.pvalue, max(1 / n, p))
