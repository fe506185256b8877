"""Readers and writers: round trips and rules of names."""

import gzip

import pytest

from axisloom.functions import statistics
from axisloom.sources import bed, tables


def test_bed_names(spark, tmp_path):
    (tmp_path / "a.bed").write_text('# x\n\ntrack name="one two" color=1\nc1\t1\t5\tother\nc1\t7\t9')
    (tmp_path / "b.bed").write_text("c1\t1\t5\tnamed\n")
    with gzip.open(tmp_path / "c.bed.gz", "wt") as f:
        f.write("c2\t3\t8\n")
    got = sorted((r.track, r.contig, r.start, r.end) for r in bed.load(spark, str(tmp_path / "*.bed*")).collect())
    assert got == [("c", "c2", 3, 8), ("named", "c1", 1, 5), ("one two", "c1", 1, 5), ("one two", "c1", 7, 9)]
    assert {r.track for r in bed.load(spark, str(tmp_path / "*.bed*"), ignore_tracks=True).collect()} == {"merged"}
    assert {r.track for r in bed.load(spark, str(tmp_path / "b.bed"), track_lines=False).collect()} == {"named"}


def test_duplicate_track_is_an_error(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.bed").write_text("c\t1\t2\tsame\n")
    with pytest.raises(ValueError, match="several files"):
        bed.load(spark, str(tmp_path))
    assert bed.load(spark, str(tmp_path), allow_multiple=True).count() == 2


def test_bed_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("t", "c", 5, 9), ("t", "c", 1, 3), ("u", "c", 0, 4)], "track string, contig string, start long, end long")
    bed.save(d, str(tmp_path / "out"), prefix="p_", color="1")
    got = sorted(tuple(r) for r in bed.load(spark, [str(p) for p in (tmp_path / "out").glob("track=*")]).select("track", "contig", "start", "end").collect())
    assert got == [("p_t", "c", 1, 3), ("p_t", "c", 5, 9), ("p_u", "c", 0, 4)]


def test_counts_and_results_round_trip(spark, tmp_path):
    o = spark.createDataFrame([("k", "t", "a", 5.0), ("k", "t", "b", 0.0)], "counter string, track string, annotation string, observed double")
    s = spark.createDataFrame([("k", "t", x, i, float(i)) for x in "ab" for i in range(12)], "counter string, track string, annotation string, sample_id int, value double")
    tables.write_counts(o, s, str(tmp_path / "counts"))
    o2, s2 = tables.read_counts(spark, str(tmp_path / "counts"))
    assert sorted(map(tuple, s2.select("annotation", "sample_id", "value").collect())) == sorted(map(tuple, s.select("annotation", "sample_id", "value").collect()))
    r = statistics.q_values(statistics.enrichment(o2, s2), "BH")
    notes = spark.createDataFrame([("a", "first")], "annotation string, description_text string")
    tables.write_results(r, str(tmp_path / "results"), "pvalue", notes)
    back = {x.annotation: x for x in tables.read_results(spark, str(tmp_path / "results")).collect()}
    assert back["a"].observed == 5 and back["b"].fold == pytest.approx(1 / 6.5, abs=1e-4)


def test_small_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("#c\nk1\tv1\nk1\tv2\nk2\tv3\n")
    assert {(r.key, r.value) for r in tables.read_map(spark, str(tmp_path / "m.tsv")).collect()} == {("k1", "v2"), ("k2", "v3")}
    assert tables.read_multimap(spark, str(tmp_path / "m.tsv")).count() == 3
    (tmp_path / "x.tsv").write_text("x\ty\n1\t2\n5\t3\n9\t4\n")
    assert sorted(map(tuple, tables.read_matrix(spark, str(tmp_path / "x.tsv"), 2, 6).collect())) == [(2.0, 2.0), (5.0, 3.0), (6.0, 4.0)]
    (tmp_path / "s.fa").write_text(">seq\nACG\nT\n")
    assert tuple(tables.read_sequence(spark, str(tmp_path / "s.fa")).first()) == ("seq", "ACGT")
    (tmp_path / "d.tsv").write_text("id\ttext\na\tx\nb\n")
    with pytest.raises(ValueError, match="width"):
        tables.read_descriptions(spark, str(tmp_path / "d.tsv"))
    (tmp_path / "p.txt").write_text("##Work\tc1\t(0,100)\t(200,300)\n##Id\ti1\tc1\t(5,10)\n##Ann\tname\ti1\ti2\n")
    got = tables.read_predecessor(spark, str(tmp_path / "p.txt"))
    assert got["work"].count() == 2 and got["annotations"].count() == 2 and got["ids"].first().start == 5


def split_small(spark):
    """Files in splits of some hundred bytes, many tasks each."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    split_small(spark)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_track_lines_hold_across_splits(spark, tmp_path, small_splits):
    want = []
    for f in ("a", "b"):
        text, name = "browser x\n", None
        for i in range(600):
            if i in (40, 41, 300, 590):
                name = None if i == 300 else f"{f}{i}"
                text += "track color=1\n" if i == 300 else f'track name="{name}"\n'
            text += f"c{i % 3}\t{i}\t{i + 5}\n" + ("# note\n\n" if i % 50 == 0 else "")
            want.append((name, f"c{i % 3}", i, i + 5))
        (tmp_path / f"{f}.bed").write_text(text)
    found = bed.rows(spark, str(tmp_path / "*.bed"))
    assert found.rdd.getNumPartitions() > 10
    assert sorted(map(repr, want)) == sorted(repr((r.track_line, r.contig, r.start, r.end)) for r in found.collect())


def test_packed_files_in_all_readers(spark, tmp_path):
    for name in ("x.bed.gz", "y.bed.z"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("track name=t" + name[0] + "\r\nc1\t1\t5\r\n")
    got = sorted((r.track, r.start) for r in bed.load(spark, str(tmp_path)).collect())
    assert got == [("tx", 1), ("ty", 1)]
    with gzip.open(tmp_path / "z.bed.z", "wt") as f:
        f.write("c1\t2\t6\tn\n")
    assert [(r.name, r.end) for r in bed.split_rows(spark, str(tmp_path / "z.bed.z")).collect()] == [("n", 6)]
    assert [r.end for r in bed.spaced_rows(spark, str(tmp_path / "z.bed.z")).collect()] == [6]


def test_broken_rows_are_errors(spark, tmp_path):
    (tmp_path / "x.bed").write_text("c1\t1\n")
    with pytest.raises(Exception, match="not a BED row"):
        bed.rows(spark, str(tmp_path / "x.bed")).collect()


def test_last_line_of_a_key_across_splits(spark, tmp_path, small_splits):
    (tmp_path / "m.tsv").write_text("".join(f"k{i % 7}\tv{i}\n" for i in range(500)))
    assert {r.key: r.value for r in tables.read_map(spark, str(tmp_path / "m.tsv")).collect()} == {f"k{i % 7}": f"v{i}" for i in range(493, 500)}


def test_repeated_workspace_lines_are_intersected(spark, tmp_path):
    (tmp_path / "p.txt").write_text("##Work\tc1\t(0,100)\t(200,300)\n##Work\tc1\t(50,250)\t(240,260)\n##Work\tc2\t(0,9)\n")
    got = sorted(tuple(r) for r in tables.read_predecessor(spark, str(tmp_path / "p.txt"))["workspace"].select("contig", "start", "end").collect())
    assert got == [("c1", 50, 100), ("c1", 200, 260), ("c2", 0, 9)]
