"""Reading and writing BED text, compressed or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lines

MERGED = "merged"


def track_attributes(line: Column) -> Column:
    """The key=value and key="quoted value" pairs of a track line, as a map."""
    keys = F.regexp_extract_all(line, F.lit(r'([A-Za-z_]\w*)=(?:"[^"]*"|\S+)'), 1)
    values = F.regexp_extract_all(line, F.lit(r'[A-Za-z_]\w*=("[^"]*"|\S+)'), 1)
    return F.map_from_arrays(keys, F.transform(values, lambda v: F.regexp_replace(v, '^"|"$', "")))


def _fields(lines: DataFrame, *more: str) -> DataFrame:
    """contig, start, end, name, score of BED lines, and columns that stay."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    number = lambda i: F.coalesce(F.trim(at(i)).try_cast("long"), F.raise_error(F.concat(F.lit("not a BED row: "), F.col("value"))).cast("long"))
    return lines.select(*more, at(0).alias("contig"), number(1).alias("start"), number(2).alias("end"), at(3).alias("name"), at(4).alias("score"))


def rows(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All rows of BED files: path, track_line, contig, start, end, name, score.

    Track lines hold for the rows below them in their file, in whatever task those are read.
    """
    is_track = F.startswith("value", F.lit("track"))
    # a track line without a name holds too, until the next
    name = F.when(is_track, F.coalesce(track_attributes(F.col("value"))["name"], F.lit("")))
    found = lines.held(lines.read(spark, paths), name, "track_line")
    kept = found.filter("trim(value) <> '' and not startswith(value, '#') and not startswith(value, 'browser')").filter(~is_track)
    return _fields(kept, "path", F.nullif("track_line", F.lit("")).alias("track_line"))


def split_rows(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The same for files without track lines, without Python."""
    found = lines.read(spark, paths).filter("value <> '' and not startswith(value, '#') and not startswith(value, 'browser')")
    return _fields(found, "path", F.lit(None).cast("string").alias("track_line"))


def spaced_rows(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows of older files whose fields any white space may part: path, contig, start, end and `fields`, those after them."""
    found = lines.read(spark, paths).select("path", F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#') and not startswith(value, 'track')")
    f = F.split("value", r"\s+")
    number = lambda i: F.coalesce(F.get(f, F.lit(i)).try_cast("long"), F.raise_error(F.concat(F.lit("not a BED row: "), F.col("value"))).cast("long"))
    return found.select("path", F.get(f, F.lit(0)).alias("contig"), number(1).alias("start"), number(2).alias("end"), F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0))).alias("fields"))


def base_name(path: Column) -> Column:
    """A path's last part without its extensions."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"(\.bed)?(\.gz|\.z)?$", "")


def load(spark: SparkSession, paths: list[str] | str, ignore_tracks: bool = False, allow_multiple: bool = False, track_lines: bool = True, regex: str | None = None) -> DataFrame:
    """Intervals of BED files by track.

    A row's track is `merged` with ignore_tracks; else what regex's first group finds in the path, if
    given; else the name of its track line, its fourth column, or its file's name. A track in several
    files is an error unless allowed.
    """
    found = rows(spark, paths) if track_lines else split_rows(spark, paths)
    name = F.coalesce("track_line", "name", base_name(F.col("path")))
    track = F.lit(MERGED) if ignore_tracks else F.regexp_extract("path", regex, 1) if regex else name
    out = found.select(track.alias("track"), "contig", "start", "end", "path")
    if not (allow_multiple or ignore_tracks):
        several = out.groupBy("track").agg(F.count_distinct("path").alias("n")).filter("n > 1").take(1)
        if several:
            raise ValueError(f"track {several[0].track} is in several files")
    return out.drop("path")


def load_samples(spark: SparkSession, paths: list[str] | str, regex: str = r"([^/]+)\.samples\.bed") -> DataFrame:
    """Samples written by save_samples: the track from the path, the sample's number from track lines."""
    found = rows(spark, paths)
    return found.select(F.regexp_extract("path", regex, 1).alias("track"), F.col("track_line").cast("int").alias("sample_id"), "contig", "start", "end")


def save(df: DataFrame, path: str, prefix: str = "", mode: str = "errorifexists", **attributes: str) -> None:
    """One folder per track, with a track line named prefix + track and the attributes."""
    more = "".join(f" {k}={v}" for k, v in attributes.items())
    ordered = df.select("track", F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"), "contig", "start", "end", F.lit(1).alias("kind"))
    heads = df.select("track").distinct().select("track", F.concat(F.lit(f'track name="{prefix}'), F.col("track"), F.lit(f'"{more}')).alias("value"), F.lit("").alias("contig"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), F.lit(0).alias("kind"))
    rows_ = heads.unionByName(ordered).repartition("track").sortWithinPartitions("track", "kind", "contig", "start", "end")
    rows_.select("track", "value").write.mode(mode).partitionBy("track").text(path)


def save_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples as a table of files by track, which read_samples() reads again."""
    samples.write.mode(mode).partitionBy("track").parquet(path)


def save_samples_bed(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples as BED text: a folder per track, in its files a track line per sample, named by its number."""
    cells = [F.col(c).cast("string") for c in ("contig", "start", "end")]
    lines = samples.select("track", "sample_id", F.lit(1).alias("kind"), "contig", "start", "end", F.concat_ws("\t", *cells).alias("value"))
    none = F.lit(None).cast("long")
    heads = samples.select("track", "sample_id").distinct().select("track", "sample_id", F.lit(0).alias("kind"), F.lit("").alias("contig"), none.alias("start"), none.alias("end"), F.concat(F.lit("track name="), F.col("sample_id").cast("string")).alias("value"))
    # a sample of a track is one task's, so its rows stand under its line
    rows_ = heads.unionByName(lines).repartition("track", "sample_id").sortWithinPartitions("track", "sample_id", "kind", "contig", "start", "end")
    rows_.select("track", "value").write.mode(mode).partitionBy("track").text(path)


def load_iterations(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, sample_id, contig, start, end of samples in the older text format.

    An `##Iteration` line begins a sample, the first of a file being 0; a `##Segments` line holds a contig
    and its intervals as (start,end). What stands before the first sample has no sample_id.
    """
    found = lines.read(spark, paths).withColumn("_new", F.col("value").startswith("##Iteration").cast("int"))
    # numbers run within a split, and go on from the sum of the splits before it
    own = F.sum("_new").over(W.partitionBy("path", "block").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.sum("_sum").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    splits = found.groupBy("path", "block").agg(F.sum("_new").alias("_sum")).select("path", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = found.withColumn("_own", own).filter(F.col("value").startswith("##Segments")).join(splits, ["path", "block"])
    number = (F.col("_own") + F.col("_before") - 1).cast("int")
    # what a row of the result needs of its line is taken from it once, before there are many rows of it
    each = numbered.select("path", F.when(number >= 0, number).alias("sample_id"), F.regexp_extract("value", r"^##Segments\t([^\t]*)", 1).alias("contig"), F.regexp_extract_all("value", F.lit(r"(\(\d+,\s*\d+\))"), 1).alias("_all"))
    rows_ = each.select("path", "sample_id", "contig", F.explode("_all").alias("_x"))
    cell = lambda k: F.regexp_extract("_x", r"\((\d+),\s*(\d+)\)", k).cast("long")
    return rows_.select("path", "sample_id", "contig", cell(1).alias("start"), cell(2).alias("end"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
