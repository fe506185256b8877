"""Reading and writing of the tab-separated tables around an analysis, and of small map and list files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines
from ..operators import algebra, collections

RESULT_COLUMNS = ("track", "annotation", "observed", "expected", "CI95low", "CI95high", "stddev", "fold", "l2fold", "pvalue", "qvalue")
EXTENDED_COLUMNS = ("track_nsegments", "track_size", "track_density", "annotation_nsegments", "annotation_size", "annotation_density", "overlap_nsegments", "overlap_size", "overlap_density", "percent_overlap_nsegments_track", "percent_overlap_size_track", "percent_overlap_nsegments_annotation", "percent_overlap_size_annotation")


def read_tabular(spark: SparkSession, path: str, header: bool = True, sep: str = "\t") -> DataFrame:
    """A table as strings; lines that begin with # are comments."""
    return spark.read.csv(path, sep=sep, header=header, comment="#", inferSchema=False)


def write_counts(observed: DataFrame, sampled: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per counter: track, annotation, observed, counts (comma-joined by sample_id)."""
    keys = ["counter", "track", "annotation"]
    values = sampled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample_id", "value"))).alias("v"))
    text = F.concat_ws(",", F.transform("v", lambda x: x["value"].cast("string")))
    out = observed.join(values, keys, "left").select("counter", "track", "annotation", F.col("observed").cast("string"), text.alias("counts"))
    out.write.mode(mode).partitionBy("counter").csv(path, sep="\t", header=True)


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(observed, sampled) of a counts table; its counter is `na` unless the folder names it."""
    table = read_tabular(spark, path)
    names = [c for c in table.columns if c != "counter"]
    if names != ["track", "annotation", "observed", "counts"]:
        raise ValueError(f"a counts table has other columns: {names}")
    table = table.withColumn("counter", F.col("counter") if "counter" in table.columns else F.lit("na"))
    observed = table.select("counter", "track", "annotation", F.col("observed").cast("double").alias("observed"))
    sampled = table.select("counter", "track", "annotation", F.posexplode(F.split("counts", ",")).alias("sample_id", "v"))
    return observed, sampled.select("counter", "track", "annotation", "sample_id", F.col("v").cast("double").alias("value"))


def _formatted(pattern: str, value: Column) -> Column:
    return F.format_string(pattern, value)


def formatted(results: DataFrame) -> DataFrame:
    """Result rows as they are written: fixed formats, `-inf` for the log of no fold and `na` for no ratio."""
    f = lambda name: _formatted("%6.4f", F.col(name))
    e = lambda name: _formatted("%6.4e", F.col(name))
    whole = lambda name: F.col(name).cast("long").cast("string")
    observed = F.when(F.col("observed") == F.floor("observed"), whole("observed")).otherwise(f("observed"))
    log = F.when(F.col("fold") > 0, f("l2fold")).otherwise(F.lit("-inf"))
    cols = {"track": F.col("track"), "annotation": F.col("annotation"), "observed": observed, "expected": f("expected"), "CI95low": f("ci95low"), "CI95high": f("ci95high"), "stddev": f("stddev"), "fold": f("fold"), "l2fold": log, "pvalue": e("pvalue"), "qvalue": e("qvalue")}
    for name in EXTENDED_COLUMNS:
        if name in results.columns:
            way = e if name.endswith("density") else f if name.startswith("percent") else whole
            cols[name] = F.coalesce(way(name), F.lit("na"))
    more = [c for c in results.columns if c.startswith("description")]
    return results.select("counter", *[c.alias(n) for n, c in cols.items()], *more)


ORDERS = ("track", "annotation", "fold", "pvalue", "qvalue", "observed")


def ordered(results: DataFrame, by: str = "fold", limit: int | None = None) -> DataFrame:
    if by not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    out = results.orderBy(by, "track", "annotation")
    return out if limit is None else out.limit(limit)


def write_results(results: DataFrame, path: str, by: str = "fold", descriptions: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """One folder per counter with the ordered, formatted rows; described annotations get their description columns."""
    rows = results if descriptions is None else described(results, descriptions)
    out = formatted(ordered(rows, by)) if by else formatted(rows)
    out.coalesce(1).write.mode(mode).partitionBy("counter").csv(path, sep="\t", header=True)


def wanted(sections: dict[str, DataFrame], patterns: list[str]) -> dict[str, DataFrame]:
    """Of named tables those to be written: all where a pattern is `all`, else those whose name one is or is found in."""
    return {name: df for name, df in sections.items() if any(p in ("all", name) or re.search(p, name) for p in patterns)}


def write_sections(sections: dict[str, DataFrame], patterns: list[str], path: str, mode: str = "errorifexists") -> list[str]:
    """Each wanted table as tab-separated files in a folder of its name; the names written."""
    chosen = wanted(sections, patterns)
    for name, df in chosen.items():
        df.write.mode(mode).csv(f"{path}/{name}", sep="\t", header=True)
    return list(chosen)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table of 11 or 24 columns; `na` reads as null."""
    table = read_tabular(spark, path)
    names = [c for c in table.columns if c != "counter"]
    if names[:11] != list(RESULT_COLUMNS):
        raise ValueError(f"a result table has other columns: {names}")
    number = lambda c: F.when(F.col(c) == "-inf", F.lit(float("-inf"))).otherwise(F.col(c).try_cast("double"))
    numbers = [number(c).alias(c.lower() if c.startswith("CI") else c) for c in names[2:] if c in RESULT_COLUMNS + EXTENDED_COLUMNS]
    counter = F.col("counter") if "counter" in table.columns else F.lit("na")
    return table.select(counter.alias("counter"), "track", "annotation", *numbers)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """annotation and its description columns; rows of another width are an error."""
    found = lines.read(spark, path).filter("value <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    widths = found.agg(F.min(F.size("f")), F.max(F.size("f"))).first()
    if widths[0] != widths[1]:
        raise ValueError("rows of the description table differ in width")
    table = read_tabular(spark, path)
    first, *rest = table.columns
    return table.select(F.col(first).alias("annotation"), *[F.col(c).alias(f"description_{c}") for c in rest])


def described(results: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Results with description columns, empty where there is no description."""
    return results.join(descriptions, "annotation", "left").fillna("", [c for c in descriptions.columns if c != "annotation"])


def read_map(spark: SparkSession, path: str, key: int = 0, value: int = 1, header: bool = False, both_directions: bool = False) -> DataFrame:
    """key, value of a one-to-one map file; the last line of a key holds."""
    rows = lines.table(spark, path, header)
    k, v = rows.columns[key], rows.columns[value]
    out = rows.groupBy(F.col(k).alias("key")).agg(F.max_by(v, "_place").alias("value"))
    if not both_directions:
        return out
    return out.unionByName(rows.groupBy(F.col(v).alias("key")).agg(F.max_by(k, "_place").alias("value")))


def read_multimap(spark: SparkSession, path: str, key: int = 0, value: int = 1, header: bool = False) -> DataFrame:
    """key, value of an n-to-n map file."""
    table = read_tabular(spark, path, header)
    return table.select(F.col(table.columns[key]).alias("key"), F.col(table.columns[value]).alias("value"))


def read_list(spark: SparkSession, path: str, column: int = 0, header: bool = False) -> DataFrame:
    table = read_tabular(spark, path, header)
    return table.select(F.col(table.columns[column]).alias("value"))


def read_matrix(spark: SparkSession, path: str, lowest: float | None = None, highest: float | None = None) -> DataFrame:
    """Numeric table; rows whose first column lies outside the range are added to those at its ends."""
    table = read_tabular(spark, path)
    numbers = table.select(*[F.col(c).try_cast("double").alias(c) for c in table.columns])
    if lowest is None and highest is None:
        return numbers
    first, *rest = numbers.columns
    at = F.col(first)
    at = F.greatest(at, F.lit(lowest)) if lowest is not None else at
    at = F.least(at, F.lit(highest)) if highest is not None else at
    return numbers.groupBy(at.alias(first)).agg(*[F.sum(c).alias(c) for c in rest])


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence of FASTA files with one record each."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split("value", "\n")
    return whole.select(F.regexp_extract("value", "^>([^\n]*)", 1).alias("name"), F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x)), "").alias("sequence"))


def from_gff(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of GFF or GTF: feature as track, 1-based closed ranges made half-open."""
    t = read_tabular(spark, path, header=False)
    c = t.columns
    return t.select(F.col(c[2]).alias("track"), F.col(c[0]).alias("contig"), (F.col(c[3]).cast("long") - 1).alias("start"), F.col(c[4]).cast("long").alias("end"))


def read_predecessor(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The ##Work, ##Segs, ##Ann, ##Id, ##Synonym and ##Subset lines of the older text format.

    work and segments: contig, start, end and the place of their line; workspace: what all ##Work lines of a
    contig have in common; annotations: id list per name; ids: segments per id.
    """
    found = lines.read(spark, path).withColumn("n", F.struct(*lines.PLACE))
    f = found.select(F.split("value", "\t").alias("f"), "n").select(F.get("f", F.lit(0)).alias("kind"), F.get("f", F.lit(1)).alias("name"), F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0))).alias("rest"), "n")
    pair = lambda s, k: F.regexp_extract(s, r"\((\d+),\s*(\d+)\)", k).cast("long")

    def spans(kind: str, *names: str) -> DataFrame:
        s = f.filter(F.col("kind") == kind).select("name", "n", F.explode(F.flatten(F.transform("rest", lambda x: F.regexp_extract_all(x, F.lit(r"(\(\d+,\s*\d+\))"), 1)))).alias("s"))
        return s.select(F.col("name").alias(names[0]), F.col("n").alias("line"), pair("s", 1).alias("start"), pair("s", 2).alias("end"))

    ids = f.filter("kind = '##Id'").select(F.col("name").alias("id"), F.get("rest", F.lit(0)).alias("contig"), F.explode(F.flatten(F.transform("rest", lambda x: F.regexp_extract_all(x, F.lit(r"(\(\d+,\s*\d+\))"), 1)))).alias("s"))
    work = spans("##Work", "contig")
    # each line's intervals are one set; a base stays if it lies in as many sets as the contig has lines
    sets = algebra.merge(work.withColumn("track", F.to_json("line")).select("track", "contig", "start", "end"), 0)
    needed = work.groupBy("contig").agg(F.count_distinct("line").alias("depth"))
    return {
        "work": work,
        "workspace": collections.common(sets, needed),
        "segments": spans("##Segs", "contig"),
        "ids": ids.select("id", "contig", pair("s", 1).alias("start"), pair("s", 2).alias("end")),
        "annotations": f.filter("kind = '##Ann'").select(F.col("name").alias("annotation"), F.explode("rest").alias("id")),
        "synonyms": f.filter("kind = '##Synonym'").select("name", F.explode("rest").alias("synonym")),
        "subsets": f.filter("kind = '##Subset'").select(F.col("name").alias("subset"), F.explode("rest").alias("id")),
    }
