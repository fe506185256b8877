"""Lines of text files in their order, from splits of any size.

Spark reads a file's splits in many tasks, and each split's lines in order. So a line's place is the start
of its split and a number that grows within the task. What holds for the lines after it (a track line,
say) is filled forward inside splits, batch by batch and without a shuffle, and carried from split to split by one row each.

Any store that Spark reads will do. Compressed files are one split each; those ending in .z, which Spark doesn't
take for gzip, are read whole.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("path", "block", "n")  # the order of lines, as columns


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            text = gzip.decompress(content).decode().split("\n")
            text = text[:-1] if text[-1] == "" else text
            yield pa.RecordBatch.from_pydict({"path": [path] * len(text), "block": pa.array([0] * len(text), pa.int64()), "n": pa.array(range(len(text)), pa.int64()), "value": pa.array(text, pa.string())})


def read(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, block, n, value: every line; (path, block, n) is its place."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.z").load(paths).select("path", "content")
    whole = packed.mapInArrow(_unpacked, "path string, block long, n long, value string")
    plain = text.filter(~F.col("path").endswith(".z"))
    return plain.unionByName(whole).withColumn("value", F.regexp_replace("value", "\r$", ""))


def table(spark: SparkSession, path: str, header: bool = True, sep: str = "\t") -> DataFrame:
    """A table of separated columns as strings, with a column `_place`, by which its lines are ordered."""
    rows = spark.read.csv(path, sep=sep, header=header, comment="#", inferSchema=False)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return rows.select("*", place.alias("_place"))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Markers filled forward within a split; a task may hold several, one after another."""
    last, at = None, None
    for b in batches:
        if not b.num_rows:
            continue
        path, block = b.column("path").dictionary_encode(), b.column("block")
        new = pc.or_(pc.not_equal(path.indices[1:], path.indices[:-1]), pc.not_equal(block[1:], block[:-1])) if b.num_rows > 1 else pa.array([], pa.bool_())
        cuts = [0, *[i + 1 for i in pc.indices_nonzero(new).to_pylist()], b.num_rows]
        parts = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = (path[lo].as_py(), block[lo].as_py())
            last = last if now == at else None
            at = now
            marks = pc.fill_null_forward(b.column("_mark").slice(lo, hi - lo))
            marks = pc.fill_null(marks, pa.scalar(last, pa.string())) if last is not None else marks
            last = marks[-1].as_py()
            parts.append(marks)
        yield b.set_column(b.schema.get_field_index("_mark"), "_mark", pa.concat_arrays(parts))


def held(lines: DataFrame, mark: Column, name: str) -> DataFrame:
    """Lines with `name`: the mark (a string) of the last line, at or before each in its file, whose mark isn't null.

    `lines` is what read() gives, its rows neither moved nor sorted.
    """
    marked = lines.withColumn("_mark", mark)
    # a row per split that has a mark; and, for the splits after it, the last mark before them
    ends = marked.groupBy("path", "block").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("n"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("path", "block", before.alias("_carried")).filter("_carried is not null")
    filled = marked.mapInArrow(_filled, marked.schema)
    return filled.join(carried, ["path", "block"], "left").withColumn(name, F.coalesce("_mark", "_carried")).drop("_mark", "_carried")
