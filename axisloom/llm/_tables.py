"""Reading the input tables and keeping intermediate ones where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: str = "2m") -> None:
    """Keep batches between the JVM and Python small, as both sides hold some of each task's at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all is local (tests), one of our own is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.axisloom.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="axisloom-")
        spark.conf.set("spark.axisloom.dir", path)
    return path


_made: list[str] = []  # folders in the shared folder that this process has named and not deleted


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/axisloom-{uuid.uuid4().hex}/{tag}"
    _made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder named by new_path()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p.getParent(), True)
    if path in _made:
        _made.remove(path)


class Made:
    """What is stored inside the block; delete() removes it all but the tables named."""

    def __enter__(self) -> Made:
        self.before = set(_made)
        return self

    def __exit__(self, *_) -> None:
        self.paths = [p for p in _made if p not in self.before]

    def delete(self, spark: SparkSession, *keep: DataFrame) -> None:
        kept = {getattr(t, "_axisloom_path", None) for t in keep}
        for path in self.paths:
            if path not in kept and path in _made:
                delete(spark, path)


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that survive executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._axisloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by stored(); only for tables nothing will read again."""
    path = getattr(df, "_axisloom_path", None)
    if path:
        delete(df.sparkSession, path)


class Scratch:
    """Stores tables that are deleted when the block that they are made in ends."""

    def __enter__(self) -> Scratch:
        self.tables: list[DataFrame] = []
        return self

    def __call__(self, df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
        return self.add(stored(df, tag, compression))

    def add(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def __exit__(self, *_) -> None:
        for t in self.tables:
            drop(t)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so extra columns with any name are never in the way."""
    return df.select(*[df[n] for n in names])


_SLOTS, _MAP = 1 << 25, 1 << 15


def maybe_in(df: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """df and `maybe`: false where df[name] is certainly not among the ids (a column of the same name).

    The ids are hashed into a bitmap of 2**25 bits, at most 1024 rows of 4 KB, which is what bounds
    the broadcast. With many more ids nearly all is "maybe", so an exact join must follow; this only
    keeps rows with wide texts from being shuffled for it.
    """

    def slot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(_SLOTS))

    slots = ids.select(slot(ids[name]).alias("s"))
    maps = slots.groupBy(F.expr(f"s div {_MAP}").alias("map_no")).agg(F.expr(f"bitmap_construct_agg(s % {_MAP})").alias("map_bits"))
    at = slot(df[name])
    rows = df.withColumn("map_at", at % _MAP).withColumn("map_no", F.floor(at / _MAP))
    byte = F.conv(F.hex(F.expr("substring(map_bits, cast(map_at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, (F.col("map_at") % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(maps), "map_no", "left").withColumn("maybe", hit).drop("map_no", "map_at", "map_bits")
