"""Tables that an analysis reads several times, kept where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all is local (tests), one of our own is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.axisloom.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="axisloom-")
        spark.conf.set("spark.axisloom.dir", path)
    return path


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/axisloom-{uuid.uuid4().hex}"


_made: list[str] = []  # what this process has written and not deleted


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, tidy: bool = False) -> DataFrame:
    """df, computed once and read back from files: plans stay short, and lost executors lose nothing.

    tidy: what it has shuffled is deleted as soon as it is written, and not when the driver happens to collect its garbage.
    """
    if is_kept(df):
        return df
    spark = df.sparkSession
    path = new_path(spark)
    _made.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._axisloom_path = path
    return out


def is_kept(df: DataFrame) -> bool:
    """Whether df is a table that kept() gave, as it is."""
    return getattr(df, "_axisloom_path", None) is not None


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def delete(df: DataFrame) -> None:
    """Delete a table that kept() gave, once nothing reads it any more."""
    if is_kept(df) and df._axisloom_path in _made:
        _made.remove(df._axisloom_path)
        _remove(df.sparkSession, df._axisloom_path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of new_path(), once nothing reads it any more."""
    _remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process has kept; results that were not yet read can't be read after that."""
    for path in _made:
        _remove(spark, path)
    _made.clear()
