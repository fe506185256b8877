"""Intervals as sorted arrays in files of the shared folder, which sampling tasks map into memory.

A table is sorted once by ranges of (axis, set, start), so an axis may span several partitions. Each
partition writes a file of starts, ends and bases before each interval for every set (run) that it holds,
and a small directory per axis lists the runs of its sets. Whatever samples or counts on an axis maps
the files it needs: nothing is copied through a shuffle again, however many samples and tracks there are.
A file of a store that is not mounted is read into the task's memory; none is copied to local disks.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.placement import Held, Rows, Sorted
from ..storage import delete, delete_folder, kept, new_path


HELD = 1 << 20  # intervals of a set that a task may hold; of more it reads stretches


def strata(df: DataFrame) -> DataFrame:
    """df with an isochore column, empty where there is none."""
    return df.withColumn("isochore", F.coalesce("isochore", F.lit("")) if "isochore" in df.columns else F.lit(""))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's name, as Spark itself resolves it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()


def _local(base: str) -> str | None:
    return "/" + base[5:].lstrip("/") if base.startswith("file:") else None


def _write(base: str, name: str, body: bytes) -> None:
    fs, root = (pafs.LocalFileSystem(), path) if (path := _local(base)) else pafs.FileSystem.from_uri(base)
    fs.create_dir(root, recursive=True)
    part = f"{root}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(body)
    fs.move(part, f"{root}/{name}")  # a task that runs again writes the same file


def _read(base: str, name: str) -> bytes | None:
    fs, root = (pafs.LocalFileSystem(), path) if (path := _local(base)) else pafs.FileSystem.from_uri(base)
    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/{name}") as src:
        return src.read()


def _directory(contig: str, isochore: str) -> str:
    return "axis-" + hashlib.sha1(json.dumps([contig, isochore]).encode()).hexdigest()


def _runs(base: str):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        key, starts, ends = None, [], []

        def close():
            nonlocal seq, starts, ends
            s, e = np.concatenate(starts), np.concatenate(ends)
            out = io.BytesIO()
            np.save(out, np.vstack([s, e, np.cumsum(e - s) - (e - s)]))
            _write(base, f"run-{part}-{seq}.npy", out.getvalue())
            row = pa.RecordBatch.from_pylist([dict(contig=key[0], isochore=key[1], name=key[2], part=part, seq=seq, n=len(s))])
            seq, starts, ends = seq + 1, [], []
            return row

        for b in batches:
            names = [b.column(c).dictionary_encode() for c in ("contig", "isochore", "name")]
            codes = [x.indices.to_numpy() for x in names]
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            s, e = b.column("start").to_numpy(), b.column("end").to_numpy()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(x[lo].as_py() for x in names)
                if starts and now != key:
                    yield close()
                key = now
                starts.append(s[lo:hi])
                ends.append(e[lo:hi])
        if starts:
            yield close()

    return run


def _directories(base: str):
    def run(batches):
        for b in batches:
            for contig, isochore, runs in zip(*[b.column(c).to_pylist() for c in ("contig", "isochore", "runs")], strict=True):
                of: dict[str, list[str]] = {}
                for r in runs:
                    of.setdefault(r["name"], []).append(f"run-{r['part']}-{r['seq']}.npy")
                _write(base, _directory(contig, isochore), json.dumps(of).encode())
            yield b.select(["contig", "isochore"])

    return run


@dataclass
class AxisFiles:
    base: str
    sets: DataFrame  # contig, isochore, name, n: what the files hold
    runs: DataFrame | None = None  # the kept table that sets are read from

    def delete(self) -> None:
        """Delete all, once no samples of it are to be made any more."""
        delete_folder(self.sets.sparkSession, self.base)
        delete(self.runs)

    def axis(self, contig: str, isochore: str) -> Axis:
        return Axis(self.base, contig, isochore)


class Axis:
    """The sets of one axis; opened by tasks."""

    def __init__(self, base: str, contig: str, isochore: str) -> None:
        self.base = base
        body = _read(base, _directory(contig, isochore))
        self.runs: dict[str, list[str]] = json.loads(body) if body else {}

    def __iter__(self):
        return iter(self.runs)

    def __getitem__(self, name: str) -> Sorted:
        parts = []
        for run in self.runs.get(name, []):
            path = _local(self.base)
            parts.append(np.load(f"{path}/{run}", mmap_mode="r") if path else np.load(io.BytesIO(_read(self.base, run))))
        if len(parts) == 1:
            return Sorted(*(np.asarray(row) for row in parts[0]))
        both = np.concatenate([np.asarray(p[:2]) for p in parts], axis=1) if parts else np.zeros((2, 0), np.int64)
        return Sorted.of(both.T)


    def rows(self, name: str) -> Rows:
        """A set that is read in stretches; held, where it is small or its store is not mounted."""
        path, runs = _local(self.base), self.runs.get(name, [])
        out = Runs([f"{path}/{run}" for run in runs]) if path else None
        return Held(np.ascontiguousarray(self[name].array())) if out is None or len(out) <= HELD else out


class Runs:
    """Rows of a set's files, which are mapped while a stretch is copied, and not longer."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths
        self.first = np.cumsum([0, *(np.load(p, mmap_mode="r").shape[1] for p in paths)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def stretch(self, first: int, last: int) -> np.ndarray:
        out = np.empty((max(0, min(last, len(self)) - first), 2), np.int64)
        for path, at, end in zip(self.paths, self.first, self.first[1:], strict=False):
            lo, hi = max(first, at), min(last, end)
            if lo < hi:
                out[lo - first : hi - first] = np.load(path, mmap_mode="r")[:2, lo - at : hi - at].T
        return out

    def _count(self, row: int, values: np.ndarray, side: str) -> np.ndarray:
        return sum((np.searchsorted(np.load(p, mmap_mode="r")[row], values, side) for p in self.paths), np.zeros(len(values), np.int64))

    def before(self, ends: np.ndarray) -> np.ndarray:
        return self._count(1, ends, "right")

    def begun(self, starts: np.ndarray) -> np.ndarray:
        return self._count(0, starts, "left")


def written(df: DataFrame, name: str | None = "track") -> AxisFiles:
    """The intervals of df by axis and by the sets that the column `name` tells (None: one set, "")."""
    spark = df.sparkSession
    base = qualified(spark, new_path(spark))
    by = ["contig", "isochore", "name", "start", "end"]
    rows = strata(df).filter("end > start").select("contig", "isochore", (F.col(name) if name else F.lit("")).alias("name"), "start", "end")
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    runs = kept(rows.mapInArrow(_runs(base), "contig string, isochore string, name string, part long, seq long, n long"), tidy=True)
    # few rows: one for each set of an axis and each partition that it spans
    listed = runs.groupBy("contig", "isochore").agg(F.sort_array(F.collect_list(F.struct("name", "part", "seq"))).alias("runs"))
    kept(listed.mapInArrow(_directories(base), "contig string, isochore string"), tidy=True)
    return AxisFiles(base, runs.groupBy("contig", "isochore", "name").agg(F.sum("n").alias("n")), runs)
