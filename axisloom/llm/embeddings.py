"""Near-duplicate vectors within a label, by int8 tile products with error bounds.

Vectors are scaled to unit length in double precision and quantised to int8, x = s*q + e. As
x.y = sq.tr + sq.f + e.y for y = t*r + f, the product of the quantised vectors is off by at most
|sq||f| + |e|, both known per vector. Only pairs that this bound leaves possibly at or above the
threshold are computed again in double precision, and that value decides.

Equal vectors of a label are one class. A label's classes are dealt to blocks of about BLOCK, and
each pair of blocks is one tile, so no task holds a label. A tile returns a row per member
(links counted with the classes' sizes, and the smallest member it is joined to there), never pairs.

Defined results: rows with a null label, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; vectors of different length never link; rows that share a
vec_id count as vectors of their own that form one node; a null vec_id keeps its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import groups
from ._tables import Scratch, bound_batches, stored
from .components import components

THRESHOLD = 0.98
BLOCK = 2048  # classes of a block; a tile needs some 100 MB
_SUB = 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scales, norms of what the int8 vectors stand for, norms of the errors) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    stands = q * scale[:, None]
    return q, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(unit - stands, axis=1)


def int8_products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer products: float32 sums of 127*127 terms are exact below 2**24, so up to 1024 at a time."""
    out = np.zeros((len(q), len(r)), np.float64)
    for k in range(0, q.shape[1], 1024):
        out += q[:, k : k + 1024].astype(np.float32) @ r[:, k : k + 1024].astype(np.float32).T
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float, quantised=None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of two sets of unit vectors whose product is at least the threshold."""
    qx, sx, nx, ex = quantised[0] if quantised else quantise(x)
    qy, sy, ny, ey = quantised[1] if quantised else quantise(y)
    bound = nx[:, None] * ey[None, :] + ex[:, None] + 1e-9
    a, b = np.nonzero(int8_products(qx, qy) * sx[:, None] * sy[None, :] + bound >= threshold)
    sure = [np.einsum("ij,ij->i", x[a[i : i + 50_000]], y[b[i : i + 50_000]]) >= threshold for i in range(0, len(a), 50_000)]
    sure = np.concatenate(sure) if sure else np.zeros(0, bool)
    return a[sure], b[sure]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(threshold: float):
    def tile(t: pa.Table) -> pa.RecordBatch:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rep, block, size = (t.column(c).to_numpy() for c in ("rep", "block", "size"))
        order = np.lexsort((rep, block))
        dim = t.column("dim")[0].as_py()
        flat = pa.concat_arrays([c.flatten() for c in t.column("embedding").chunks]).to_numpy(zero_copy_only=False)
        x = flat.astype(np.float64).reshape(-1, dim)[order]
        rep, block, size = rep[order], block[order], size[order]
        x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        quantised = quantise(x)
        n = len(rep)
        ones, others = (0, int((block == i).sum())), (0, n) if i == j else (int((block == i).sum()), n)
        links = np.zeros(n, np.int64)
        root = np.arange(n)
        for lo in range(*ones, _SUB):
            hi = min(lo + _SUB, ones[1])
            for lo2 in range(max(others[0], lo if i == j else 0), others[1], _SUB):
                hi2 = min(lo2 + _SUB, others[1])
                a, b = linked(x[lo:hi], x[lo2:hi2], threshold, [[v[lo:hi] for v in quantised], [v[lo2:hi2] for v in quantised]])
                a, b = a + lo, b + lo2
                if i == j:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    links += np.bincount(a, size[b], n).astype(np.int64) + np.bincount(b, size[a], n).astype(np.int64)
                    new = _roots(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, root]))
                    root = new
        some = np.flatnonzero(links)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, root, rep)
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(least[root[some]])], names=["rep", "links", "root"])

    def run(batches):
        for t in groups(batches, 4):
            yield tile(t)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    key = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string"))), 256)
    with Scratch() as kept:
        usable = kept(usable.withColumn("key", key).withColumn("row", F.monotonically_increasing_id()), "vectors")
        # a class, all equal vectors of a label, is named by its least row: rep
        classes = usable.groupBy("label", "key").agg(F.min("row").alias("rep"), F.min("vec_id").alias("vec_id"), F.count("*").alias("size"), F.first("embedding").alias("embedding"), F.first(F.size("embedding")).alias("dim"))
        classes = kept(classes, "classes")
        counted = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        dealt = classes.join(counted, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = dealt.select("label", F.col("dim").cast("long").alias("dim"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "size", "embedding")
        found = tiles.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j").mapInArrow(_tiles(threshold), "rep long, links long, root long")
        found = kept(found, "links")
        # a vec_id on several vectors is one node
        placed = kept(usable.select("vec_id", "label", "key").join(classes.select("label", "key", "rep"), ["label", "key"]).select("vec_id", "rep"), "placed")
        several = placed.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).filter("a < most").select("vec_id", "a")
        alike = placed.join(several, "vec_id").filter("rep <> a").select(F.col("a").alias("rep"), F.col("rep").alias("root")).distinct()
        joined = kept.add(components(found.select("rep", "root").unionByName(alike), "rep", "root")).withColumnRenamed("node", "rep")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        named = classes.select("rep", "vec_id").join(joined, "rep").groupBy("component").agg(F.min("vec_id").alias("component_id"))
        of_class = classes.select("rep", "vec_id", "size").join(links, "rep", "left").join(joined.join(named, "component").select("rep", "component_id"), "rep", "left")
        of_class = of_class.select("rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        known = placed.join(of_class, "rep").select("vec_id", "n_links", "component_id")
        unusable = rows.filter(~F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
        alone = unusable.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return stored(known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "groups")
