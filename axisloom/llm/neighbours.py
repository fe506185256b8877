"""Approximate nearest neighbours: a navigable small-world graph in levels for each shard of vectors.

Equal vectors are one class, which keeps its least vec_ids. Classes are dealt to shards by a hash, and a
task builds each shard's graph and writes it as one file of flat arrays: vectors, and a row of neighbours
for each node of each level (a row with fewer is filled up with the node itself). Nodes are numbered by
falling level, so that a level's nodes are 0..n-1. Query vectors are written as files of blocks; a task
maps one shard and one block, walks the graph from the top level down with a beam for all queries of the
block at a time, and returns the best of each. What the shards found is merged by query. The driver holds
counts only.

Building goes through a level's nodes in batches: a batch is searched in the graph so far and compared
with itself, each node is linked to near nodes that are not nearer to one already chosen, and these link
back. A shard of no more vectors than the beam is compared with all of them, and so are queries for which
the walk met fewer vectors than asked for. A node's level comes from its hash, so a task that runs
again builds the same graph.

Defined results: nearness is Euclidean distance in double precision on the original vectors; ties go to
the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
vec_id, take no part; vectors of different length are never compared. Rows that share a vec_id are
candidates and queries of their own, and a query's own row is left out once. Empty tables give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._files import mapped_arrays, write_arrays
from ._groups import groups
from ._tables import Scratch, bound_batches, new_path, stored
from ._words import mix

K = 10
SHARD = 8192  # vectors of a shard
QUERIES = 1024  # query vectors of a block
DEGREE = 16  # links that a node chooses; level 0 holds twice as many
BUILD_BEAM = 80
SEARCH_BEAM = 160
_UPPER_BEAM = 8
_BATCH = 256
_EXPAND = 4


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes that a walk from the starts meets, nearest first: (ids, squared distances); -1 and inf fill up.

    All queries advance together: each step expands the nearest few unexpanded nodes of every beam, until
    all nodes in the beams are expanded.
    """
    b, n, degree = len(queries), len(links), links.shape[1]
    ids = np.full((b, width), -1, np.int64)
    dist = np.full((b, width), np.inf, x.dtype)
    done = np.ones((b, width), bool)
    seen, stamp = np.zeros((b, n), bool), np.zeros((b, n), np.int32)

    def add(row: np.ndarray, node: np.ndarray) -> None:
        """Put unseen nodes into the beams; `row` is sorted."""
        new = np.flatnonzero(~seen[row, node])
        row, node = row[new], node[new]
        order = np.arange(len(row), dtype=np.int32)
        stamp[row, node] = order
        once = stamp[row, node] == order
        row, node = row[once], node[once]
        seen[row, node] = True
        diff = x[node] - queries[row]
        d = np.einsum("ij,ij->i", diff, diff)
        near = d < dist[row, -1]
        row, node, d = row[near], node[near], d[near]
        if not len(row):
            return
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        which = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(row)]])))
        place = np.arange(len(row)) - first[which]
        at = row[first]
        size = int(place.max()) + 1
        new_ids, new_dist = np.full((len(at), size), -1, np.int64), np.full((len(at), size), np.inf, x.dtype)
        new_ids[which, place], new_dist[which, place] = node, d
        all_dist = np.concatenate([dist[at], new_dist], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        dist[at] = np.take_along_axis(all_dist, best, 1)
        ids[at] = np.take_along_axis(np.concatenate([ids[at], new_ids], axis=1), best, 1)
        done[at] = np.take_along_axis(np.concatenate([done[at], new_ids < 0], axis=1), best, 1)

    row, col = np.nonzero(starts >= 0)
    add(row, starts[row, col])
    live = np.arange(b)
    step = min(_EXPAND, width)
    while True:
        open_ = np.where(done[live], np.inf, dist[live])
        at = np.argpartition(open_, step - 1, axis=1)[:, :step]
        go = np.isfinite(np.take_along_axis(open_, at, 1))
        some = go.any(axis=1)
        live, at, go = live[some], at[some], go[some]
        if not len(live):
            return ids, dist
        r, c = np.nonzero(go)
        rows, places = live[r], at[r, c]
        done[rows, places] = True
        add(np.repeat(rows, degree), links[ids[rows, places]].ravel())


def _pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x (..., a, dim) and y (..., b, dim)."""
    out = (x * x).sum(-1)[..., :, None] + (y * y).sum(-1)[..., None, :] - 2 * (x @ np.swapaxes(y, -1, -2))
    return np.maximum(out, 0)


def chosen(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, size: int) -> np.ndarray:
    """Up to `size` of each row's candidates (nearest first, -1 fills up), as places in the row; -1 fills up.

    First those that are nearer to the row's node than to any candidate taken before, then the nearest others.
    """
    b, n = ids.shape
    out = np.full((b, size), -1, np.int64)
    step = max(1, (1 << 22) // (n * max(n, x.shape[1])))
    for lo in range(0, b, step):
        own, d = ids[lo : lo + step], dist[lo : lo + step]
        v = x[np.maximum(own, 0)]
        apart = _pairwise(v, v)
        least = np.full(own.shape, np.inf, x.dtype)
        taken = np.zeros(own.shape, bool)
        count = np.zeros(len(own), np.int64)
        for c in range(n):
            ok = np.isfinite(d[:, c]) & (count < size) & (d[:, c] < least[:, c])
            taken[:, c] = ok
            count += ok
            np.minimum(least, np.where(ok[:, None], apart[:, c], np.inf), out=least)
        rank = np.where(taken, 0, n) + np.arange(n)
        rank[~np.isfinite(d)] = 3 * n
        best = np.argsort(rank, axis=1)[:, :size]
        best[np.take_along_axis(rank, best, 1) >= 3 * n] = -1
        out[lo : lo + step, : best.shape[1]] = best
    return out


def _level(x: np.ndarray, n: int, degree: int, capacity: int, width: int, above: list[np.ndarray]) -> np.ndarray:
    """The links of a level of the nodes 0..n-1, given those of the levels above, top first."""
    links = np.repeat(np.arange(n)[:, None], capacity, 1)
    dist = np.full((n, capacity), np.inf, x.dtype)
    for lo in range(0, n, _BATCH):
        nodes = np.arange(lo, min(lo + _BATCH, n))
        q = x[nodes]
        near = _pairwise(q, q)
        np.fill_diagonal(near, np.inf)
        ids, d = np.broadcast_to(nodes, near.shape), near
        if lo:
            starts = descend(x, above, q)
            starts = np.where(starts < lo, starts, -1)  # nodes of the levels above come first on this one
            starts[(starts < 0).all(axis=1), 0] = 0
            far_ids, far = beam(x, links[:lo], q, starts, width)
            ids, d = np.concatenate([far_ids, ids], axis=1), np.concatenate([far, d], axis=1)
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        ids = np.where(np.isfinite(d), ids, -1)
        place = chosen(x, ids, d, degree)
        row, col = np.nonzero(place >= 0)
        a, b, ab = nodes[row], ids[row, place[row, col]], d[row, place[row, col]]
        _link(x, links, dist, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([ab, ab]), capacity)
    return links


def _link(x: np.ndarray, links: np.ndarray, dist: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, capacity: int) -> None:
    """Add links a -> b of squared length d; a node with more than it holds keeps those that chosen() gives."""
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])  # nodes of one batch choose each other
    fresh = np.concatenate([[True], ~again])[: len(a)]
    a, b, d = a[fresh], b[fresh], d[fresh]
    if not len(a):
        return
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    which = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(a)]])))
    place = np.arange(len(a)) - first[which]
    own = place < 2 * capacity  # of a batch's links to one node, the nearest can be of use
    nodes = a[first]
    size = min(int(place.max()) + 1, 2 * capacity)
    ids, far = np.full((len(nodes), size), -1, np.int64), np.full((len(nodes), size), np.inf, x.dtype)
    ids[which[own], place[own]], far[which[own], place[own]] = b[own], d[own]
    ids = np.concatenate([np.where(np.isfinite(dist[nodes]), links[nodes], -1), ids], axis=1)
    far = np.concatenate([dist[nodes], far], axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    full = np.isfinite(far).sum(axis=1) > capacity
    keep = np.repeat(np.arange(capacity)[None, :], len(nodes), 0) if ids.shape[1] >= capacity else np.tile(np.concatenate([np.arange(ids.shape[1]), np.full(capacity - ids.shape[1], -1)]), (len(nodes), 1))
    if full.any():
        keep[full] = chosen(x, ids[full], far[full], capacity)
    got = np.where(keep >= 0, np.take_along_axis(ids, np.maximum(keep, 0), 1), -1)
    got_far = np.where(keep >= 0, np.take_along_axis(far, np.maximum(keep, 0), 1), np.inf)
    links[nodes] = np.where(got >= 0, got, nodes[:, None])
    dist[nodes] = got_far


def descend(x: np.ndarray, above: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where to start on a level: the nodes that beams through the levels above it end with."""
    starts = np.zeros((len(queries), 1), np.int64)
    for links in above:
        starts = beam(x, links, queries, starts, _UPPER_BEAM)[0]
    return starts


def levels(keys: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """A level for each hash: each holds about one in `degree` of the nodes of the one below."""
    u = ((mix(keys.view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.floor(-np.log(u) / np.log(degree)).astype(np.int64)


def build(x: np.ndarray, level: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM) -> list[np.ndarray]:
    """Links of each level, top first, of vectors in order of falling level."""
    above: list[np.ndarray] = []
    for height in range(int(level.max()), -1, -1):
        n = int((level >= height).sum())
        capacity = degree if height else 2 * degree
        above.append(_level(x, n, degree, capacity, width, above))
    return above


def search(x: np.ndarray, links: list[np.ndarray], queries: np.ndarray, k: int, width: int = SEARCH_BEAM) -> np.ndarray:
    """The k nearest nodes that are found, nearest first; -1 where there are fewer nodes."""
    n = len(x)
    out = np.full((len(queries), k), -1, np.int64)
    width = max(width, k)
    todo = np.arange(len(queries))
    if n > width:
        for lo in range(0, len(queries), _BATCH):
            q = queries[lo : lo + _BATCH]
            out[lo : lo + _BATCH] = beam(x, links[-1], q, descend(x, links[:-1], q), width)[0][:, :k]
        todo = np.flatnonzero((out < 0).any(axis=1))
    for i in todo.tolist():
        diff = x - queries[i]
        d = np.einsum("ij,ij->i", diff, diff)
        best = np.argsort(d, kind="stable")[:k]
        out[i, : len(best)] = best
    return out


def _work(x: np.ndarray) -> np.ndarray:
    """The vectors in single precision where that is exact and squares stay in range, as they are otherwise."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if np.array_equal(small, x) and np.abs(x).max(initial=0) < 1e15 and np.abs(x[x != 0]).min(initial=1) > 1e-15 else x


def _matrix(column, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).astype(np.float64).reshape(-1, dim)


def _build_shards(base: str, k: int):
    def one(t: pa.Table) -> pa.RecordBatch:
        dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        h1, h2 = (t.column(c).to_numpy() for c in ("h1", "h2"))
        x = _matrix(t.column("embedding"), dim)
        members = np.full((len(h1), k + 1), -1, np.int64)
        count = np.zeros(len(h1), np.int64)
        for i, ids in enumerate(t.column("members").to_pylist()):
            members[i, : len(ids)] = ids
            count[i] = len(ids)
        level = levels(h1)
        order = np.lexsort((h2, h1, -level))
        x, level = x[order], level[order]
        links = build(_work(x), level)
        arrays = [h1[order], h2[order], _work(x).ravel(), members[order].ravel(), count[order], *[a.astype(np.int32).ravel() for a in links]]
        write_arrays(base, f"shard-{dim}-{shard}", arrays)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([shard], pa.int64())], names=["dim", "shard"])

    def run(batches):
        for t in groups(batches, 2):
            yield one(t)

    return run


def _write_blocks(base: str):
    def run(batches):
        for t in groups(batches, 2):
            dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
            write_arrays(base, f"queries-{dim}-{block}", [t.column("h1").to_numpy(), t.column("h2").to_numpy(), _matrix(t.column("embedding"), dim).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([block], pa.int64())], names=["dim", "block"])

    return run


def _search_blocks(base: str, blocks: str, k: int, members_k: int, width: int):
    def one(dim: int, shard: int, block: int) -> pa.RecordBatch:
        h1, h2, x, members, count, *flat = (np.asarray(a) for a in mapped_arrays(base, f"shard-{dim}-{shard}"))
        q1, q2, q = (np.asarray(a) for a in mapped_arrays(blocks, f"queries-{dim}-{block}"))
        x, q, members = x.reshape(-1, dim), q.reshape(-1, dim), members.reshape(-1, members_k)
        level = levels(h1)
        links = [a.reshape(int((level >= height).sum()), -1) for a, height in zip(flat, range(len(flat) - 1, -1, -1), strict=True)]
        work = _work(q) if x.dtype == np.float32 else q
        found = search(x, links, work, k, width)
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = np.zeros(len(row))
        for lo in range(0, len(row), 4096):
            diff = x[node[lo : lo + 4096]].astype(np.float64) - q[row[lo : lo + 4096]]
            score[lo : lo + 4096] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        own = (h1[node] == q1[row]) & (h2[node] == q2[row])
        size = count[node]
        rep = np.repeat(np.arange(len(row)), size)
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size)
        vec = members[node[rep], nth]
        order = np.lexsort((vec, score[rep], row[rep]))
        r = row[rep][order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        nth = np.arange(len(r)) - np.repeat(first, np.diff(np.concatenate([first, [len(r)]])))
        order, r = order[nth < k], r[nth < k]
        return pa.RecordBatch.from_arrays([pa.array(q1[r]), pa.array(q2[r]), pa.array(score[rep][order]), pa.array(vec[order]), pa.array(own[rep][order])], names=["h1", "h2", "score", "vec_id", "own"])

    def run(batches):
        for b in batches:
            for job in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                yield one(*job)

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim, h1, h2) of the rows that take part; zeros of either sign are alike."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))
    return rows.select("vec_id", "embedding", F.size("embedding").cast("long").alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


@dataclass
class Index:
    base: str
    shards: DataFrame  # (dim, shard) of the files
    k: int


def _tasks(n: int) -> int:
    """Partitions for n keys dealt by hash, so that few share a task."""
    return max(1, min(4 * n, 20_000))


def index(vectors: DataFrame, k: int = K, shard: int = SHARD) -> Index:
    """Graphs over all vectors, in files of the shared folder; searches may ask for up to k neighbours."""
    spark = vectors.sparkSession
    bound_batches(spark)
    usable = _usable(vectors)
    base = new_path(spark, "graphs")
    with Scratch() as kept:
        classes = usable.groupBy("h1", "h2").agg(F.first("dim").alias("dim"), F.first("embedding").alias("embedding"))
        least = usable.select("h1", "h2", "vec_id").withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
        least = least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
        classes = kept(classes.join(least, ["h1", "h2"]), "classes")
        sizes = kept(classes.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards")), "sizes")
        total = sizes.agg(F.sum("shards")).first()[0] or 0
        dealt = classes.join(sizes, "dim").select("dim", F.pmod("h1", "shards").alias("shard"), "h1", "h2", "embedding", "members")
        dealt = dealt.repartition(_tasks(total), "dim", "shard").sortWithinPartitions("dim", "shard", "h1", "h2")
        return Index(base, stored(dealt.mapInArrow(_build_shards(base, k), "dim long, shard long"), "shards"), k)


def nearest(queries: DataFrame, found_in: Index, k: int = K, width: int = SEARCH_BEAM, leave_out_own: bool = True) -> DataFrame:
    """The k nearest vectors found for each query row: query_id, rank (from 1), vec_id, score.

    With leave_out_own the queries are rows of the index, and each row's own is left out.
    """
    if k > found_in.k:
        raise ValueError(f"the index was built for up to {found_in.k} neighbours")
    spark = queries.sparkSession
    bound_batches(spark)
    usable = _usable(queries)
    blocks = new_path(spark, "blocks")
    ask = k + 1  # the own row may be among them
    with Scratch() as kept:
        rows = kept(usable.select("vec_id", "h1", "h2"), "queries")
        classes = kept(usable.groupBy("h1", "h2").agg(F.first("dim").alias("dim"), F.first("embedding").alias("embedding")), "query_classes")
        sizes = kept(classes.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("blocks")), "query_sizes")
        total = sizes.agg(F.sum("blocks")).first()[0] or 0
        dealt = classes.join(sizes, "dim").select("dim", F.pmod("h2", "blocks").alias("block"), "h1", "h2", "embedding")
        dealt = dealt.repartition(_tasks(total), "dim", "block").sortWithinPartitions("dim", "block", "h1", "h2")
        written = kept(dealt.mapInArrow(_write_blocks(blocks), "dim long, block long"), "blocks")
        jobs = kept(found_in.shards.join(written, "dim").select("dim", "shard", "block"), "jobs")
        n = jobs.count()
        schema = "h1 long, h2 long, score double, vec_id long, own boolean"
        found = jobs.repartition(max(1, min(n, 20_000))).mapInArrow(_search_blocks(found_in.base, blocks, ask, found_in.k + 1, width), schema)
        # no later than here are the shards' results merged: k + 1 of each query vector stay
        place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("score", "vec_id"))
        best = found.withColumn("place", place).filter(F.col("place") <= ask)
        best = kept(best.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "own"))).alias("best")), "best")
        # rows that share a vector asked for by more than a thousandth of all rows (so a thousand such vectors at most) are salted
        asked = rows.count()
        hot = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter((F.col("n") * 1000 > asked) & (F.col("n") > 64))
        hot = F.broadcast(hot.select("h1", "h2", F.ceil(F.col("n") / 64).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        left = rows.join(hot, ["h1", "h2"], "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts).cast("int")).drop("salts")
        right = best.join(hot, ["h1", "h2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        joined = left.withColumnRenamed("vec_id", "query_id").join(right, ["h1", "h2", "salt"])
        own = F.array_position(F.transform("best", lambda b: b["own"] & (b["vec_id"] == F.col("query_id"))), True)
        rest = F.filter("best", lambda b, i: (i + 1) != F.col("at")) if leave_out_own else F.col("best")
        listed = joined.withColumn("at", own).select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "hit"))
        return stored(listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")), "nearest")
