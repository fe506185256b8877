"""MinHash near-duplicate detection with full-set confirmation.

Signatures are minima of many universal hash functions over a document's distinct word shingles;
bands of the signature propose pairs, the signature verifies them, the full shingle sets confirm
them, and connected components come from alternating large-star and small-star.

Pairs are never enumerated inside a group of copies. Documents with equal sets are one class from
the start. In each band bucket every class is first compared with the bucket's smallest only;
buckets whose members then share a component are settled, as further links cannot change it. Only
in the others are members of different components compared, so nothing is capped or dropped.

Everything between documents and result is keyed by class, one row each, so neither repeated rows
nor a doc_id with several texts multiply anything.

Defined results: null or wordless texts have an empty set and link with nothing; texts with fewer
words than a shingle have one shingle, the whole sequence; rows that share a doc_id count as one
node, which has the links of all its texts (wordless rows stay by themselves); a null doc_id keeps
its row, with the component of its class, and joins nothing but by its text; repeated rows each
have their row of the result; texts of any length are compared whole; of ties nothing depends on
the order, as a component's name is its smallest doc_id; empty tables give no rows. Other columns
of the input, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import groups
from ._tables import Scratch, bound_batches, drop, maybe_in, only, stored
from ._words import Words, blocks, mix, split
from .components import components

WORDS = 5  # words of a shingle
BANDS, ROWS = 30, 6  # at similarity 0.85, a pair shares no band with probability 7e-7
PERCENT = 85  # least 100 * intersection / union

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
_SETS = pa.schema([("set_key", pa.binary()), ("shingles", pa.binary())])


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of the block."""
    h, n = words.hashes, len(words.hashes)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled += h[j : n - k + 1 + j] * odd[j]
        rolled = mix(rolled)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = mix((h[a:b] * odd[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def hash_functions(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add functions modulo 2**32, odd multipliers, as columns."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], draw.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), step):
        best = np.minimum(best, (a * x[None, i : i + step] + b).min(axis=1))
    return best


def set_key(shingles: bytes) -> bytes:
    return hashlib.md5(shingles).digest()


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        a, b = hash_functions(bands * rows)
        odd = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                out: tuple[list, ...] = ([], [], [], [])
                for s in shingle_sets(split(data, offsets), k):
                    out[0].append(len(s))
                    if len(s):
                        sig = signature(s, a, b)
                        keys = mix((sig.reshape(bands, rows).astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64) + salt)
                        out[1].append(set_key(s.tobytes()))
                        out[2].append(keys.view(np.int64))
                        out[3].append(sig.astype(np.uint8).tobytes())
                    else:
                        for x in out[1:]:
                            x.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(out, _SKETCH.types[1:], strict=True))], schema=_SKETCH)

    return run


def _sets(k: int):
    """Shingle sets by their key, each once a task."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                keys, sets = [], []
                for s in shingle_sets(split(data, offsets), k):
                    blob = s.tobytes()
                    if len(s) and (key := set_key(blob)) not in seen:
                        seen.add(key)
                        keys.append(key)
                        sets.append(blob)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], schema=_SETS)

    return run


def least_share(percent: int, count: int) -> float:
    """Five standard deviations of the share of agreeing minima, below the threshold."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / count) ** 0.5


def _linked_across(percent: int, least: float):
    """Links between components among the members of a bucket's block, or of two of its blocks.

    A pair is compared in the bucket of its first common band only; links that join nothing new
    here are left out, so there are fewer links than members.
    """

    def links(t: pa.Table) -> tuple[list, list]:
        bucket, i, j = (t.column(c)[0].as_py() for c in range(3))
        block, rep, comp, n = (t.column(c).to_numpy() for c in range(3, 7))
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        sig = np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("sig")])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        names, comp = np.unique(comp, return_inverse=True)
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        ones, others = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out: tuple[list, list] = ([], [])
        for a in ones.tolist():
            c = others[others > a] if i == j else others
            c = c[(comp[c] != comp[a]) & (100 * np.minimum(n[c], n[a]) >= percent * np.maximum(n[c], n[a]))]
            c = c[(sig[c] == sig[a]).mean(axis=1) >= least]
            c = c[(bands[c] == bands[a]).argmax(axis=1) == band]
            if not len(c):
                continue
            size = np.array([len(sets[x]) for x in c])
            all_ = np.concatenate([sets[x] for x in c])
            at = np.searchsorted(sets[a], all_)
            at[at == len(sets[a])] = 0
            both = np.bincount(np.repeat(np.arange(len(c)), size), weights=sets[a][at] == all_, minlength=len(c)).astype(np.int64)
            for x in c[100 * both >= percent * (size + len(sets[a]) - both)].tolist():
                if comp[x] != comp[a]:
                    out[0].append(int(rep[a]))
                    out[1].append(int(rep[x]))
                    comp[comp == comp[x]] = comp[a]
        return out

    def run(batches):
        for t in groups(batches, 3):
            a, b = links(t)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _across(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, count: int, block: int = 256) -> DataFrame:
    """Links (a, b) between members of different components of a bucket.

    members: bucket, size (of the bucket), rep, component. A bucket's members are dealt to blocks of
    about `block`, and each pair of blocks is compared by itself, so no task holds a whole bucket.
    """
    whole = sets.join(reps, "rep")
    blocks_ = F.ceil(F.col("size") / block).cast("int")
    dealt = members.withColumn("blocks", blocks_).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component")
    rows = tasks.join(whole, "rep").select("bucket", "i", "j", "block", "rep", "component", "n_shingles", "bands", "sig", "shingles")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_linked_across(percent, least_share(percent, count)), "a long, b long")


def _close(least: float):
    """Pairs whose signatures agree often enough; bytes agree by chance once in 256."""

    def run(batches):
        for t in batches:
            keep = [float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()) >= least for x, y in zip(t.column("sig_a").to_pylist(), t.column("sig_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent: int):
    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column("set_a"), t.column("set_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep and shingles of the wanted classes (a column rep), one row each.

    Texts are read again where the bitmap of doc_ids lets them through; the join by the sets' own keys
    is exact, so whatever else passed goes before anything is written.
    """
    named = classes.join(wanted.select("rep").distinct(), "rep", "left_semi")
    found = maybe_in(docs, "doc_id", named).filter("maybe").select("text").mapInArrow(_sets(k), "set_key binary, shingles binary")
    return found.join(named.select("set_key", "rep"), "set_key").dropDuplicates(["set_key"]).select("rep", "shingles")


def _side(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.col("rep").alias(name), F.col(value).alias(f"{'set' if value == 'shingles' else value}_{name}"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    bound_batches(docs.sparkSession)
    docs = only(docs.withColumnsRenamed({id_col: "doc_id", text_col: "text"}) if (id_col, text_col) != ("doc_id", "text") else docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch() as kept:
        sketch = kept(docs.mapInArrow(_sketch(k, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary").withColumn("row", F.monotonically_increasing_id()), "sketch")
        # a class is named by the least row that has its set: rep
        classes = kept(sketch.filter("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc_id")), "classes")
        reps = kept(sketch.select(F.col("row").alias("rep"), "n_shingles", "bands", "sig").join(classes.select("rep"), "rep", "left_semi"), "reps")
        least = least_share(percent, bands * rows)

        member = reps.select("rep", F.explode("bands").alias("bucket"))
        buckets = kept(member.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most").select("bucket", "least"), "buckets")
        shared = kept(member.join(buckets, "bucket"), "shared")
        stars = shared.filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
        near = kept(stars.join(_side(reps, "a", "sig"), "a").join(_side(reps, "b", "sig"), "b").mapInArrow(_close(least), "a long, b long"), "near")
        sets = kept(_sets_of(docs, classes, near.select(F.col("a").alias("rep")).union(near.select("b")), k), "sets")
        links = kept(near.join(_side(sets, "a", "shingles"), "a").join(_side(sets, "b", "shingles"), "b").mapInArrow(_linked(percent), "a long, b long"), "links")
        found = kept.add(components(links, "a", "b"))

        # buckets that still hold several components: compare across them, but not with the smallest again
        placed = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("bucket", "size")
        left = kept(placed.filter("rep <> least").join(open_, "bucket").select("bucket", "size", "rep", "component"), "open")
        sets = kept(_sets_of(docs, classes, left, k), "sets")
        more = kept(_across(left, reps, sets, percent, bands * rows), "links")

        # a doc_id on texts of several classes is one node
        placed = sketch.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "n_shingles", "rep")
        placed = kept(placed, "placed")
        several = placed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).filter("a < most").select("doc_id", "a")
        alike = kept(placed.join(several, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "alike")
        if not (more.isEmpty() and alike.isEmpty()):
            found = kept.add(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(alike), "a", "b"))

        linked = classes.select("rep", "doc_id").join(found.withColumnRenamed("node", "rep"), "rep")
        named = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        names = classes.select("rep", "doc_id").join(found.withColumnRenamed("node", "rep").join(named, "component").select("rep", "component_id"), "rep", "left").select("rep", F.coalesce("component_id", "doc_id").alias("component_id"))
        out = placed.join(names, "rep").select("doc_id", "n_shingles", "component_id")
        wordless = sketch.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return stored(out.unionByName(wordless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "groups")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, of which each group keeps its smallest doc_id.

    A doc_id goes or stays with all its rows; of rows of one doc_id with equal texts one stays, those
    with different texts all do. Rows without a doc_id can't be named in a group and stay.
    """
    found = near_duplicates(docs, **options)
    dropped = stored(found.filter("not kept and doc_id is not null").select("doc_id").distinct(), "dropped")
    repeated = stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    drop(found)
    marked = maybe_in(docs.select("doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("row")), "doc_id", dropped)
    unpacked = [F.col("row")[c].alias(c) for c in docs.columns]
    left = marked.filter("not maybe").select(*unpacked).unionByName(marked.filter("maybe").join(dropped, "doc_id", "left_anti").select(*unpacked))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").select(*docs.columns).withColumn(_TEXT, F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn(_NULL, F.col("text").isNull())
    once = once.dropDuplicates(["doc_id", _TEXT, _NULL]).select(*docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


_TEXT, _NULL = "axisloom text", "axisloom null"
