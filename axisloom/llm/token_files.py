"""Token ids in binary files: ids ranked by frequency, in variable-length bytes with control bytes.

Every document's ids, with an end id, are replaced by their rank among the ids of the whole corpus,
so the most frequent take one byte. Ranks take 1 to 4 bytes; two bits each, four to a control byte,
give their lengths, and control bytes stand apart from the data so that numpy decodes a whole file
by looking lengths up in a table, without a loop over ids.

Documents are dealt to files by ranges of (doc_id, a hash of the ids, row), each sorted, and a file
holds its documents' ids, counts, control bytes and data. The ranges' bounds come from a sample of
keys and only decide how even the files are; as the key goes beyond doc_id, documents that share
one, or have none, spread over files as all others do. Files are written to the shared folder by the
tasks that sort them; the number of ids before each file is a running sum in two levels.

Texts are encoded once, to a table that the counts and the files are made from. Words are encoded
once and remembered, as the tokenizer never looks beyond white space. A text that holds the string of
one of the vocabulary's added tokens is given to the tokenizer whole, as those are sought across words.

Defined results: null texts count as empty and hold the end id alone; a null doc_id comes before all
others; documents that share a doc_id stand next to each other in an order fixed by their ids, and
repeated rows each have their own place; a text of any length is encoded whole and stands in one
file; an empty table has no files and reads back as no rows. Columns of other names are never read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._files import mapped_arrays, write_arrays
from ._groups import groups
from ._tables import bound_batches, drop, new_path, stored

END_ID = 1
MEMO = 1_200_000  # words remembered by a worker, about
FILE = 128 << 20  # most bytes of text of a file, about
SMALL = 4 << 20  # where there is less text than tasks take: bytes of text of a file, about
SAMPLED = 4  # keys sampled for each file's bounds
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # of the four ids of a control byte


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of ranks below 2**32; zeros fill the last control byte's places."""
    control, data, _ = _packed(np.concatenate([ranks.astype(np.uint32), np.zeros(-len(ranks) % 4, np.uint32)]))
    return control, data


def _packed(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, end of each rank's data) of a multiple of four ranks."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = extra.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(extra, dtype=np.int64) + np.arange(1, len(ranks) + 1)
    at = ends - extra - 1
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        some = np.flatnonzero(extra >= k) if k else slice(None)
        if k and not len(some):
            break
        data[at[some] + k] = (ranks[some] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8), data, ends


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of n[i] values of each of several runs that are padded to fours, end of each padded run)."""
    ends = np.cumsum(n + -n % 4)
    begins = ends - (n + -n % 4)
    return np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum()), ends


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of data."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of these bytes."""
    length = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(length) - length
    out = data[at].astype(np.uint32)
    for k in range(1, int(length.max(initial=1))):
        some = np.flatnonzero(length > k)
        out[some] |= data[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Memo(dict):
    """Ids of ASCII-lower-cased words, in as few bytes as the vocabulary needs.

    A word of Latin letters with ASCII punctuation behind it is two pre-tokens, so it is put together
    from the word and the punctuation, and takes a place of its own only where the word is known already.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # ids of a word don't depend on its neighbours, but for added tokens, which are sought in the whole text
        self.added = added_tokens(self.tokenizer)
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.end = self.packed([END_ID])
        self.older: dict[bytes, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.older.get(word)) is not None:
            self[word] = ids
            return ids
        core = word.rstrip(_PUNCTUATION)
        if core and len(core) < len(word) and (core.isalpha() or (t := core.decode()).isalpha() and max(t) < "\u0130"):
            often = core in self
            ids = self[core] + self[word[len(core) :]]
            return self.keep(word, ids) if often else ids
        ids = self.packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        return self.keep(word, ids)

    def keep(self, word: bytes, ids: bytes) -> bytes:
        if len(word) <= 64:
            if len(self) >= MEMO // 2:
                # what was not asked for since the last such time goes
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def added_tokens(tokenizer) -> re.Pattern | None:
    """Finds, in ASCII-lower-cased bytes, what may be one of the vocabulary's added tokens."""
    strings = sorted({t.content.encode().lower() for t in tokenizer.get_added_tokens_decoder().values()})
    return re.compile(b"|".join(map(re.escape, strings))) if strings else None


def id_type(vocabulary: int) -> str:
    return "H" if vocabulary <= 1 << 16 else "I"


_memo: tuple[str, Memo | None] = ("", None)


def _worker_memo(path: str) -> Memo:
    global _memo
    if _memo[0] != path:
        _memo = path, Memo(path)
    return _memo[1]


def encoded(memo: Memo, text: str | None) -> bytes:
    """Ids with the end id; bytes.lower() and bytes.split() know ASCII only, and the tokenizer treats that no other way."""
    raw = text.encode().lower() if text else b""
    if memo.added and memo.added.search(raw):
        return memo.packed(memo.tokenizer.encode(text, add_special_tokens=False).ids) + memo.end
    return b"".join(map(memo.__getitem__, raw.split())) + memo.end


def _encoded(path: str):
    """Documents' ids."""

    def run(batches):
        memo = _worker_memo(path)
        for batch in batches:
            ids = [encoded(memo, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _frequencies(kind: str):
    def run(batches):
        count = np.zeros(1 << 16 if kind == "H" else 1, np.int64)
        for batch in batches:
            more = np.bincount(_bytes(pa.chunked_array([batch.column(0)]))[0].view(kind), minlength=len(count))
            more[: len(count)] += count
            count = more
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["id", "n"])

    return run


class Bounds:
    """Ranges of keys (null doc_id first, doc_id, hash, row); keys are sorted."""

    def __init__(self, keys: list[tuple[int, int, int, int]]):
        self.keys = keys
        self.named = [k[1:] for k in keys if k[0]]
        self.docs = np.array([k[0] for k in self.named], np.int64)

    def part(self, null: np.ndarray, doc: np.ndarray, tie: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The number of bounds at or below each key."""
        before = len(self.keys) - len(self.named)
        out = before + np.searchsorted(self.docs, doc, side="left")
        again = np.searchsorted(self.docs, doc, side="right") > out - before
        for i in np.flatnonzero(again | null).tolist():
            out[i] = bisect_right(self.keys, (0 if null[i] else 1, 0 if null[i] else int(doc[i]), int(tie[i]), int(row[i])))
        return out


def _ranked(kind: str, ranks, bounds):
    """Documents as packed ranks with the number of their file, many at a time."""

    def run(batches):
        rank, edges = ranks.value, bounds.value
        for batch in batches:
            null = np.array(batch.column(0).is_null())
            part = pa.array(edges.part(null, *(batch.column(i).fill_null(0).to_numpy() for i in (0, 2, 3))))
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                raw, sizes = _bytes(pa.chunked_array([some.column(1)]))
                ids = raw.view(kind)
                n = sizes // ids.itemsize
                places, ends = _places(n)
                packed = np.zeros(int(ends[-1]), np.uint32)
                packed[places] = rank[ids]
                control, data, data_ends = _packed(packed)
                yield pa.RecordBatch.from_arrays([part.slice(i, 500), some.column(0), some.column(2), some.column(3), pa.array(n), _binaries(control, ends // 4), _binaries(data, data_ends[ends - 1])], names=["part", "doc_id", "tie", "row", "n_tokens", "control", "data"])

    return run


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a binary column, size of each value)."""
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for c in column.chunks:
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
            sizes.append(np.diff(offsets))
    return np.concatenate(parts), np.concatenate(sizes)


def _written(base: str):
    def run(batches):
        for t in groups(batches, 1):
            part = t.column("part")[0].as_py()
            doc = t.column("doc_id")
            n = t.column("n_tokens").to_numpy()
            control, data = _bytes(t.column("control")), _bytes(t.column("data"))
            null = np.array(doc.is_null().to_pylist(), np.uint8)
            write_arrays(base, f"ids-{part}", [doc.fill_null(0).to_numpy(), null, n, *control, *data])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([int(n.sum())], pa.int64())})

    return run


def write(docs: DataFrame, path: str, file_bytes: int = FILE, small: int = SMALL) -> tuple[str, DataFrame, np.ndarray]:
    """(folder, rows of a file's number, its ids and the ids before it, id of each rank): docs.text tokenized by the file at path and written."""
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = id_type(Memo(path).tokenizer.get_vocab_size())
    ids = rows.mapInArrow(_encoded(path), "doc_id long, ids binary").withColumns({"tie": F.xxhash64("ids"), "row": F.monotonically_increasing_id(), "size": F.length("ids")})
    ids = stored(ids, "ids", "zstd")
    total, size = ids.agg(F.count("*"), F.sum("size")).first()
    size = 4 * (size or 0) // np.dtype(kind).itemsize  # bytes of text, about
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-size // file_bytes), min(shuffled, size // small))
    # a sample of keys, by hash; its size follows from the number of files
    share = min(1.0, SAMPLED * parts / max(total, 1))
    sample = ids.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(F.col("doc_id").isNotNull().cast("int"), F.coalesce("doc_id", F.lit(0)), "tie", "row") if parts > 1 else None
    keys = sorted(tuple(r) for r in sample.toLocalIterator()) if parts > 1 else []
    bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    # as many numbers as the vocabulary has ids
    counted = ids.select("ids").mapInArrow(_frequencies(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted(((r.n, -r.id) for r in counted), reverse=True)
    of_rank = np.array([-i for _, i in order], np.int64)
    rank = np.zeros(int(of_rank.max(initial=END_ID)) + 1, np.uint32)
    rank[of_rank] = np.arange(len(of_rank), dtype=np.uint32)
    base = new_path(spark, "ids")
    sc = spark.sparkContext
    packed = ids.select("doc_id", "ids", "tie", "row").mapInArrow(_ranked(kind, sc.broadcast(rank), sc.broadcast(Bounds(bounds))), "part long, doc_id long, tie long, row long, n_tokens long, control binary, data binary")
    tasks = max(parts, shuffled)
    dealt = packed.repartition(tasks, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "tie", "row").select("part", "doc_id", "n_tokens", "control", "data")
    files = stored(dealt.mapInArrow(_written(base), "part long, n long"), "files")
    drop(ids)
    # ids before each file: within blocks of files, after the sum of the blocks before
    blocked = files.withColumn("block", F.expr(f"part div {_BLOCK}"))
    sums = blocked.groupBy("block").agg(F.sum("n").alias("sum")).withColumn("base", F.sum("sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = blocked.withColumn("own", own).join(sums.select("block", "base"), "block")
    return base, before.select("part", "n", (F.coalesce("own", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("before")), of_rank


_BLOCK = 4096  # files of a block of the running sum


def _read(base: str, shared):
    def run(batches) -> Iterator[pa.RecordBatch]:
        of_rank = shared.value
        for batch in batches:
            for part, before in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), strict=True):
                doc, null, n, control, control_size, data, data_size = mapped_arrays(base, f"ids-{part}")
                start = before + np.cumsum(n) - n
                c, d = np.cumsum(control_size), np.cumsum(data_size)
                for i in range(0, len(n), 500):
                    j = min(i + 500, len(n))
                    c0, d0 = int(c[i] - control_size[i]), int(d[i] - data_size[i])
                    own = control[c0 : int(c[j - 1])]
                    ranks = unpack(own, data[d0 : int(d[j - 1])], 4 * len(own))
                    ids = of_rank[ranks[_places(n[i:j])[0]]].astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array(doc[i:j], mask=null[i:j].astype(bool)), pa.array(start[i:j]), pa.array(n[i:j]), _binaries(ids.view(np.uint8), np.cumsum(n[i:j]) * 4)], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark, written: tuple[str, DataFrame, np.ndarray]) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers), read back from the files."""
    base, files, of_rank = written
    rows = files.select("part", "before").repartition(max(1, files.count()))
    return rows.mapInArrow(_read(base, spark.sparkContext.broadcast(of_rank)), "doc_id long, start long, n_tokens long, ids binary")
