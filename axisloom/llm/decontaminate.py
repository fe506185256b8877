"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

An item's windows are its runs of `window` consecutive words (one shorter window for items of
fewer). Words are ordered by rarity over the whole corpus. As containment must be complete, the
necessary prefix of a window is its single rarest word: a document can only hold the window where
that word occurs. Each such occurrence gives one start for each place that the word has in its windows and
each of their lengths, at most 55 for ten words; positional and length bounds (the window must fit between the
document's first and last word) cut these, a hash of all words from the start on tells the window, however
many windows share the word, and what is found is verified word by word. Occurrences are taken in slices, so
memory depends neither on how many windows share a word nor on how often a text repeats it.

Equal windows of all items are one, with a number. Distinct windows are dealt to parts of about PART,
each built by a task and written as files of arrays, which the tasks that read documents map into
memory, so neither the driver nor any worker's heap holds windows. One pass over the documents
counts the words that windows hold, a second one looks every part up for each block of texts.
Candidates are compared by 64-bit hashes of their words first, then by the words' bytes. Items' ids
are joined to the sets of windows that documents hold, by windows' numbers.

Defined results: null texts have no words; a null or repeated item_id is allowed (null is written
as an empty string, repeats count once); without documents or items there are no rows or no hits;
every row of the documents keeps its own result, whatever its id, and repeated rows each have theirs;
texts of any length are searched whole; of equally rare words the one of least hash is sought, which
changes no result. Columns of other names are never read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import mapped_arrays, write_arrays
from ._groups import groups
from ._tables import bound_batches, delete, new_path, stored
from ._words import Words, _powers_to, blocks, mix, split, word_hashes

WINDOW = 10
PART = 200_000  # distinct windows of a part of the index, about
_BITS = 20
_SLICE = 1 << 14  # occurrences of rarest words that are looked at together

_HITS = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, windows array<long>"
_SPANS, _NUMBERS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64())


def item_word_table() -> np.ndarray:
    """True for the bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    table = np.ones(256, dtype=bool)
    table[0x00:0x30] = table[0x3A:0x61] = table[0x7B:0x80] = False
    return table


_INWORD = item_word_table()


def _windows(size: int):
    """Each item's windows: their words with zero bytes between."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.string()).to_pylist()
            for lo, _, data, offsets in blocks(batch.column(1)):
                w = split(data, offsets, _INWORD)
                raw = w.data.tobytes()
                words = [raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
                rows: tuple[list, list] = ([], [])
                for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    for s in range(a, max(b - size, a) + 1) if b > a else ():
                        rows[0].append(ids[lo + i] or "")
                        rows[1].append(b"\0".join(words[s : min(s + size, b)]))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.binary())], names=["item_id", "window"])

    return run


def _running(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial of the hashes, and the inverse powers that make a difference of two a stretch's own hash."""
    up, down = _powers_to(len(hashes) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)]), down


class Lookup:
    """Positions of hashes in a sorted set, with a bitmap in front that most words fail."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[keys & np.uint64((1 << _BITS) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into hashes, indices into keys) of the hashes that are keys."""
        at = np.flatnonzero(self.bitmap[hashes & np.uint64((1 << _BITS) - 1)])
        slot = np.searchsorted(self.keys, hashes[at])
        slot[slot == len(self.keys)] = 0
        hit = self.keys[slot] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[hit], slot[hit]


def _build(base: str):
    """Write each part's windows: numbers, words and the words' bytes. Rows: part, number, window, sorted."""

    def run(batches):
        for t in groups(batches, 1):
            part = t.column("part")[0].as_py()
            windows = [x.split(b"\0") for x in t.column("window").to_pylist()]
            vocabulary = sorted({w for x in windows for w in x})
            hashes = word_hashes(vocabulary)
            order = np.argsort(hashes, kind="stable")
            place = dict(zip((vocabulary[i] for i in order.tolist()), range(len(order)), strict=True))
            length = np.array([len(x) for x in windows], np.int64)
            words = np.zeros((len(windows), int(length.max())), np.int32)
            for i, x in enumerate(windows):
                words[i, : len(x)] = [place[w] for w in x]
            ends = np.cumsum([len(w) for w in place], dtype=np.int64)
            write_arrays(base, f"windows-{part}", [t.column("number").to_numpy(), length, words.reshape(-1), hashes[order], np.concatenate([[0], ends]), np.frombuffer(b"".join(place), np.uint8)])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64())})

    return run


class Part:
    """A part of the index, mapped from its files: windows and, once written, their occurrences by rarest word."""

    def __init__(self, base: str, part: int):
        self.number, self.length, words, self.hashes, self.offsets, self.bytes = mapped_arrays(base, f"windows-{part}")
        self.words = words.reshape(len(self.length), -1)
        self.keys = np.unique(self.hashes)

    def whole(self) -> np.ndarray:
        """A hash of each window as a whole, as _stretches() gives it."""
        up = _powers_to(self.words.shape[1] + 1)[0]
        out = np.zeros(len(self.length), np.uint64)
        for j in range(self.words.shape[1]):
            out += np.where(self.length > j, self.hashes[self.words[:, j]] * up[j], np.uint64(0))
        return mix(out + self.length.astype(np.uint64))

    def ranked(self, base: str, part: int) -> Part:
        keys, self.begin, self.count, self.place, self.span, self.offset, self.sorted, self.order = mapped_arrays(base, f"rarest-{part}")
        self.lookup = Lookup(keys)
        return self

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(start words, windows) of every occurrence within one document of a block.

        Where a word occurs, the windows that it is the rarest word of can begin at a few places only, by its place in them
        and their length; a hash of the words from there tells the window, however many share the word.
        """
        at, key = self.lookup.find(w.hashes)
        sums, down = _running(w.hashes)
        none = np.zeros(0, np.int64)
        found = [(none, none)]
        for lo in range(0, len(at), _SLICE):
            pos, own = at[lo : lo + _SLICE], key[lo : lo + _SLICE]
            n = self.count[own]
            which = np.repeat(self.begin[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(pos, n)
            place, span = self.place[which], self.span[which]
            start = pos - place
            doc = np.searchsorted(w.first, pos, side="right") - 1
            fits = (start >= w.first[doc]) & (start + span <= w.first[doc + 1])
            start, span, place = start[fits], span[fits], place[fits]
            told = mix((sums[start + span] - sums[start]) * down[start] + span.astype(np.uint64))
            first, last = np.searchsorted(self.sorted, told, "left"), np.searchsorted(self.sorted, told, "right")
            n = last - first
            window = self.order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            start, span, place = (np.repeat(x, n) for x in (start, span, place))
            # a window is found by its own rarest word, so once
            same = (self.offset[window] == place) & (self.length[window] == span)
            found.append(self._same_bytes(w, *self._same_words(w, start[same], window[same])))
        start, window = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, window

    def _same_words(self, w: Words, start: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for j in range(self.words.shape[1]):
            short = self.length[window] <= j
            same = short | (w.hashes[np.where(short, 0, start + j)] == self.hashes[self.words[window, j]])
            start, window = start[same], window[same]
        return start, window

    def _same_bytes(self, w: Words, start: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose words are the same, byte by byte; each word of the block is compared once."""
        if not len(start):
            return start, window
        n = self.length[window]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs, back = np.unique(np.repeat(start, n) + step << 32 | self.words[np.repeat(window, n), step], return_inverse=True)
        pos, word = pairs >> 32, pairs & 0xFFFFFFFF
        begin, size, own = w.starts[pos], w.ends[pos] - w.starts[pos], self.offsets[word]
        equal = size == self.offsets[word + 1] - own
        size = np.where(equal, size, 0)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = w.data[np.repeat(begin, size) + step] != self.bytes[np.repeat(own, size) + step]
        equal &= np.bincount(np.repeat(np.arange(len(size)), size), differ, len(size)) == 0
        good = np.logical_and.reduceat(equal[back], np.cumsum(n) - n)
        return start[good], window[good]


_open: tuple[tuple, list[Part]] = ((), [])


def _parts(base: str, parts: int, ranked: bool) -> list[Part]:
    """All parts of an index; the worker keeps them open from task to task."""
    global _open
    if _open[0] != (base, ranked):
        opened = [Part(base, i) for i in range(parts)]
        _open = (base, ranked), [p.ranked(base, i) for i, p in enumerate(opened)] if ranked else opened
    return _open[1]


def _counts(base: str, parts: int):
    """Occurrences of the index's words in a partition of documents; rows of place -1 name every part."""

    def run(batches):
        open_ = _parts(base, parts, False)
        looks = [Lookup(p.keys) for p in open_]
        n = [np.zeros(len(x.keys), np.int64) for x in looks]
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                hashes = split(data, offsets, _INWORD).hashes
                for look, own in zip(looks, n, strict=True):
                    own += np.bincount(look.find(hashes)[1], minlength=len(own))
        for part, own in enumerate(n):
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int64)), pa.array(at), pa.array(own[at])], names=["part", "place", "n"])

    return run


def _rank(base: str, parts: int):
    """Write each part's windows by their rarest word. Rows: part, place of a word, its count; sorted by part."""

    def run(batches):
        for t in groups(batches, 1):
            part = t.column("part")[0].as_py()
            p = _parts(base, parts, False)[part]
            place, n = t.column("place").to_numpy(), t.column("n").to_numpy()
            counts = np.zeros(len(p.keys), np.int64)
            counts[place[place >= 0]] = n[place >= 0]
            own = counts[np.searchsorted(p.keys, p.hashes)][p.words]
            own[np.arange(own.shape[1]) >= p.length[:, None]] = np.iinfo(np.int64).max
            offset = own.argmin(axis=1)
            rarest = p.hashes[p.words[np.arange(len(offset)), offset]]
            # of each word, the places it has in its windows, with their lengths: at most 55 pairs of ten and fewer
            keys, number = np.unique(rarest, return_inverse=True)
            width = own.shape[1] + 1
            forms = np.unique((number * width + offset) * width + p.length)
            begin = np.searchsorted(forms, np.arange(len(keys)) * width * width)
            count = np.diff(np.concatenate([begin, [len(forms)]]))
            whole = p.whole()
            order = np.argsort(whole, kind="stable")
            write_arrays(base, f"rarest-{part}", [keys, begin, count, forms // width % width, forms % width, offset, whole[order], order])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64())})

    return run


def _hits(base: str, parts: int):
    def run(batches):
        open_ = _parts(base, parts, True)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                w = split(data, offsets, _INWORD)
                spans: list = [[] for _ in range(hi - lo)]
                numbers: list = [[] for _ in range(hi - lo)]
                start, length, number = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*([s, p.length[k], p.number[k]] for p in open_ for s, k in [p.find(w)]), strict=True)) if open_ else [np.zeros(0, np.int64)] * 3
                doc = np.searchsorted(w.first, start, side="right") - 1
                order = np.lexsort((number, start, doc))
                found: dict[int, set] = {}
                for d, s, n, k in zip(doc[order].tolist(), start[order].tolist(), length[order].tolist(), number[order].tolist(), strict=True):
                    a = s - int(w.first[d])
                    own = spans[d]
                    if own and own[-1]["end"] >= a:
                        own[-1]["end"] = max(own[-1]["end"], a + n)
                    else:
                        own.append({"start": a, "end": a + n})
                    found.setdefault(d, set()).add(k)
                for d, x in found.items():
                    numbers[d] = sorted(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first)), pa.array(spans, _SPANS), pa.array(numbers, _NUMBERS), *(batch.column(k).slice(lo, hi - lo) for k in range(2, batch.num_columns))], names=["doc_id", "n_words", "spans", "windows", *batch.schema.names[2:]])

    return run


def _index(docs: DataFrame, items: DataFrame, window: int, part: int) -> tuple[str, int, DataFrame]:
    """(folder of the index's files, parts, item_id of every number): words are ranked by their counts in docs."""
    spark = docs.sparkSession
    held = stored(items.select("item_id", "text").mapInArrow(_windows(window), "item_id string, window binary").distinct(), "windows")
    distinct = stored(held.select("window").distinct().withColumn("number", F.monotonically_increasing_id()), "distinct")
    parts = -(-distinct.count() // part)
    base = new_path(spark, "index")
    if parts:
        dealt = distinct.select(F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part"), "number", "window")
        dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "window")
        built = sorted(r.part for r in dealt.mapInArrow(_build(base), "part long").collect())
        if built != list(range(parts)):
            # hardly any windows to a part: one part of them all
            parts = 1
            dealt = distinct.select(F.lit(0).cast("long").alias("part"), "number", "window").repartition(1).sortWithinPartitions("window")
            dealt.mapInArrow(_build(base), "part long").collect()
        counted = docs.select("text").mapInArrow(_counts(base, parts), "part long, place long, n long").groupBy("part", "place").agg(F.sum("n").alias("n"))
        every = spark.range(parts).select(F.col("id").alias("part"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"))
        counted = counted.unionByName(every).repartition(parts, "part").sortWithinPartitions("part")
        counted.mapInArrow(_rank(base, parts), "part long").collect()
    return base, parts, held.join(distinct, "window").select("number", "item_id")


def _looked_up(docs: DataFrame, base: str, parts: int) -> DataFrame:
    """doc_id, n_words, spans, windows (their numbers), and a column `row`, if docs has one."""
    carried = ["row"] if "row" in docs.columns else []
    row_type = f", row {docs.schema['row'].dataType.simpleString()}" if carried else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried).mapInArrow(_hits(base, parts), _HITS + row_type)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    base, parts, _ = _index(docs, items, window, part)
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in names]).alias("row"))
    return _looked_up(packed, base, parts).filter("size(windows) = 0").select(*[F.col("row")[c].alias(c) for c in names])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged hit word ranges), items (ids found), n_hit."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    base, parts, numbered = _index(docs, items, window, part)
    found = stored(_looked_up(docs, base, parts), "hits")
    delete(docs.sparkSession, base)
    # what documents hold is named once for each set of windows
    sets = found.filter("size(windows) > 0").select("windows").distinct()
    named = sets.select("windows", F.explode("windows").alias("number")).join(numbered, "number").groupBy("windows").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    some = found.filter("size(windows) > 0").join(named, "windows").select("doc_id", "n_words", "spans", "items")
    none = found.filter("size(windows) = 0").select("doc_id", "n_words", "spans", F.array().cast("array<string>").alias("items"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return some.unionByName(none).select("doc_id", "n_words", "spans", "items", covered.alias("n_hit"))
