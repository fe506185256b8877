"""N-gram language model in an Elias-Fano trie, trained and queried on all executors.

Level 1 is the vocabulary: sorted 64-bit word hashes with exact counts. A level k > 1 lists, for each
n-gram of level k-1 as context, the words that follow it: a monotone Elias-Fano sequence of pointers
gives each context's range, and the words are stored relative to their context (on top of the last
value before its range), so that all ranges together form one monotone sequence and the successor
search for base + word lands in the context's own range. An n-gram's place is its index, which is
its context number on the next level. Probabilities are interpolated Witten-Bell estimates, kept
with back-off weights as 16-bit steps of log10.

Ranks and selections in the bit sequences go by a directory of every 256 bits, which is kept in the
files too: what a worker maps stays in the page cache, not in its heap.

Nothing is pruned, so the model grows with the corpus. It is cut into shards by hash (level 1) and by
range of contexts (above), written to the shared folder by the tasks that build them and mapped
into memory by the tasks that score; neither the driver nor any task holds the model. A repeated
task writes the same bytes under the same name.

Defined results: null texts count as empty, and an empty text is one end token; rows that share a
doc_id, repeated rows included, are trained and scored each; a null doc_id isn't held out and is scored;
texts of any length are read whole; with nothing to train on, every token is unknown (N = V = 0,
probability 1), and an empty table gives no rows; n-grams of equal counts are all kept. Columns of
other names are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._files import mapped_arrays, write_arrays
from ._groups import gathered, groups
from ._tables import bound_batches, new_path
from ._words import Words, blocks, mix, split

ORDER = 3
ENTRIES = 1 << 22  # tokens for each shard of a level, where that makes more shards than tasks
_RANK = 256  # bits for each entry of the rank directories
_BIG = 64  # values of a bucket that is large
STEP = 32 / 65535  # of a quantised log10 probability
BLOCK = 4 << 20  # bytes of text handled together
END = int(mix(np.array([0x5EED], np.uint64))[0])  # the end token's hash; also the context of a first word


# --- Elias-Fano ---------------------------------------------------------------------------------


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bits of each value, little-endian, with room for reads of 8 bytes."""
    out = []
    for i in range(0, len(values) if width else 0, 1 << 16):  # 2**16 * width bits are whole bytes
        bits = (values[i : i + (1 << 16), None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
        out.append(np.packbits(bits.reshape(-1), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


_ONES = np.uint64(0x0101010101010101)
_FLIP = np.uint64(0xFFFFFFFFFFFFFFFF)
_TOPS = np.uint64(0x8080808080808080)


def _select_table() -> np.ndarray:
    """Place of the one of each rank in each byte, by rank * 256 + byte."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    rank = np.cumsum(bits, axis=1) - 1
    out = np.zeros((8, 256), np.int64)
    byte, place = np.nonzero(bits)
    out[rank[byte, place], byte] = place
    return out.reshape(-1)


_IN_BYTE = _select_table()


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the one of that rank (from 0) in each 64-bit word: its byte by sums of all bytes at once, then a table."""
    s = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = (((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES)
    k = rank.astype(np.uint64)
    place = np.bitwise_count((((k * _ONES) | _TOPS) - s) & _TOPS).astype(np.uint64) << np.uint64(3)
    k -= ((s << np.uint64(8)) >> place) & np.uint64(0xFF)
    return place.astype(np.int64) + _IN_BYTE[((words >> place) & np.uint64(0xFF) | k << np.uint64(8)).astype(np.int64)]


class EliasFano:
    """A sorted sequence of integers below 2**64; all lookups take and return arrays."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros
        self.last = int(zeros[-1])
        self.read = np.ndarray((max(1, len(low) - 7),), "<u8", low, strides=(1,)) if len(low) >= 8 else None
        self.mask = np.uint64((1 << width) - 1)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = -(-(int(high[-1]) + 2 if n else 1) // _RANK) * _RANK
        bits = np.zeros(size, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        # a directory of the ones and zeros before every _RANK bits
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, _RANK // 64).sum(axis=1, dtype=np.int64))])
        return cls(n, width, _packed(values, width), words, ones, np.arange(len(ones), dtype=np.int64) * _RANK - ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *(np.asarray(x) for x in parts[1:]))

    def _at(self, block: np.ndarray, rank: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Position of the one (or zero, with all bits flipped) of that rank in each block of the directory."""
        out = np.empty(len(block), np.int64)
        for i in range(0, len(block), 1 << 15):
            b, r = block[i : i + (1 << 15)], rank[i : i + (1 << 15)]
            words = self.high.reshape(-1, _RANK // 64)[b] ^ flip
            bits, small = np.bitwise_count(words), r.astype(np.uint8)  # a block's sums but the last fit in a byte
            word, before = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
            sums = np.zeros(len(b), np.uint8)
            for k in range(_RANK // 64 - 1):
                sums += bits[:, k]
                beyond = (sums <= small).view(np.uint8)
                word += beyond
                before += bits[:, k] * beyond
            at = np.arange(0, words.size, _RANK // 64) + word
            out[i : i + (1 << 15)] = b * _RANK + word.astype(np.int64) * 64 + _select(words.reshape(-1)[at], small - before)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        return (self.read[at >> 3] >> (at & 7).view(np.uint64)) & self.mask

    def _one(self, i: np.ndarray) -> np.ndarray:
        """Position of the one of this rank."""
        block = np.searchsorted(self.ones, i, side="right") - 1
        return self._at(block, i - self.ones[block], np.uint64(0))

    def _value(self, i: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return ((pos - i).view(np.uint64) << np.uint64(self.width)) | self._low(i)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at these places."""
        return self._value(i, self._one(i))

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at these places and at the next ones, which must be there too."""
        pos = self._one(i)
        # the next one is mostly in the same word
        word = pos >> 6
        rest = self.high[word] & (_FLIP << (pos & 63).view(np.uint64) << np.uint64(1))
        after = (word << 6) + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(rest == 0)
        after[far] = self._one(i[far] + 1)
        return self._value(i, pos), self._value(i + 1, after)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the zero of this rank."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        return self._at(block, k - self.zeros[block], _FLIP)

    def _bucket(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values of this high part: from, to. Beyond the last one both are n."""
        k = np.minimum(bucket, self.last) - 1
        pos = self._zero(np.maximum(k, 0))
        pos[k < 0] = -1
        lo = np.minimum(self.n, pos - k)
        # its values are the ones up to the next zero, mostly in the same word
        word = np.minimum(pos + 1 >> 6, len(self.high) - 1)
        rest = (self.high[word] ^ _FLIP) >> (pos + 1 & 63).astype(np.uint64)
        hi = lo + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero((rest == 0) & (bucket < self.last))
        hi[far] = self._zero(bucket[far]) - bucket[far]
        return lo, np.where(bucket >= self.last, self.n, np.minimum(hi, self.n))

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value that is at least x, the successor, or n; whether it is x itself)."""
        x = x.astype(np.uint64)
        bucket = np.minimum(x >> np.uint64(self.width), np.uint64(self.last + 1)).astype(np.int64)
        (lo, hi), want = self._bucket(bucket), x & self.mask
        end, beyond = hi.copy(), bucket > self.last
        # low parts of a large bucket are mostly spread evenly; the place is sought near the one that this gives
        big = np.flatnonzero(hi - lo > _BIG)
        if len(big):
            a, z, x = lo[big], hi[big] - 1, want[big]
            n = (z - a).astype(np.float64)
            guess = a + (x * (n / 2.0**self.width)).astype(np.int64)
            off = np.sqrt(n).astype(np.int64)
            left, right = np.maximum(guess - off, a), np.minimum(guess + off, z)
            above, beneath = self._low(left) < x, self._low(right) >= x
            lo[big] = np.where(beneath, np.where(above, left + 1, a), right + 1)
            hi[big] = np.where(beneath, np.where(above, right, left), z + 1)
        at = np.flatnonzero(lo < hi)
        a, z, x = lo[at], hi[at], want[at]
        while len(at):
            mid = (a + z) >> 1
            less = (self._low(mid) < x) & (a < z)
            a = np.where(less, mid + 1, a)
            z = np.where(less, z, mid)
            more = a < z
            if 4 * np.count_nonzero(more) < 3 * len(at):
                lo[at] = a
                at, a, z, x = at[more], a[more], z[more], x[more]
        # a value of the same bucket has the same high part
        same = (lo < end) & ~beyond
        some = np.flatnonzero(same)
        same[some] = self._low(lo[some]) == want[some]
        return np.where(beyond, self.n, lo), same


def _backed_off(index: np.ndarray, code: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 probabilities of what step() gives, from those of the level below."""
    logs = code * -STEP
    return np.where(index >= 0, logs, logs + lower)


def _code(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / STEP), 0, 65535).astype(np.uint16)


# --- the trie -------------------------------------------------------------------------------------


class Trie:
    """Levels by shard, opened when first asked for. sizes[k]: entries of each shard of level k+1."""

    def __init__(self, base: str, sizes: list[list[int]], total: int):
        self.base, self.total = base, total
        self.sizes = [np.array(s, np.int64) for s in sizes]
        self.begins = [np.concatenate([[0], np.cumsum(s)]) for s in self.sizes]
        self.vocabulary = int(self.begins[0][-1]) if sizes else 0
        self.open: dict[tuple[int, int], tuple] = {}

    @property
    def shards(self) -> int:
        return len(self.sizes[0])

    def per_shard(self, level: int, shards: int = 0) -> int:
        """Contexts of a shard of this level (from 2), which is to have this many shards if it isn't built."""
        return max(1, -(-int(self.begins[level - 2][-1]) // (shards or len(self.sizes[level - 1]))))

    def unknown(self) -> float:
        """Probability of a word that training hasn't seen."""
        v = self.vocabulary
        return v / (v + 1) / (self.total + v) if self.total else 1.0

    def words(self, shard: int) -> tuple[EliasFano, np.ndarray]:
        if (1, shard) not in self.open:
            *words, counts = mapped_arrays(self.base, f"1-{shard}")
            self.open[1, shard] = EliasFano.of(words), np.asarray(counts)
        return self.open[1, shard]

    def level(self, k: int, shard: int) -> tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]:
        """(pointers, words relative to contexts, back-off weights, probabilities)."""
        if (k, shard) not in self.open:
            a = mapped_arrays(self.base, f"{k}-{shard}")
            self.open[k, shard] = EliasFano.of(a[:5]), EliasFano.of(a[5:10]), np.asarray(a[10]), np.asarray(a[11])
        return self.open[k, shard]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for shard, at in _by_shard(shard_of(hashes, self.shards)):
            if not self.sizes[0][shard]:
                continue
            ef, c = self.words(shard)
            i, hit = ef.find(hashes[at] - shard_start(shard, self.shards))
            ids[at[hit]] = self.begins[0][shard] + i[hit]
            counts[at[hit]] = c[i[hit]]
        return ids, counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 Witten-Bell probabilities, over a uniform one for V + 1 words."""
        v = self.vocabulary
        return np.log10((counts + v / (v + 1)) / (self.total + v)) if self.total else np.zeros(len(counts))

    def step(self, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index on level k or -1, code of its log10 probability, or of the log10 back-off weight where it is -1) of words after contexts of level k-1; those of -1 are unseen."""
        # index and code together, so that one array is put back in order
        found = np.full(len(word), -1 << 16, np.int64)
        known = np.flatnonzero(context >= 0)
        if not len(known):
            return found >> 16, found & 0xFFFF
        # each pair, and each context's range, is sought once, in order
        order, pair, c, w = _distinct(context[known], word[known])
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
        own = np.full(len(c), -1 << 16, np.int64)
        size = self.per_shard(k)
        for shard, at in _by_shard(c[first] // size):
            if not self.sizes[k - 1][shard]:
                continue
            lo, hi = int(first[at[0]]), int(first[at[-1] + 1]) if at[-1] + 1 < len(first) else len(c)
            pointers, words, backs, probs = self.level(k, shard)
            local = c[first[at]] - shard * size
            p0, p1 = (x.view(np.int64) for x in pointers.pairs(local))
            base = np.zeros(len(local), np.uint64)
            after = p0 > 0
            base[after] = words.get(p0[after] - 1)
            mine = of[lo:hi] - at[0]
            some = p0 < p1
            own[lo:hi] |= np.where(some, backs[local], np.uint16(0))[mine]
            seek = np.flatnonzero(some[mine] & (w[lo:hi] >= 0))
            mine = mine[seek]
            i, same = words.find(base[mine] + w[lo:hi][seek].view(np.uint64) + np.uint64(1))
            hit = np.flatnonzero(same & (i < p1[mine]))
            i = i[hit]
            own[lo + seek[hit]] = self.begins[k - 1][shard] + i << 16 | probs[i]
        found[known[order]] = own[pair]
        return found >> 16, found & 0xFFFF


def _distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of sorted pairs, number of each's distinct pair, distinct contexts and words); words may be -1."""
    if max(int(context.max()), int(word.max())) < (1 << 31) - 1:
        key = context << 32 | word + 1
        order = np.argsort(key)
        key = key[order]
        cut = np.concatenate([[True], key[1:] != key[:-1]])
        key = key[cut]
        return order, np.cumsum(cut) - 1, key >> 32, (key & 0xFFFFFFFF) - 1
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    cut = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
    return order, np.cumsum(cut) - 1, c[cut], w[cut]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_start(shard: int, shards: int) -> np.uint64:
    return np.uint64(-(-(shard << 32) // shards) << 32)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of a sorted array of shards."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for at in np.split(np.arange(len(shard)), cuts) if len(shard) else ():
        yield int(shard[at[0]]), at


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with one end after each text, place of each text's first token)."""
    texts = len(w.first) - 1
    first = w.first + np.arange(texts + 1)
    out = np.full(len(w.hashes) + texts, END, np.uint64)
    ends = np.zeros(len(out), bool)
    ends[first[1:] - 1] = True
    out[~ends] = w.hashes
    return out, first


def _walk(trie: Trie, hashes: np.ndarray, first: np.ndarray, order: int):
    """Per token: (count, log10 probability, context and word on the last level)."""
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = trie.word_ids(distinct)
    word, count = ids[back], counts[back]
    logp = trie.unigram(counts)[back]
    end = ids[np.searchsorted(distinct, np.uint64(END))] if len(distinct) else -1
    starts = np.zeros(len(hashes), bool)
    starts[first[:-1]] = True
    index = context = word
    for k in range(2, order + 1):
        context = np.empty(len(word), np.int64)
        context[1:] = index[:-1]
        # the end stands before a text; longer contexts don't reach beyond it
        context[starts] = end if k == 2 else -1
        if k > len(trie.sizes):
            break
        index, code = trie.step(k, context, word)
        logp = _backed_off(index, code, logp)
    return count, logp, context, word


# --- training -------------------------------------------------------------------------------------


def _merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[cut], np.add.reduceat(c, cut) if len(cut) else c


def _squeeze(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _expand(t: pa.Table, name: str, dtype) -> list[np.ndarray]:
    sizes = t.column(name + "_size").to_pylist()
    return [np.frombuffer(pa.decompress(x.as_buffer(), n, codec="zstd"), dtype) for x, n in zip(t.column(name), sizes, strict=True)]


_KEPT = 1 << 22  # distinct entries a task holds before it passes them on


def _count_words(shards: int):
    def out(keys, counts):
        keys, counts = _merge_counts(keys, counts)
        for shard, at in _by_shard(shard_of(keys, shards)):
            k = np.diff(keys[at], prepend=np.uint64(0))
            c = counts[at].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "a": [k.tobytes()], "b": [_squeeze(c)], "b_size": pa.array([c.nbytes], pa.int64())})

    def run(batches):
        keys, counts, n = [], [], 0
        for batch in gathered(batches, BLOCK):
            for _, _, data, offsets in blocks(batch.column(0), BLOCK):
                k, c = np.unique(_tokens(split(data, offsets))[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                n += len(k)
                if n > _KEPT:
                    keys, counts = ([x] for x in _merge_counts(keys, counts))
                    if (n := len(keys[0])) > _KEPT // 2:
                        yield from out(keys, counts)
                        keys, counts, n = [], [], 0
        if keys:
            yield from out(keys, counts)

    return run


def _build_words(base: str, shards: int):
    def run(batches):
        for t in groups(batches, 1):
            shard = t.column("shard")[0].as_py()
            keys = [np.cumsum(np.frombuffer(x.as_buffer(), np.uint64), dtype=np.uint64) for x in t.column("a")]
            keys, counts = _merge_counts(keys, _expand(t, "b", np.int64))
            write_arrays(base, f"1-{shard}", [*EliasFano.build(keys - shard_start(shard, shards)).parts(), counts])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    return run


def _pairs(trie_of, k: int, shards: int):
    """Counted (context, word) pairs of level k, by shard of the context."""

    def out(size, keys, counts):
        keys, counts = _merge_counts(keys, counts)
        context, word = (keys["f0"], keys["f1"]) if keys.dtype.names else (keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF))
        context, word = context.astype(np.int64), word.astype(np.int64)
        for shard, at in _by_shard(context // size):
            a = np.diff(context[at] - shard * size, prepend=0).astype(np.uint32)
            b, c = word[at], counts[at].astype(np.uint32)
            b = b.astype(np.uint32) if not len(b) or b.max() < 1 << 32 else b
            parts = {"a": a, "b": b, "c": c}
            row = {"shard": pa.array([shard], pa.int64()), "wide": pa.array([int(b.itemsize == 8)], pa.int64())}
            yield pa.RecordBatch.from_pydict(row | {n: [_squeeze(x)] for n, x in parts.items()} | {n + "_size": pa.array([x.nbytes], pa.int64()) for n, x in parts.items()})

    def run(batches):
        trie = trie_of()
        size, keys, counts, n = trie.per_shard(k, shards), [], [], 0
        narrow = trie.begins[k - 2][-1] < 1 << 32 and trie.vocabulary < 1 << 32
        for batch in gathered(batches, BLOCK):
            for _, _, data, offsets in blocks(batch.column(0), BLOCK):
                hashes, first = _tokens(split(data, offsets))
                context, word = _walk(trie, hashes, first, k)[2:]
                ok = context >= 0
                context, word = context[ok].astype(np.uint64), word[ok].astype(np.uint64)
                pair = context << np.uint64(32) | word if narrow else np.rec.fromarrays([context, word])
                u, c = np.unique(pair, return_counts=True)
                keys.append(np.asarray(u))
                counts.append(c)
                n += len(u)
                if n > _KEPT:
                    yield from out(size, keys, counts)
                    keys, counts, n = [], [], 0
        if keys:
            yield from out(size, keys, counts)

    return run


def _build_level(base: str, trie_of, k: int, shards: int):
    def run(batches):
        trie = trie_of()
        size = trie.per_shard(k, shards)
        for t in groups(batches, 1):
            shard = t.column("shard")[0].as_py()
            contexts = min(size, int(trie.begins[k - 2][-1]) - shard * size)
            wide = t.column("wide").to_pylist()
            context = np.concatenate([np.cumsum(x, dtype=np.int64) for x in _expand(t, "a", np.uint32)])
            sizes = t.column("b_size").to_pylist()
            word = np.concatenate([np.frombuffer(pa.decompress(x.as_buffer(), n, codec="zstd"), np.int64 if w else np.uint32).astype(np.int64) for x, n, w in zip(t.column("b"), sizes, wide, strict=True)])
            count = np.concatenate(_expand(t, "c", np.uint32)).astype(np.int64)
            # counts of equal pairs are summed, in any order
            narrow = contexts < 1 << 31 and trie.vocabulary < 1 << 32
            order = np.argsort(context << 32 | word) if narrow else np.lexsort((word, context))
            context, word, count = context[order], word[order], count[order]
            cut = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
            context, word, count = context[cut], word[cut], np.add.reduceat(count, cut)
            kinds = np.bincount(context, minlength=contexts)
            total = np.bincount(context, weights=count, minlength=contexts)
            pointers = np.concatenate([[0], np.cumsum(kinds)])
            # relative to the context: on top of the last value before its range
            used = np.flatnonzero(kinds)
            tops = word[pointers[used + 1] - 1] + 1
            base_of = np.zeros(contexts, np.int64)
            base_of[used] = np.cumsum(tops) - tops
            lower = trie.lower(k, shard * size + context, word)
            p = (count + kinds[context] * 10**lower) / (total[context] + kinds[context])
            back = np.log10(kinds / np.maximum(1, total + kinds), where=kinds > 0, out=np.zeros(contexts))
            write_arrays(base, f"{k}-{shard}", [*EliasFano.build(pointers).parts(), *EliasFano.build(base_of[context] + word + 1).parts(), _code(back), _code(np.log10(p))])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(word)], pa.int64()), "total": pa.array([int(count.sum())], pa.int64())})

    return run


def _trie_of(base: str, sizes: list[list[int]], total: int):
    """Makes the worker's trie; it stays open from task to task of one model and level."""

    def get() -> Trie:
        global _opened
        key = (base, len(sizes))
        if _opened is None or _opened[0] != key:
            _opened = key, BuiltTrie(base, sizes, total)
        return _opened[1]

    return get


_opened: tuple | None = None


class BuiltTrie(Trie):
    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted word ids."""
        out = np.zeros(len(ids), np.int64)
        for shard, at in _by_shard(np.searchsorted(self.begins[0], ids, side="right") - 1):
            out[at] = self.words(shard)[1][ids[at] - self.begins[0][shard]]
        return out

    def last_words(self, k: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context on level k-1, word) of sorted indices of level k > 1."""
        context, word = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        for shard, at in _by_shard(np.searchsorted(self.begins[k - 1], index, side="right") - 1):
            pointers, words, _, _ = self.level(k, shard)
            i = index[at] - self.begins[k - 1][shard]
            c = pointers.find(i.astype(np.uint64) + np.uint64(1))[0] - 1
            p0 = pointers.get(c).astype(np.int64)
            base = np.zeros(len(i), np.uint64)
            base[p0 > 0] = words.get(p0[p0 > 0] - 1)
            word[at] = (words.get(i) - base).astype(np.int64) - 1
            context[at] = c + shard * self.per_shard(k)
        return context, word

    def shorter(self, k: int, index: np.ndarray) -> np.ndarray:
        """Level k index -> level k-1 index of the n-gram without its first word, -1 if unseen. k > 1"""
        distinct, back = np.unique(index, return_inverse=True)
        context, word = self.last_words(k, distinct)
        if k == 2:
            return word[back]
        return self.step(k - 1, self.shorter(k - 1, context), word)[0][back]

    def lower(self, k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of words after contexts (of level k-1) less their first word."""
        if k == 2:
            ids, back = np.unique(word, return_inverse=True)
            return self.unigram(self.counts_of(ids))[back]
        short = self.shorter(k - 1, context)
        return _backed_off(*self.step(k - 1, short, word), self.lower(k - 1, short, word))


def train(docs: DataFrame, order: int = ORDER, shards: int | None = None) -> tuple[str, list[list[int]], int]:
    """(folder, entries of each level's shards, tokens): the model of docs.text, as score() takes it."""
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = new_path(spark, "lm")
    text = docs.select("text")

    def built(rows: DataFrame, build, n: int) -> tuple[list[int], int]:
        done = rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, n long, total long").collect()
        sizes = [0] * n
        for r in done:
            sizes[r.shard] = r.n
        return sizes, sum(r.total for r in done)

    sizes, total = built(text.mapInArrow(_count_words(shards), "shard long, a binary, b binary, b_size long"), _build_words(base, shards), shards)
    model = base, [sizes], total
    for k in range(2, order + 1):
        if not total:
            break
        trie_of = _trie_of(*model)
        of_level = max(shards, -(-total // ENTRIES))
        rows = text.mapInArrow(_pairs(trie_of, k, of_level), "shard long, wide long, a binary, b binary, c binary, a_size long, b_size long, c_size long")
        more, _ = built(rows, _build_level(base, trie_of, k, of_level), of_level)
        model = base, [*model[1], more], total
    return model


def _scores(trie_of, order: int):
    def run(batches):
        trie = trie_of()
        n, v = trie.total, trie.vocabulary
        for batch in gathered(batches, BLOCK):
            for lo, hi, data, offsets in blocks(batch.column(1), BLOCK):
                hashes, first = _tokens(split(data, offsets))
                count, logp, *_ = _walk(trie, hashes, first, order)
                base = np.log10((count + 1) / (n + v + 1))
                sums = [np.add.reduceat(x, first[:-1]) for x in (base, logp)]
                known = np.add.reduceat((count > 0).astype(np.int64), first[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(hi - lo, n)), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: tuple[str, list[list[int]], int]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every text."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scores(_trie_of(*model), len(model[1])), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))
