"""Byte-level BPE encoding by the ranks of a vocabulary file, and decoding.

Text is first split by the tokenizer's pattern. Whole pre-tokens that are in the vocabulary are
resolved by a minimal perfect hash (hash and displace: one slot per token, one comparison). The
others start as linked bytes; a heap hands out the adjacent pair of lowest rank, leftmost first,
until no pair is in the vocabulary, so a piece of n bytes costs n log n however long it is.

No pre-token crosses the place before a space that a visible character follows, and none depends on
what lies beyond it. The stretches between such places repeat often, so a bounded memo holds the
ids of the latest distinct ones.

Defined results: null texts count as empty and give no ids; ids come as little-endian unsigned
32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bound_batches

MEMO = 350_000  # stretches remembered by a worker, about
_M = (1 << 64) - 1
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOOSE = re.compile(r" (?!\S)").search  # a space that no visible character follows
_STRETCH = re.compile(r" (?=\S)").split


def load_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: bucket by hash, displace until no clash."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        taken = bytearray(n)
        self.slot_key: list[bytes] = [b""] * n
        self.slot_value = [0] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            d = 0
            while group:
                slots = {self._slot(hashes[i], d) for i in group}
                if len(slots) == len(group) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i in group:
                s = self._slot(hashes[i], d)
                taken[s] = 1
                self.slot_key[s], self.slot_value[s] = keys[i], i

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _M
        return (x >> 29) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        x = (h ^ (self.shift[h % self.buckets] * 0x9E3779B97F4A7C15)) & _M
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _M
        s = (x >> 29) % self.n
        return self.slot_value[s] if self.slot_key[s] == key else -1


def token_pairs(tokens: list[bytes]) -> dict[int, int]:
    """Rank of what two tokens make together, by their ranks in 20 bits each."""
    rank = {t: i for i, t in enumerate(tokens)}
    halves = ((rank.get(t[:k]), rank.get(t[k:]), r) for r, t in enumerate(tokens) for k in range(1, len(t)))
    return {a << 20 | b: r for a, b, r in halves if a is not None and b is not None}


class Memo(dict):
    """Ids of stretches, which follow one space; computed when first asked for.

    A word with punctuation behind it is put together from the word and the punctuation, which are
    pre-tokens of their own, so that each word takes one place. When half of the room is taken, what was
    not asked for since the last such time goes.
    """

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.tails: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, stretch: str) -> bytes:
        if (ids := self.older.get(stretch)) is not None:
            self[stretch] = ids
            return ids
        word = stretch.rstrip(_PUNCTUATION)
        if word and len(word) < len(stretch) and word.isalpha() and max(word) < "\u0250":
            tail = stretch[len(word) :]
            if (ids := self.tails.get(tail)) is None:
                ids = self.encoder.pieces(tail)
                if len(tail) <= 3:
                    self.tails[tail] = ids
            return self[word] + ids
        ids = self.encoder.pieces(" " + stretch)
        return self.keep(stretch, ids) if "\n" not in stretch else ids

    def keep(self, stretch: str, ids: bytes) -> bytes:
        if len(stretch) <= 64:
            if len(self) >= MEMO // 2:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str, hash_: PerfectHash | None = None, pairs: dict[int, int] | None = None):
        self.hash = hash_ or PerfectHash(tokens)
        self.find = regex.compile(pattern).findall
        self.single = [self.hash.get(bytes([b])) for b in range(256)]
        self.pairs = pairs or token_pairs(tokens)
        self.memo = Memo(self)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece that isn't one token: linked bytes, and a heap of the pairs to merge."""
        n, pair = len(piece), self.pairs.get
        ids = [self.single[b] for b in piece]  # of the part that begins here; -1 once it is merged away
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << 32 | i for i in range(n - 1) if (r := pair(ids[i] << 20 | ids[i + 1], -1)) >= 0]
        heapify(heap)
        while heap:
            rank = heappop(heap)
            i, rank = rank & 0xFFFFFFFF, rank >> 32
            # a part here that has changed since forms another pair, or none
            if ids[i] < 0 or (j := after[i]) >= n or pair(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank << 20 | ids[k], -1)) >= 0:
                    heappush(heap, r << 32 | i)
            if (k := before[i]) >= 0 and (r := pair(ids[k] << 20 | rank, -1)) >= 0:
                heappush(heap, r << 32 | k)
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> bytes:
        out = array("I")
        plain = text[:1] == " " and text.isascii() and text[1:].isalpha()
        for word in [text] if plain else self.find(text):
            piece = word.encode()
            if (rank := self.hash.get(piece)) >= 0:
                out.append(rank)
            else:
                out.extend(self.merged(piece))
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ") if not _LOOSE(text) else _STRETCH(text)
        return self.pieces(first) + b"".join(map(self.memo.__getitem__, rest))


_encoder: tuple[str, Encoder | None] = ("", None)


def _worker_encoder(key: str, shared) -> Encoder:
    """This worker's encoder, kept with its memo from task to task."""
    global _encoder
    if _encoder[0] != key:
        _encoder = key, Encoder(*shared.value)
    return _encoder[1]


def _encode(key: str, shared):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(key, shared)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _decode(shared):
    def run(batches) -> Iterator[pa.RecordBatch]:
        get = shared.value[0].__getitem__
        for batch in batches:
            texts = [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def _round_trip(key: str, shared):
    encode, decode = _encode(key, shared), _decode(shared)
    return lambda batches: decode(encode(batches))


class Tokenizer:
    """Encoding and decoding of DataFrames with one vocabulary; its tokens are broadcast (they don't grow with the data)."""

    def __init__(self, spark, path: str, pattern: str):
        tokens = load_ranks(path)
        self.shared = spark.sparkContext.broadcast((tokens, pattern, PerfectHash(tokens), token_pairs(tokens)))
        self.key = hashlib.sha256(repr((tokens, pattern)).encode()).hexdigest()

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, ids (binary), one row per row."""
        bound_batches(docs.sparkSession)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return rows.mapInArrow(_encode(self.key, self.shared), "doc_id long, ids binary")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """doc_id, ids and decoded (binary) from what encode() returned."""
        return encoded.select("doc_id", "ids").mapInArrow(_decode(self.shared), "doc_id long, ids binary, decoded binary")

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """decode(encode(docs)), in one Python worker for each task."""
        bound_batches(docs.sparkSession)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return rows.mapInArrow(_round_trip(self.key, self.shared), "doc_id long, ids binary, decoded binary")
