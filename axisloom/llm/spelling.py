"""Groups of spelling variants: words that one edit parts, found by reporting points in rectangles.

For each edit position, the words near a given one begin with what stands before it and end with what
stands after it. Among words sorted forwards those are one interval, among words sorted backwards another,
and the words in both are the points of a rectangle (forward rank, backward rank), which a wavelet tree
reports. Only words of one length are in a tree, so a prefix and a suffix that add up to that length
(deletion) or to one less (replacement) leave nothing else; an insertion is the other word's deletion. The
position used is the first at which the two words differ, so each pair is met once.

Words are brought together by halves: of two near words, the shorter m long, an edit at position
i >= m // 2 leaves the first m // 2 code points alike, an earlier one the last m - m // 2. So a word goes
to the two groups of its own length and the two of the length below, and groups are dealt to tasks of about
SHARD rows by a hash. Words of a group that is larger are dealt to several trees, and each of the
group's words asks all of these. A task returns one row per word, never pairs.

Defined results: null texts have no words; a null doc_id is written as an empty text where words are
damaged; repeated rows count again; very long runs are words like others; among near words of equal count the
least in code-point order is the form; empty tables give no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._groups import groups
from ._tables import Scratch, bound_batches, drop, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5  # a form is at least so many times as frequent
DAMAGE = 199  # one of so many runs loses a code point
SHARD = 100_000  # rows of a task
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_QUERIES = 50_000


class Wavelet:
    """A wavelet matrix over a permutation: levels of bits from the highest, with counts of ones before each place."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length()) if self.n else 1
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            b = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b)]).astype(np.int32))
            self.zeros.append(int(self.n - b.sum()))
            values = np.concatenate([values[b == 0], values[b == 1]])

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the rectangle, value) of every place x0 <= x < x1 whose value is y0 <= value < y1."""
        q = np.flatnonzero((x0 < x1) & (y0 < y1))
        lo, hi, value = x0[q], x1[q], np.zeros(len(q), np.int64)
        for level in range(self.bits):
            ones, left = self.ones[level], self.bits - 1 - level
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            q = np.concatenate([q, q])
            lo, hi = np.concatenate([lo - a, self.zeros[level] + a]), np.concatenate([hi - b, self.zeros[level] + b])
            value = np.concatenate([value << 1, value << 1 | 1])
            keep = (lo < hi) & (value << left < y1[q]) & (value + 1 << left > y0[q])
            q, lo, hi, value = q[keep], lo[keep], hi[keep], value[keep]
        return q, value


class _Order:
    """Rows sorted by group and word; which targets share a row's first i code points."""

    def __init__(self, group: np.ndarray, words: np.ndarray, is_target: np.ndarray) -> None:
        order = np.lexsort((words, group))
        codes = words[order].view(np.uint32).reshape(len(words), -1)
        same = np.concatenate([[False], group[order][1:] == group[order][:-1]])
        alike = np.zeros(len(words), np.int64)
        differ = codes[1:] != codes[:-1]
        alike[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])
        self.alike = np.where(same, alike, -1)
        self.at = np.empty(len(words), np.int64)
        self.at[order] = np.arange(len(words))
        self.before = np.concatenate([[0], np.cumsum(is_target[order])])
        self.targets = order[is_target[order]]  # rows of the targets in this order

    def interval(self, i: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the targets of each row's group that begin with its first i code points."""
        new = self.alike < i
        starts = np.concatenate([np.flatnonzero(new), [len(new)]])
        block = (np.cumsum(new) - 1)[self.at[rows]]
        return self.before[starts[block]], self.before[starts[block + 1]]


def _best(word: np.ndarray, near: np.ndarray, count: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: number of near words, and the one of largest n; words are numbers in code-point order."""
    order = np.lexsort((near, -n[near], word))
    word, near, count = word[order], near[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    return word[first], near[first], np.add.reduceat(count, first) if len(first) else count


def near_words(m: int, suffix: np.ndarray, group: np.ndarray, words: np.ndarray, n: np.ndarray, is_target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of near words, best near word, its n) from the groups of length m of a task.

    Rows are words of length m, some of them targets, and words one longer, which only ask.
    """
    names, number = np.unique(words, return_inverse=True)
    known = np.zeros(len(names), np.int64)
    known[number] = n
    length = np.char.str_len(words)
    back = np.array([w[::-1] for w in words.tolist()], dtype=words.dtype)
    forward, backward = _Order(group, words, is_target), _Order(group, back, is_target)
    rank = np.zeros(len(words), np.int64)
    rank[backward.targets] = np.arange(len(backward.targets))
    tree = Wavelet(rank[forward.targets])
    codes = words.view(np.uint32).reshape(len(words), -1)
    none = np.zeros(0, np.int64)
    found = (none, none, none)
    half = m // 2
    for i in range(m + 1):
        here = suffix if i < half else ~suffix
        replaced = np.flatnonzero(here & (length == m)) if i < m else none
        deleted = np.flatnonzero(here & (length == m + 1))
        if i < m:
            deleted = deleted[codes[deleted, i] != codes[deleted, i + 1]]  # in a run of equal ones, the last
        for rows, end in ((replaced, m - 1 - i), (deleted, m - i)):
            for lo in range(0, len(rows), _QUERIES):
                some = rows[lo : lo + _QUERIES]
                q, y = tree.report(*forward.interval(i, some), *backward.interval(end, some))
                a, b = number[some[q]], number[backward.targets[y]]
                a, b = a[a != b], b[a != b]
                if rows is deleted:
                    a, b = np.concatenate([a, b]), np.concatenate([b, a])
                word, near, count = _best(a, b, np.ones(len(a), np.int64), known)
                word, near, count = (np.concatenate(x) for x in zip(found, (word, near, count), strict=True))
                found = _best(word, near, count, known)
    word, near, count = found
    return names[word], count, names[near], known[near]


def _task(batches):
    for t in groups(batches, 1):
        m, suffix, target, n = (t.column(c).to_numpy(zero_copy_only=False) for c in ("m", "suffix", "target", "n"))
        words = np.array(t.column("word").to_pylist(), dtype=object)
        _, group = np.unique(np.array([f"{a}{b}" for a, b in zip(t.column("key").to_pylist(), t.column("part").to_pylist(), strict=True)]), return_inverse=True)
        for size in np.unique(m).tolist():
            own = np.flatnonzero(m == size)
            if not target[own].any():
                continue
            found, count, near, near_n = near_words(size, suffix[own], group[own] * 2 + suffix[own], words[own].astype(f"U{size + 1}"), n[own], target[own])
            step = max(1, (1 << 22) // (8 * size))
            for lo in range(0, len(found), step):
                s = slice(lo, lo + step)
                yield pa.RecordBatch.from_arrays([pa.array(found[s].tolist(), pa.string()), pa.array(count[s]), pa.array(near[s].tolist(), pa.string()), pa.array(near_n[s])], names=["word", "n_near", "near", "near_n"])


def occurrences(docs: DataFrame) -> DataFrame:
    """One row (word) per run of at least six letters, lower-cased in A-Z, of which one in 199 loses a code point.

    Which one does depends on the document and the run alone.
    """
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN + f"{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    k = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % DAMAGE == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of at least six code points that occur at least so often."""
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _grouped(words: DataFrame) -> DataFrame:
    """Four rows of each word: one for each half, of its own length and of the length below."""

    def halves(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        return [
            F.struct(m.alias("m"), F.lit(False).alias("suffix"), F.substring("word", F.lit(1), h).alias("key")),
            F.struct(m.alias("m"), F.lit(True).alias("suffix"), F.substring("word", F.length("word") - (m - h) + 1, m - h).alias("key")),
        ]

    both = F.array(*halves(F.length("word")), *halves(F.length("word") - 1))
    rows = words.select("word", "n", F.explode(both).alias("g")).select("word", "n", "g.*")
    return rows.filter(F.col("m") >= LEAST_LENGTH).withColumn("target", F.length("word") == F.col("m"))


def near(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, near, near_n) of each of the distinct words (word, n) that has near ones: how many, and the most frequent."""
    bound_batches(words.sparkSession)
    key = ["m", "suffix", "key"]
    rows = _grouped(words)
    large = rows.groupBy(*key).agg(F.count_if("target").alias("targets")).filter(F.col("targets") > shard)
    large = large.select(*key, F.ceil(F.col("targets") / shard).cast("int").alias("parts"))
    total = rows.count()
    dealt = rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shards = max(1, -(-total // shard))
    dealt = dealt.select(F.pmod(F.xxhash64(*key, "part"), F.lit(shards)).alias("shard"), "m", "suffix", "key", "part", "word", "n", (F.col("target") & (F.col("own") == F.col("part"))).alias("target"))
    tasks = max(1, min(4 * shards, 20_000))
    found = dealt.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_task, "word string, n_near long, near string, near_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form); counts rise along a chain, so it ends, after few steps."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        if longer.filter("moved").isEmpty():
            return longer
        now = longer


def variants(words: DataFrame, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the distinct words (word, n)."""
    with Scratch() as kept:
        words = kept(words.select("word", "n"), "words")
        found = kept(near(words, shard), "near")
        fits = F.col("near_n") >= ratio * F.col("n")
        every = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
        every = kept(every, "forms")
        ends = kept.add(roots(every.filter(F.col("form").isNotNull()))).select("word", "root")
        return stored(every.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
