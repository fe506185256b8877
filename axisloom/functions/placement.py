"""Random placement of intervals on one axis, in numpy.

Intervals are (n, 2) int64 arrays, sorted and disjoint unless said otherwise. A placer is called with
(generator, segments within the workspace, workspace, sample number) and returns one random set.
"""

from __future__ import annotations

import tempfile
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np

Placer = Callable[[np.random.Generator, np.ndarray, np.ndarray, int], np.ndarray]
EMPTY = np.zeros((0, 2), np.int64)
DRAWS = 1 << 14  # most draws of brute force, and intervals of shift and local permutation, at once
SHARD = 1 << 15  # intervals of the workspace that are filled at once


def size(x: np.ndarray) -> int:
    return int((x[:, 1] - x[:, 0]).sum())


def merged(x: np.ndarray) -> np.ndarray:
    """Sorted and joined where intervals overlap or touch."""
    x = x[x[:, 1] > x[:, 0]]
    if len(x) < 2:
        return x
    # by start only: of equal starts any order gives the same islands
    length = x[:, 1] - x[:, 0]
    if x[:, 0].min() >= 0 and x[:, 0].max() < 1 << 43 and length.max() < 1 << 20:
        both = np.sort(x[:, 0] << 20 | length)  # numbers are sorted many times as fast as places
        start = both >> 20
        end = start + (both & (1 << 20) - 1)
    else:
        x = x[np.argsort(x[:, 0], kind="stable")]
        start, end = x[:, 0], x[:, 1]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return np.column_stack([start[first], reach[np.append(first[1:], len(start)) - 1]])


def clipped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common parts of any intervals with disjoint ones."""
    if not len(x) or not len(y):
        return EMPTY
    lo, hi = np.searchsorted(y[:, 1], x[:, 0], "right"), np.searchsorted(y[:, 0], x[:, 1], "left")
    n = np.maximum(0, hi - lo)
    a = np.repeat(np.arange(len(x)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.column_stack([np.maximum(x[a, 0], y[b, 0]), np.minimum(x[a, 1], y[b, 1])])


def touching(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intervals of x, whole, that overlap disjoint ones."""
    return x[np.searchsorted(y[:, 1], x[:, 0], "right") < np.searchsorted(y[:, 0], x[:, 1], "left")] if len(y) else EMPTY


def covered_before(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bases of disjoint intervals below each position."""
    if not len(x):
        return np.zeros(len(at), np.int64)
    sums = np.concatenate([[0], np.cumsum(x[:, 1] - x[:, 0])])
    i = np.searchsorted(x[:, 0], at, "right")
    return sums[i] - np.where(i > 0, np.maximum(0, x[np.maximum(i - 1, 0), 1] - at), 0)


@dataclass
class Sorted:
    """Intervals in order of their starts, with the bases before each; ends are in order too where they are disjoint."""

    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Sorted:
        starts, ends = np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])
        return Sorted(starts, ends, np.cumsum(ends - starts) - (ends - starts))

    def __len__(self) -> int:
        return len(self.starts)

    def array(self) -> np.ndarray:
        return np.column_stack([self.starts, self.ends])

    def bases(self) -> int:
        return int(self.before[-1] + self.ends[-1] - self.starts[-1]) if len(self) else 0

    def below(self, at: np.ndarray) -> np.ndarray:
        """Bases of disjoint intervals below each position."""
        if not len(self):
            return np.zeros(len(at), np.int64)
        i = np.searchsorted(self.starts, at, "right") - 1
        j = np.maximum(i, 0)
        return np.where(i < 0, 0, self.before[j] + np.minimum(at, self.ends[j]) - self.starts[j])

    def touched_by(self, x: Sorted) -> int:
        """How many of any intervals overlap these, which are disjoint."""
        return int((np.searchsorted(self.ends, x.starts, "right") < np.searchsorted(self.starts, x.ends, "left")).sum()) if len(self) else 0

    def middles_of(self, x: Sorted) -> int:
        """How many of any intervals have their middle in these."""
        if not len(self):
            return 0
        at = x.starts + (x.ends - x.starts) // 2
        i = np.searchsorted(self.starts, at, "right") - 1
        return int(((i >= 0) & (at < self.ends[np.maximum(i, 0)])).sum())


class Growing:
    """A set that grows by parts: few new intervals are kept apart until they are an eighth of the others, and
    their new bases are told by the running sums of those."""

    def __init__(self) -> None:
        self.have, self.late, self.covered = EMPTY, EMPTY, 0
        self.sums = Sorted.of(EMPTY)

    def add(self, more: np.ndarray) -> int:
        """How many bases are new."""
        late = merged(np.vstack([self.late, more]))
        if 8 * len(late) > len(self.have):
            self.have, self.late = merged(np.vstack([self.have, late])), EMPTY
            self.sums = Sorted.of(self.have)
            now = self.sums.bases()
        else:
            self.late = late
            now = self.sums.bases() + size(late) - int((self.sums.below(late[:, 1]) - self.sums.below(late[:, 0])).sum())
        gained, self.covered = now - self.covered, now
        return gained

    def all(self) -> np.ndarray:
        return merged(np.vstack([self.have, self.late])) if len(self.late) else self.have


class Rows(Protocol):
    """Sorted disjoint intervals that are read in stretches, from arrays or files."""

    def __len__(self) -> int: ...

    def stretch(self, first: int, last: int) -> np.ndarray: ...

    def before(self, ends: np.ndarray) -> np.ndarray:
        """How many end at or before each position."""

    def begun(self, starts: np.ndarray) -> np.ndarray:
        """How many start before each position."""


@dataclass
class Held:
    """Rows of an array."""

    x: np.ndarray

    def __len__(self) -> int:
        return len(self.x)

    def stretch(self, first: int, last: int) -> np.ndarray:
        return self.x[first:last]

    def before(self, ends: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.x[:, 1], ends, "right")

    def begun(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.x[:, 0], starts, "left")


class Space:
    """An axis in shards, each some intervals of the workspace and the segments' parts in them; shards don't touch."""

    def __init__(self, segments: Rows, workspace: Rows, shard: int = SHARD):
        self.s, self.w = segments, workspace
        cuts, n = [0], len(workspace)
        while cuts[-1] < n:
            c = min(n, cuts[-1] + shard)
            while c < n and (two := workspace.stretch(c - 1, c + 1))[0, 1] >= two[1, 0]:
                c += 1
            cuts.append(c)
        self.cuts = cuts
        self.low = np.array([workspace.stretch(c, c + 1)[0, 0] for c in cuts[:-1]], np.int64)
        self.high = np.array([workspace.stretch(c - 1, c)[0, 1] for c in cuts[1:]], np.int64)
        self.before = np.concatenate([[0], self.high[:-1]]).astype(np.int64)  # where the shard before ends
        self._first, self._last = segments.before(self.low), segments.begun(self.high)
        sizes, counts, self.target = [], {}, 0
        for i in range(len(self)):
            w = self.workspace(i)
            sizes.append(size(w))
            for n, k in zip(*np.unique(np.diff(clipped(self.segments(i), w))[:, 0], return_counts=True), strict=True):
                counts[int(n)] = counts.get(int(n), 0) + int(k)
                self.target += int(n) * int(k)
        self.sizes = np.array(sizes, np.float64)
        self.lengths = np.array(sorted(counts.items()), np.int64).reshape(-1, 2)  # of the segments' parts, and how many

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def workspace(self, i: int, until: int | None = None) -> np.ndarray:
        """Shard i, or what begins from there on before `until`."""
        last = self.cuts[i + 1] if until is None else max(self.cuts[i + 1], int(self.w.begun(np.array([until]))[0]))
        return self.w.stretch(self.cuts[i], last)

    def segments(self, i: int) -> np.ndarray:
        return self.s.stretch(int(self._first[i]), int(self._last[i]))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All segments that touch the workspace, and that."""
        w = self.w.stretch(0, len(self.w))
        return touching(self.s.stretch(0, len(self.s)), w), w

    def dealt(self, rng: np.random.Generator, n: int) -> list[tuple[int, int]]:
        """Shards by size for n draws, and how many each has."""
        k = rng.multinomial(n, self.sizes / self.sizes.sum())
        return [(int(i), int(k[i])) for i in np.flatnonzero(k)]


class Shelf:
    """Sets of intervals by number; where all are more than `most`, in a temporary file that goes with its task."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held, self.kept = most, 0, {}
        self.file = None

    def put(self, i: int, x: np.ndarray) -> None:
        old = self.kept.pop(i, None)
        self.held -= len(old) if isinstance(old, np.ndarray) else 0
        if self.held + len(x) <= self.most:
            self.kept[i], self.held = x, self.held + len(x)
            return
        self.file = self.file or tempfile.TemporaryFile()
        self.kept[i] = (self.file.seek(0, 2), len(x))
        self.file.write(np.ascontiguousarray(x, np.int64).data if len(x) else b"")

    def get(self, i: int) -> np.ndarray:
        x = self.kept.get(i, EMPTY)
        if isinstance(x, np.ndarray):
            return x
        self.file.seek(x[0])
        return np.frombuffer(self.file.read(16 * x[1]), np.int64).reshape(-1, 2)


class Filled:
    """Growing sets by shard: few new intervals are kept apart until they are an eighth of the others."""

    def __init__(self, shards: int):
        self.shelf, self.late, self.covered = Shelf(), {}, 0
        self.have, self.known, self.n = (np.zeros(shards, np.int64) for _ in range(3))

    def add(self, i: int, more: np.ndarray) -> None:
        late = merged(np.vstack([self.late.pop(i, EMPTY), more]))
        if 8 * len(late) > self.n[i]:
            have = merged(np.vstack([self.shelf.get(i), late])) if self.n[i] else late
            self.shelf.put(i, have)
            self.n[i], now = len(have), size(have)
            self.have[i] = now
        else:
            self.late[i] = late
            now = int(self.have[i]) + size(late) - size(clipped(late, self.shelf.get(i)))
        self.covered += now - int(self.known[i])
        self.known[i] = now

    def all(self, i: int) -> np.ndarray:
        return merged(np.vstack([self.shelf.get(i), self.late[i]])) if i in self.late else self.shelf.get(i)

    def without(self, rng: np.random.Generator, excess: int) -> Iterator[np.ndarray]:
        """The sets in order, less bases that are taken from a random interval on, around the end."""
        cut: dict[int, np.ndarray] = {}
        if excess > 0:
            sums = np.cumsum([self.n[i] + len(self.late.get(i, EMPTY)) for i in range(len(self.n))])
            at, forward = int(rng.integers(sums[-1])), bool(rng.integers(2))
            first = i = int(np.searchsorted(sums, at, "right"))
            at -= int(sums[i - 1]) if i else 0
            while excess:
                x = cut[i] if i in cut else self.all(i)
                at = min(at, len(x) - 1) if i == first and i not in cut else 0 if forward else len(x) - 1
                cut[i], excess = _cut(x, excess, at, forward)
                i = (i + (1 if forward else -1)) % len(self.n)
        for i in range(len(self.n)):
            yield cut[i] if i in cut else self.all(i)


def _cut(x: np.ndarray, excess: int, at: int, forward: bool) -> tuple[np.ndarray, int]:
    """x less `excess` bases from the interval that is number `at` to its end (or beginning), and what is still to be taken."""
    out = x.copy()
    part = out[at:] if forward else out[: at + 1][::-1]
    n = part[:, 1] - part[:, 0]
    taken = np.clip(excess - (np.cumsum(n) - n), 0, n)
    if forward:
        part[:, 0] += taken
    else:
        part[:, 1] -= taken
    return out[out[:, 1] > out[:, 0]], excess - int(taken.sum())


def trimmed(x: np.ndarray, excess: int, at: int, forward: bool) -> np.ndarray:
    """x less `excess` bases, taken from the interval that is number `at` onwards, around the end."""
    order = np.roll(np.arange(len(x)), -at) if forward else np.roll(np.arange(len(x))[::-1], at + 1 - len(x))
    out, left = x.copy(), excess
    for i in order:
        cut = min(left, int(out[i, 1] - out[i, 0]))
        if forward:
            out[i, 0] += cut
        else:
            out[i, 1] -= cut
        left -= cut
        if not left:
            break
    return out[out[:, 1] > out[:, 0]]


class Lengths:
    """Draws from observed lengths; with buckets, uniformly within the bucket's range."""

    def __init__(self, segments: np.ndarray, bucket: int = 1):
        self.all = segments[:, 1] - segments[:, 0]
        self.bucket = bucket
        self.mean = max(1.0, float(self.all.mean())) if len(self.all) else 1.0
        self.longest = -(-int(self.all.max(initial=1)) // bucket) * bucket

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        some = self.all[rng.integers(0, len(self.all), n)]
        if self.bucket == 1:
            return some
        top = -(-some // self.bucket) * self.bucket
        return top - rng.integers(0, self.bucket, n)


class CountedLengths(Lengths):
    """The same draws from how often each length was observed, which needs no row for a segment."""

    def __init__(self, counts: np.ndarray, bucket: int = 1):
        self.values, self.sums = counts[:, 0], np.cumsum(counts[:, 1])
        self.bucket = bucket
        self.mean = max(1.0, float((counts[:, 0] * counts[:, 1]).sum() / max(1, counts[:, 1].sum())))
        self.longest = -(-int(self.values.max(initial=1)) // bucket) * bucket

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        some = self.values[np.searchsorted(self.sums, rng.integers(0, self.sums[-1], n), "right")]
        if self.bucket == 1:
            return some
        return -(-some // self.bucket) * self.bucket - rng.integers(0, self.bucket, n)


class HistogramLengths(Lengths):
    """Draws from a histogram of lengths by ceil(length / bucket), searched by rank in its running sums.

    A bucket of 0 takes the least size for which there are no more than `most` buckets; a length that
    needs more is an error otherwise. Within a bucket all lengths are equally likely.
    """

    def __init__(self, segments: np.ndarray, bucket: int = 1, most: int = 100_000):
        length = segments[:, 1] - segments[:, 0]
        bucket = bucket or max(1, -(-int(length.max(initial=1)) // most))
        super().__init__(segments, bucket)
        number = -(-length // bucket)
        if number.max(initial=0) > most:
            raise ValueError("an interval is too long for the histogram")
        self.sums = np.cumsum(np.bincount(number))

    @classmethod
    def of(cls, counts: np.ndarray, bucket: int) -> HistogramLengths:
        """From counts by bucket, 0 first, as one aggregation gives them."""
        out = cls.__new__(cls)
        out.bucket, out.sums = bucket, np.cumsum(counts)
        out.longest = (len(counts) - 1) * bucket
        out.mean = max(1.0, float((counts * (np.arange(len(counts)) * bucket - (bucket - 1) / 2)).sum() / max(1, counts.sum())))
        return out

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        number = np.searchsorted(self.sums, rng.integers(0, self.sums[-1], n), "right")
        return number * self.bucket - (rng.integers(0, self.bucket, n) if self.bucket > 1 else 0)


class Positions:
    """Starts of intervals that reach into the workspace: its interval by size, then any start that overlaps it,
    but not the interval before."""

    def __init__(self, workspace: np.ndarray, before: int = 0):
        self.w = workspace
        self.sums = np.cumsum(workspace[:, 1] - workspace[:, 0])
        self.before = np.concatenate([[before], workspace[:-1, 1]])

    def bases(self, rng: np.random.Generator, n: int, ordered: bool) -> np.ndarray:
        """Numbers of bases of the workspace; in order where draws are a set, as ordered ones are found faster."""
        out = rng.integers(0, self.sums[-1], n)
        return np.sort(out) if ordered else out

    def draw(self, rng: np.random.Generator, lengths: np.ndarray, ordered: bool = False) -> np.ndarray:
        i = np.searchsorted(self.sums, self.bases(rng, len(lengths), ordered), "right")
        low = np.maximum(np.maximum(self.before[i], self.w[i, 0] - lengths + 1), 0)
        return low + (rng.random(len(lengths)) * (self.w[i, 1] - low)).astype(np.int64)


class EdgePositions(Positions):
    """Starts such that a base of the workspace, all equally likely, is any base of the interval.

    Unlike those of Positions, such intervals cover bases near the edges of the workspace less often than others:
    a base at distance d from an edge lacks the draws whose base would lie beyond it.
    """

    def draw(self, rng: np.random.Generator, lengths: np.ndarray, ordered: bool = False) -> np.ndarray:
        base = self.bases(rng, len(lengths), ordered)
        i = np.searchsorted(self.sums, base, "right")
        at = self.w[i, 1] - (self.sums[i] - base)
        return np.maximum(0, at - (rng.random(len(lengths)) * lengths).astype(np.int64))


def _histogram(counts: np.ndarray, bucket: int, most: int = 100_000) -> HistogramLengths:
    bucket = bucket or max(1, -(-int(counts[:, 0].max(initial=1)) // most))
    number = -(-counts[:, 0] // bucket)
    if number.max(initial=0) > most:
        raise ValueError("an interval is too long for the histogram")
    return HistogramLengths.of(np.bincount(number, counts[:, 1]).astype(np.int64), bucket)


LENGTHS: dict[str, Callable[[np.ndarray, int], Lengths]] = {"observed": CountedLengths, "histogram": _histogram}
POSITIONS: dict[str, type[Positions]] = {"overlapping": Positions, "edge": EdgePositions}


def sharded(fill: Callable[[np.random.Generator, Space], Iterator[np.ndarray]]) -> Placer:
    """A placer that fills an axis by shards; its `fill` gives their sets one by one, which are never held together."""
    held: list = [None, None, None]

    def place(rng, s, w, _):
        if held[0] is not s or held[1] is not w:  # samples of a task share them
            held[:] = s, w, Space(Held(s), Held(w))
        parts = list(fill(rng, held[2]))
        return np.vstack(parts) if parts else EMPTY

    place.fill = fill
    return place


def annotator(bucket: int = 1, rounds: int = 20, lengths: str = "observed", positions: str = "overlapping") -> Placer:
    """Draw lengths and positions until exactly the bases of the segments are covered within the workspace."""

    def fill(rng: np.random.Generator, space: Space) -> Iterator[np.ndarray]:
        target, room = space.target, float(space.sizes.sum())
        if not target:
            return
        of_length = LENGTHS[lengths](space.lengths, bucket)
        found, idle, drawn = Filled(len(space)), 0, 0
        while found.covered < target and idle < rounds:
            n = _wanted(target, found.covered, room, drawn, of_length.mean)
            drawn, was, over = drawn + n, found.covered, []
            for i, k in space.dealt(rng, n):
                w = space.workspace(i)
                length = of_length.draw(rng, k)
                start = POSITIONS[positions](w, int(space.before[i])).draw(rng, length, True)
                x = np.column_stack([start, start + length])
                found.add(i, clipped(x, w))
                out = x[:, 0] < space.before[i]
                out |= x[:, 1] > (space.low[i + 1] if i + 1 < len(space) else x[:, 1])
                over.append(x[out])
            # what reaches into other shards
            x = np.vstack(over)
            first, last = np.searchsorted(space.high, x[:, 0], "right"), np.searchsorted(space.low, x[:, 1], "left")
            for i in np.unique(np.concatenate([first, last - 1])) if (last - first <= 2).all() else range(len(space)):
                if len(some := x[(first <= i) & (i < last)]):
                    found.add(int(i), clipped(some, space.workspace(int(i))))
            idle = 0 if found.covered > was else idle + 1
        yield from found.without(rng, found.covered - target)

    return sharded(fill)


def _wanted(target: int, covered: int, room: float, drawn: int, mean: float) -> int:
    """How many draws at once: nine tenths of what is likely still needed while that is much; half near the target, or where it is most of the room."""
    if target < 0.9 * room and covered < target:
        # n draws of m bases are likely to cover 1 - exp(-n m / room); m is what those so far have shown
        each = -room / drawn * np.log1p(-covered / room) if covered else mean
        rest = -room / each * np.log1p(-target / room) - drawn
        if rest > 1000:
            return int(0.9 * rest)
    return max(1, int((target - covered) / mean / 2))


def across(rng: np.random.Generator, strata: list[tuple[np.ndarray, np.ndarray]], bucket: int = 1, rounds: int = 20) -> list[np.ndarray]:
    """One random set for strata of one contig, (segments, workspace) each, that are filled together.

    A draw takes a stratum by the bases that are still to be placed there, over the mean length of its segments (so
    that bases are placed in proportion), one of its lengths and a start in its workspace; it is not cut at the stratum's border, and what it places beyond counts against the others in
    turn. All bases together are kept exactly, those of a stratum on average only.
    """
    strata = [(clipped(s, w), w) for s, w in strata]
    targets = np.array([size(s) for s, _ in strata], np.int64)
    target, whole = int(targets.sum()), merged(np.vstack([w for _, w in strata]))
    if not target:
        return [EMPTY for _ in strata]
    draws = [(Lengths(s, bucket), Positions(w)) if len(s) else None for s, w in strata]
    means = np.array([d[0].mean if d else 1.0 for d in draws])
    found, idle, left = Growing(), 0, targets.copy()
    while found.covered < target and idle < rounds:
        weights = left if left.any() else targets  # overlaps use budgets up early: they begin anew
        if not left.any():
            left = targets.copy()
        weights = weights / means
        n = max(1, int((target - found.covered) * weights.sum() / (weights * means).sum() / 2))
        parts = []
        for i, k in enumerate(rng.multinomial(n, weights / weights.sum()).tolist()):
            if k:
                length = draws[i][0].draw(rng, k)
                start = draws[i][1].draw(rng, length)
                part = clipped(np.column_stack([start, start + length]), whole)
                parts.append(part)
                _charge(left, i, size(part))
        idle = 0 if found.add(np.vstack(parts)) else idle + 1
    have = _exact(rng, found, target)
    return [clipped(have, w) for _, w in strata]


def _exact(rng: np.random.Generator, found: Growing, target: int) -> np.ndarray:
    """What was found, less any bases beyond the target from a random place on."""
    have = found.all()
    return trimmed(have, found.covered - target, int(rng.integers(len(have))), bool(rng.integers(2))) if found.covered > target else have


def _charge(left: np.ndarray, i: int, bases: int) -> None:
    """Take bases from budget i, and what it lacks from those after it."""
    for j in range(len(left)):
        k = (i + j) % len(left)
        used = min(bases, int(left[k]))
        left[k] -= used
        bases -= used


def segments(bucket: int = 1) -> Placer:
    """As many draws as segments; they may overlap."""

    def place(rng, s, w, _):
        if not len(s) or not len(w):
            return EMPTY
        length = Lengths(clipped(s, w), bucket).draw(rng, len(s))
        start = Positions(w).draw(rng, length)
        out = np.column_stack([start, start + length])
        return out[np.lexsort((out[:, 1], out[:, 0]))]

    return place


def brute_force(bucket: int = 1, inner: int = 100, outer: int = 10) -> Placer:
    """Only draws that overlap nothing drawn before and that still fit; an error where that doesn't succeed."""

    def fill(rng: np.random.Generator, space: Space) -> Iterator[np.ndarray]:
        if not space.target:
            return
        lengths, n_shards = CountedLengths(space.lengths, bucket), len(space)
        for _outer in range(outer):
            shelf, left, tries = Shelf(), space.target, 0
            # a draw starts in its own shard; where those before end and those behind start, it has to stop
            first, last = np.full(n_shards, np.iinfo(np.int64).max), np.full(n_shards, -1, np.int64)
            while left and tries < inner:
                # many at once while even the longest would all fit; those of a shard are taken one by one
                n, took = max(1, left // lengths.longest), []
                dealt, room = space.dealt(rng, n), left
                for i, k in dealt if rng.integers(2) else dealt[::-1]:
                    low, high = last[:i].max(initial=0), first[i + 1 :].min(initial=np.iinfo(np.int64).max)
                    have = shelf.get(i)
                    for at in range(0, k, DRAWS):
                        length = np.minimum(lengths.draw(rng, min(DRAWS, k - at)), room)
                        own = space.workspace(i)
                        start = Positions(own, int(space.before[i])).draw(rng, length)
                        w = space.workspace(i, int((start + length).max()))
                        new, ok = _taken(start, start + length, have, w, int(low), int(high))
                        took.append(ok)
                        have = np.vstack([have, new])
                        have = have[np.argsort(have[:, 0], kind="stable")]
                        left -= int((covered_before(w, new[:, 1]) - covered_before(w, new[:, 0])).sum())
                    if len(have):
                        shelf.put(i, have)
                        first[i], last[i] = have[0, 0], have[-1, 1]
                tries = _failures(rng.permutation(np.concatenate(took)), tries, inner)
            if not left:
                for i in range(n_shards):
                    have = shelf.get(i)
                    if len(have):
                        yield clipped(have, space.workspace(i, int(have[-1, 1])))
                return
        raise ValueError("no placement without overlap was found")

    return sharded(fill)


def _taken(start: np.ndarray, end: np.ndarray, have: np.ndarray, w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws in the order in which they come, if they are in the workspace and between low and high, and free of
    those before them; and which these are."""
    bases = covered_before(w, end) - covered_before(w, start)
    free = (bases > 0) & (start >= low) & (end <= high) & (np.searchsorted(have[:, 1], start, "right") == np.searchsorted(have[:, 0], end, "left"))
    starts, ends, ok = [], [], free.copy()
    some = np.flatnonzero(free)
    for j, a, b in zip(some.tolist(), start[some].tolist(), end[some].tolist(), strict=True):
        i = bisect_left(starts, a)
        if i and ends[i - 1] > a or i < len(starts) and starts[i] < b:
            ok[j] = False
            continue
        starts.insert(i, a)
        ends.insert(i, b)
    return np.column_stack([np.array(starts, np.int64), np.array(ends, np.int64)]), ok


def _failures(ok: np.ndarray, tries: int, inner: int) -> int:
    """Failures in a row at the end, or `inner` if there were as many anywhere, after `tries` before."""
    hits = np.flatnonzero(ok)
    runs = np.diff(np.concatenate([[-1 - tries], hits, [len(ok)]])) - 1
    return inner if (runs >= inner).any() else int(runs[-1])


def uniform(increment: int) -> Placer:
    """For tests: one start every `increment` bases of the workspace, going on from sample to sample, in alternating direction."""

    def place(rng, s, w, sample):
        if not len(s) or not len(w):
            return EMPTY
        length = s[:, 1] - s[:, 0]
        total = size(w)
        k = np.arange(len(s)) + sample * len(s)
        at = k * increment
        lap, at = at // total, at % total
        at = np.where(lap % 2 == 0, at, total - 1 - at)
        sums = np.concatenate([[0], np.cumsum(w[:, 1] - w[:, 0])])
        i = np.searchsorted(sums, at, "right") - 1
        start = w[i, 0] + at - sums[i]
        out = np.column_stack([start, start + length])
        return out[np.lexsort((out[:, 1], out[:, 0]))]

    return place


def shift(radius: float = 2.0, extension: int = 0) -> Placer:
    """Each segment moves within `radius` lengths (or `extension` bases) of its middle, around the part of the workspace there."""

    def place(rng, s, w, _):
        sums = np.concatenate([[0], np.cumsum(w[:, 1] - w[:, 0])])
        out = []
        for at in range(0, len(s), DRAWS):
            x = s[at : at + DRAWS]
            n = x[:, 1] - x[:, 0]
            mid = x[:, 0] + n // 2
            reach = extension // 2 if extension else (n * radius / 2).astype(np.int64)
            # the bases of the workspace near a segment are a stretch of those of the whole workspace in line
            low = covered_before(w, np.maximum(0, mid - reach))
            room = covered_before(w, mid + reach) - low
            low, room, n = low[room > 0], room[room > 0], n[room > 0]
            n = np.minimum(n, room)
            start = low + rng.integers(0, room)
            out.append(_lifted(w, sums, _around(start, n, low, low + room)))
        return merged(np.vstack(out)) if out else EMPTY

    return place


def _around(start: np.ndarray, length: np.ndarray, low: np.ndarray | int, high: np.ndarray | int) -> np.ndarray:
    """Intervals that go on at low where they pass high."""
    end = start + length
    low = np.broadcast_to(low, start.shape)
    line = np.vstack([np.column_stack([start, np.minimum(end, high)]), np.column_stack([low, low + end - high])])
    return line[line[:, 1] > line[:, 0]]


def _lifted(w: np.ndarray, sums: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Pieces of the workspace under intervals of its concatenation."""
    pieces = clipped(line, np.column_stack([sums[:-1], sums[1:]]))
    i = np.searchsorted(sums, pieces[:, 0], "right") - 1
    return pieces + (w[i, 0] - sums[i])[:, None]


def _on_line(w: np.ndarray, sums: np.ndarray, start: np.ndarray, length: np.ndarray, total: int) -> np.ndarray:
    """Pieces of the workspace under intervals of its concatenation, going round at its end."""
    return _lifted(w, sums, _around(start, length, 0, total))


def _permuted(rng: np.random.Generator, length: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths in random order with random gaps that fill `total`, turned by a random offset."""
    length = rng.permutation(length)
    free = max(0, total - int(length.sum()))
    gaps = np.sort(rng.integers(0, free + 1, len(length)))
    start = gaps + np.cumsum(length) - length
    return (start + int(rng.integers(total))) % total, length


def global_permutation() -> Placer:
    """Segments in new order with new gaps on the concatenated workspace; its gaps may split them."""

    def place(rng, s, w, _):
        inside = clipped(s, w)
        total = size(w)
        if not len(inside):
            return EMPTY
        sums = np.concatenate([[0], np.cumsum(w[:, 1] - w[:, 0])])
        start, length = _permuted(rng, inside[:, 1] - inside[:, 0], total)
        return merged(_on_line(w, sums, start, length, total))

    return place


def local_permutation() -> Placer:
    """The same within each interval of the workspace, made as long as the segments that hang over it need."""

    def place(rng, s, w, _):
        out = []
        lo, hi = np.searchsorted(s[:, 1], w[:, 0], "right"), np.searchsorted(s[:, 0], w[:, 1], "left")
        some = np.flatnonzero(lo < hi)
        for at in range(0, len(some), DRAWS):
            k = some[at : at + DRAWS]
            n, low, high = (hi - lo)[k], np.minimum(w[k, 0], s[lo[k], 0]), np.maximum(w[k, 1], s[hi[k] - 1, 1])
            first = np.cumsum(n) - n  # of each interval's own segments
            group = np.repeat(np.arange(len(k)), n)
            own = np.arange(len(group)) - first[group] + lo[k][group]
            length = (s[own, 1] - s[own, 0])[np.lexsort((rng.random(len(group)), group))]
            before = np.cumsum(length) - length
            total = high - low
            free = np.maximum(0, total - np.add.reduceat(length, first))
            gaps = rng.integers(0, free[group] + 1)
            gaps = gaps[np.lexsort((gaps, group))]
            start = gaps + before - before[first][group]
            start = (start + rng.integers(0, total)[group]) % total[group]
            out.append(_around(low[group] + start, length, low[group], high[group]))
        return merged(np.vstack(out)) if out else EMPTY

    return place


def dummy() -> Placer:
    """The segments as they are."""
    return lambda rng, s, w, _: s


PLACERS: dict[str, Callable[..., Placer]] = {
    "annotator": annotator,
    "segments": segments,
    "brute-force": brute_force,
    "uniform": uniform,
    "shift": shift,
    "local-permutation": local_permutation,
    "global-permutation": global_permutation,
    "dummy": dummy,
}
