"""Repair of conversations: the cheapest edits that give roles system?, then user and assistant in turns.

Each turn is a 4x4 matrix over (cost, audit) from state to state of the automaton of `(s?(ua)+)?` (nothing yet,
after s, after u, after a), followed by the closure of insertions. Sums take the lesser pair and products add costs
and join audits. Of audits of equal cost over the same turns, none begins another (what is left would
be insertions, which cost), so the lesser stays so whatever follows, and products may be taken in any order.
So a conversation is cut into chunks of turns, wherever they lie: each chunk's matrix comes from a balanced tree of products,
and chunks are joined by a tree over partitions. The audit of the whole is then cut at the chunks'
borders, and every chunk is edited where it is, given the state it begins in.

Rows are sorted by ranges of (conversation, turn, text), so a long conversation lies in several partitions.
Equal rows of a turn are counted, not repeated. Which row of a text comes first is found by
aggregating digests, so no task holds a conversation; only the audit and, where asked for, the digest of all
repaired text (which has to be read in order) are made in one task, from chunks, the latter as a stream.

Defined results: null text and role count as one space; turns are in order, nulls first; rows of one turn
are in order of role, text (by their first 16 and 64 code points) and digest; a null conv_id is a conversation;
an empty role makes no legal pair and can't be kept; empty tables give no rows; other columns are ignored,
whatever their names. A conversation's audit has to fit a cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Scratch, bound_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK = 4096  # turns of a chunk
CHUNK_TEXT = 1 << 20  # code points of a chunk's texts, but for a longer text
_FAN = 32  # chunks joined in one step
_LEAF = 6
_STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ACCEPT = (0, 3)
_SPACE = " \t\n\x0b\x0c\r"

Matrix = tuple  # 16 entries, row by row: (cost, audit), or None where there is no way

ONE: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def plus(p: Matrix, q: Matrix) -> Matrix:
    return tuple(y if x is None else x if y is None else min(x, y) for x, y in zip(p, q, strict=True))


def times(p: Matrix, q: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        row = p[i : i + 4]
        for j in range(4):
            ways = [(x[0] + y[0], x, y) for x, y in zip(row, q[j::4], strict=True) if x is not None and y is not None]
            if not ways:
                out.append(None)
                continue
            least = min(w[0] for w in ways)
            out.append((least, min(x[1] + y[1] for cost, x, y in ways if cost == least)))
    return tuple(out)


def _moves(initials: str, cost: int, mark: str) -> Matrix:
    out: list = [None] * 16
    for x in initials:
        for a, b in _STEPS.get(x, {}).items():
            out[4 * a + b] = (cost, mark)
    return tuple(out)


@lru_cache(1)
def inserts() -> Matrix:
    """Any number of insertions: three reach every state that any number reaches, at least cost."""
    once = plus(ONE, _moves("ua", INSERT, "I"))
    return times(times(once, once), once)


@lru_cache(32)
def turn(kind: str) -> Matrix:
    """A turn's matrix, by its kind: D must go, else its role's initial, in upper case if the turn is truncated."""
    out = tuple((DELETE, "D") if i == j else None for i in range(4) for j in range(4))
    if kind != "D":
        more = TRUNCATED if kind.isupper() else 0
        out = plus(out, plus(_moves(kind.lower(), KEEP + more, "K"), _moves("ua", REROLE + more, "R")))
    return times(out, inserts())


@lru_cache(2048)
def _leaf(kinds: str) -> Matrix:
    out = turn(kinds[0])
    for k in kinds[1:]:
        out = times(out, turn(k))
    return out


def product(kinds: str) -> Matrix:
    """The turns' product as a balanced tree."""
    level = [_leaf(kinds[i : i + _LEAF]) for i in range(0, len(kinds), _LEAF)] or [ONE]
    while len(level) > 1:
        level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    row = times(inserts(), matrix)[:4]
    return min(row[s] for s in _ACCEPT if row[s] is not None)


_SUMMARY = "conv_id long, part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, low long, high long, turns long, first_turn long, last_turn long, costs array<long>, audits array<string>"
_CHUNK = _SUMMARY + ", roles array<string>, texts array<string>, counts array<long>, kinds string"
_NAMES = [c.split()[0] for c in _SUMMARY.split(", ")]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def joined(a: dict, b: dict) -> dict:
    """The summary of two neighbouring stretches of a conversation."""
    out = {c: a[c] + b[c] for c in ("n", "blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (not _legal(a["last_role"], b["first_role"]))
    known = [x for x in (a["low"], b["low"]) if x is not None]
    out["low"] = min(known) if known else None
    known = [x for x in (a["high"], b["high"]) if x is not None]
    out["high"] = max(known) if known else None
    out["turns"] = a["turns"] + b["turns"] - (b["first_turn"] is not None and a["last_turn"] == b["first_turn"])
    out |= {c: a[c] for c in ("conv_id", "part", "seq", "first_role", "first_turn")} | {c: b[c] for c in ("last_role", "last_turn")}
    return out | {"matrix": times(a["matrix"], b["matrix"])}


def _packed(s: dict) -> dict:
    m = s.pop("matrix")
    return s | {"costs": [-1 if x is None else x[0] for x in m], "audits": ["" if x is None else x[1] for x in m]}


def _unpacked(s: dict) -> dict:
    return s | {"matrix": tuple(None if c < 0 else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True))}


def _batch(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


def _types(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _chunk(conv: int | None, part: int, seq: int, rows: list[tuple]) -> dict:
    """The chunk of these (turn, role, text, times, kind, blank, duplicate, truncated)."""
    first, last = rows[0], rows[-1]
    known = [r[0] for r in rows if r[0] is not None]
    pairs = sum(r[3] - 1 for r in rows if not _legal(r[1][:1], r[1][:1])) + sum(not _legal(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:], strict=False))
    kinds = "".join(r[4] + "D" * (r[3] - 1) for r in rows)
    s = dict(conv_id=conv, part=part, seq=seq, n=len(kinds), blank=sum(r[5] for r in rows), duplicate=sum(r[6] for r in rows), truncated=sum(r[7] for r in rows), illegal=pairs)
    s |= dict(first_role=first[1][:1], last_role=last[1][:1], low=min(known, default=None), high=max(known, default=None), turns=len(set(known)), first_turn=first[0], last_turn=last[0], matrix=product(kinds))
    return _packed(s) | dict(roles=[r[1] for r in rows], texts=[r[2] if r[4] != "D" else "" for r in rows], counts=[r[3] for r in rows], kinds=kinds)


def kind_of(role: str, text: str, first: bool) -> tuple[str, int, int, int]:
    """(kind, blank, duplicate, truncated) of a row; a blank or repeated text has to go."""
    end = text.rstrip(_SPACE)
    if not end:
        return "D", 1, 0, 0
    if not first:
        return "D", 0, 1, 0
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (initial, 0, 0, 0) if end[-1] in ".!?" else (initial.upper(), 0, 0, 1)


def _chunks(size: int):
    like = _types(_CHUNK)

    def run(batches):
        part = TaskContext.get().partitionId()
        seq, rows, turns, held, conv = 0, [], 0, 0, None

        def close() -> Iterator[dict]:
            nonlocal seq, rows, turns, held
            if rows:
                yield _chunk(conv, part, seq, rows)
            seq, rows, turns, held = seq + 1, [], 0, 0

        def every() -> Iterator[dict]:
            nonlocal conv, turns, held
            for b in batches:
                for c, t, role, text, n, first in zip(*[b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "n", "first")], strict=True):
                    if rows and (c != conv or turns >= size or held + len(text) > CHUNK_TEXT):
                        yield from close()
                    conv = c
                    kind, blank, _, cut = kind_of(role, text, first)
                    while n:  # many equal rows go on in the next chunk
                        now = min(n, size - turns)
                        more = now - (kind != "D")
                        rows.append((t, role, text, now, kind, blank * now, more if not blank else 0, cut))
                        turns, held, n = turns + now, held + len(text), n - now
                        kind, cut = "D", 0
                        if n:
                            yield from close()
            yield from close()

        out, weight = [], 0
        for chunk in every():
            out.append(chunk)
            weight += sum(map(len, chunk["texts"])) + 64 * chunk["n"]
            if weight > CHUNK_TEXT:
                yield _batch(out, like)
                out, weight = [], 0
        if out:
            yield _batch(out, like)

    return run


def _by_conversation(batches) -> Iterator[list[dict]]:
    """Rows that agree in conv_id (and `group`, if there is one), of a sorted stream."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and (row["conv_id"], row.get("group")) != (held[0]["conv_id"], held[0].get("group")):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _join_step(batches):
    like = _types(_SUMMARY)
    for rows in _by_conversation(batches):
        level = [_unpacked(r) for r in rows]
        while len(level) > 1:
            level = [joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        s = level[0]
        yield _batch([_packed({k: s[k] for k in (*_NAMES[:-2], "matrix")})], like)


def _finish(batches):
    like = _types("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    for b in batches:
        out = []
        for s in map(_unpacked, b.to_pylist()):
            cost, audit = cheapest(s["matrix"])
            gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
            gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)  # beyond 64 bits, as such sums wrap
            out.append({c: s[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | dict(gaps=gaps, cost=cost, audit=audit))
        yield _batch(out, like)


def pieces(audit: str, sizes: list[int]) -> list[tuple[str, int, int]]:
    """(piece, state before it, rows written before it) of the chunks of so many turns; a turn's insertions follow it."""
    places = [i for i, x in enumerate(audit) if x != "I"]
    ends, done = [], 0
    for n in sizes:
        done += n
        ends.append(places[done] if done < len(places) else len(audit))
    begins = [0, *ends[:-1]]
    system = (len(audit) - audit.count("D")) % 2  # with s the number of turns is odd
    out, written = [], 0
    for a, b in zip(begins, ends, strict=True):
        state = 0 if not written else 1 if system and written == 1 else 3 if (written - system) % 2 == 0 else 2
        out.append((audit[a:b], state, written))
        written += b - a - audit.count("D", a, b)
    return out


def _cut(batches):
    like = _types("conv_id long, part int, seq long, piece string, state long, written long")
    for b in batches:
        for c, audit, chunks in zip(*[b.column(x).to_pylist() for x in ("conv_id", "audit", "chunks")], strict=True):
            cut = pieces(audit, [x["n"] for x in chunks])
            yield _batch([dict(conv_id=c, part=x["part"], seq=x["seq"], piece=p, state=s, written=w) for x, (p, s, w) in zip(chunks, cut, strict=True)], like)


def edited(kinds: str, rows: Iterator[tuple[str, str]], piece: str, state: int) -> list[tuple[str, str]]:
    """(role, text) of what the edits make of these rows; `state` tells which role is due."""
    out = []
    for edit in piece:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = _STEPS[role[0]][state]
        out.append((role, text))
    return out


def _edit(batches):
    like = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("written", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    for b in batches:
        out = []
        for r in b.to_pylist():
            rows = ((role, text) for role, text, n in zip(r["roles"], r["texts"], r["counts"], strict=True) for _ in range(n))
            done = edited(r["kinds"], rows, r["piece"], r["state"])
            out.append({c: r[c] for c in ("conv_id", "part", "seq", "written")} | {"turns": [{"role": x, "text": y} for x, y in done]})
        yield _batch(out, like)


def _digest(batches):
    now, conv, some = None, None, False
    done = lambda: pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "repaired_sha256": [now.hexdigest()]})
    for b in batches:
        for c, body in zip(b.column("conv_id").to_pylist(), b.column("body").to_pylist(), strict=True):
            if now is None or c != conv:
                if now is not None:
                    yield done()
                now, conv, some = hashlib.sha256(), c, False
            if body is not None:
                now.update((b"\n" if some else b"") + body.encode())
                some = True
    if now is not None:
        yield done()


class Repaired:
    """report(): a row per conversation; turns(): the repaired turns; digests(): a hash of each conversation's."""

    def __init__(self, report: DataFrame, edits: DataFrame) -> None:
        self._report, self._edits = report, edits

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        return self._report

    def turns(self) -> DataFrame:
        """conv_id, turn (from 1), role, text of the repaired conversations."""
        rows = self._edits.select("conv_id", "written", F.posexplode("turns").alias("at", "t"))
        return rows.select("conv_id", (F.col("written") + F.col("at") + 1).alias("turn"), "t.role", "t.text")

    def digests(self) -> DataFrame:
        """conv_id, repaired_sha256: of `role:text`, newline-joined."""
        lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
        body = F.when(F.size("turns") > 0, F.array_join(lines, "\n"))
        rows = self._edits.select("conv_id", "part", "seq", body.alias("body"))
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, chunk: int = CHUNK) -> Repaired:
    """The cheapest repair of each conversation of (conv_id, turn, role, text)."""
    bound_batches(rows.sparkSession)
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    with Scratch() as kept:
        rows = kept(rows.withColumn("digest", digest), "rows")
        # the first row of each text: nulls come before all numbers
        least = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least")
        firsts = rows.groupBy("conv_id", "digest").agg(least).select("conv_id", F.col("least.turn").alias("turn"), "digest", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("one"), F.lit(True).alias("first"))
        both = rows.select("conv_id", "turn", "digest", "role", "text", F.lit(1).alias("one"), F.lit(False).alias("first")).unionByName(firsts)
        counted = both.groupBy("conv_id", "turn", "digest").agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("one").alias("n"), F.max("first").alias("first"))
        keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 64), "digest"]
        ordered = counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
        # what the shared folder keeps of the texts: chunks of turns, and nothing twice
        chunks = stored(ordered.select("conv_id", "turn", "role", "text", "n", "first").mapInArrow(_chunks(chunk), _CHUNK), "chunks")
        number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seq")) - 1
        now = chunks.select(*_NAMES)
        cut = kept(now.groupBy("conv_id").agg(F.count("*").alias("of")).filter("of > 1"), "cut")
        most = cut.agg(F.max("of")).first()[0] or 1
        same = now["conv_id"].eqNullSafe(cut["conv_id"])
        whole = now.join(cut, same, "left_anti")
        now = now.join(cut, same, "left_semi")
        while most > 1:
            stepped = now.withColumn("group", F.floor(number / _FAN)).repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "part", "seq")
            now = kept(stepped.mapInArrow(_join_step, _SUMMARY), "joined")
            most = -(-most // _FAN)
        report = stored(whole.unionByName(now).mapInArrow(_finish, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "report")
        sizes = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "n"))).alias("chunks"))
        cuts = report.select("conv_id", "audit").join(sizes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "audit", "chunks")
        cuts = kept(cuts.mapInArrow(_cut, "conv_id long, part int, seq long, piece string, state long, written long"), "pieces")
        of = chunks.select("part", "seq", "conv_id", "roles", "texts", "counts", "kinds").join(cuts.select("part", "seq", "piece", "state", "written"), ["part", "seq"])
        edits = stored(of.mapInArrow(_edit, "conv_id long, part int, seq long, written long, turns array<struct<role:string,text:string>>"), "edits")
        kept.add(chunks)
        return Repaired(report, edits)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults, by crc32(`conv_id:turn`) mod 20: 0 is dropped, 1 loses its text, 2 its sentence ends, 3 comes twice, 4 is the user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("h")).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times_ = F.explode(F.array_repeat(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times_.alias("one")).drop("one")
