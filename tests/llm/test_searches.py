"""Nearest neighbours, spelling variants and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.llm import conversations, neighbours, queries, spelling

# --- nearest neighbours ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>"


def plain_nearest(rows, k=10):
    """(query_id, rank, vec_id, score) by comparing all; rows is [(vec_id, vector)] of usable ones."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % 100 == 0:
            far = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), v) for j, (v, y) in enumerate(rows) if j != i and len(x) == len(y))
            out += [(q, r + 1, v, d) for r, (d, v) in enumerate(far[:k])]
    return sorted(out)


def usable(rows):
    return [(v, x) for v, x in rows if v is not None and x and None not in x and np.isfinite(x).all() and any(x)]


def found(spark, rows, **options):
    rows = [(v, None if x is None else [None if y is None else float(y) for y in x]) for v, x in rows]
    d = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("rank", "score", "h1", "dim", "salts", "n", "best", "query_id")})
    got = neighbours.nearest(d.filter(F.col("vec_id") % 100 == 0), neighbours.index(d, **options))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def assert_equal(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


@pytest.mark.parametrize("shard", [8192, 40])
def test_neighbours_of_small_tables_are_exact(spark, shard):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(0, 1200, 10)]
    rows += [(1300 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(130)]  # one vector in many rows, three of them queries
    rows += [(2000, [-0.0, 1.0, 0, 0, 0, 0]), (2001, [0.0, 1.0, 0, 0, 0, 0]), (2100, [2.0] * 6), (2100, [2.0] * 6), (2100, [3.0] * 6)]
    rows += [(3000, [1.0, 2.0]), (3001, [1e200, 2.0]), (3100, [5.0])]
    odd = [(4000, None), (4100, []), (4200, [0.0] * 6), (4300, [float("nan")] + [1.0] * 5), (4400, [float("inf")] + [1.0] * 5), (4500, [None] + [1.0] * 5), (None, [1.0] * 6)]
    assert_equal(found(spark, rows + odd, shard=shard), plain_nearest(usable(rows)))


def test_neighbours_of_an_empty_table(spark):
    assert found(spark, []) == []


def test_recall_of_the_graph():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    level = neighbours.levels(np.arange(3000, dtype=np.int64))
    x, level = x, np.sort(level)[::-1]
    links = neighbours.build(x, level)
    assert [a.shape for a in links[-2:]] == [(int((level >= 1).sum()), 16), (3000, 32)]
    q = rng.standard_normal((200, 24)).astype(np.float32)
    got = neighbours.search(x, links, q, 10)
    want = np.argsort(neighbours._pairwise(q.astype(float), x.astype(float)), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got.tolist(), want.tolist(), strict=True)]) > 0.95


def test_recall_over_shards(spark):
    rng = np.random.default_rng(4)
    rows = [(i, x) for i, x in enumerate(rng.standard_normal((2500, 16)).tolist())]
    got, want = found(spark, rows, shard=800), plain_nearest(rows)
    assert len(got) == len(want)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) / len(want) > 0.95
    at = dict(rows)
    assert all(abs(s - np.linalg.norm(np.array(at[q]) - np.array(at[v]))) < 1e-12 for q, _, v, s in got)


def test_a_scan_replaces_a_walk_that_meets_too_few():
    x = np.concatenate([np.zeros((200, 2)), np.ones((200, 2)) * 9]) + np.arange(400)[:, None] * 1e-3
    alone = [np.repeat(np.arange(400)[:, None], 4, 1)]  # no links at all
    assert neighbours.search(x, alone, x[:1], 3).tolist() == [[0, 1, 2]]


# --- spelling variants -----------------------------------------------------------------------------------


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_variants(n):
    form, out = {}, {}
    for w in n:
        others = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form[w] = others[0] if others and n[others[0]] >= 5 * n[w] else None
        out[w] = len(others)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w], n[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("shard", [100_000, 60])
def test_variants(spark, shard):
    rng = random.Random(8)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))): rng.randint(5, 300) for _ in range(400)}
    n |= {"a" * k: 40 * k for k in (6, 7, 8, 300, 301)} | {"b" * 150 + "a" * 150: 7, "𝒳abcdef": 9, "𝒳abcdeg": 90}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), shard=shard)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r)[1:] for r in got.collect()} == plain_variants(n)


def test_rectangles():
    rng = np.random.default_rng(2)
    y = rng.permutation(300)
    tree = spelling.Wavelet(y)
    for _ in range(50):
        a, b = np.sort(rng.integers(0, 301, (2, 20)), axis=0), np.sort(rng.integers(0, 301, (2, 20)), axis=0)
        q, value = tree.report(a[0], a[1], b[0], b[1])
        assert sorted(zip(q.tolist(), value.tolist(), strict=True)) == sorted((i, int(v)) for i in range(20) for v in y[a[0, i] : a[1, i]] if b[0, i] <= v < b[1, i])


def test_words_of_documents(spark):
    rng = random.Random(6)
    base = ["wandering", "éTÉMOIN", "straßen", "river×side", "short", "ABCdefÿ", "x" * 3000]
    texts = [(i, " ".join(rng.choice(base) + rng.choice(["", "s", "1", "Ā"]) for _ in range(60))) for i in range(60)]
    texts += [(7, None), (8, ""), (None, "wandering wandering"), (None, None), texts[3], texts[3]]
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    n = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "run", "h", "id", "n")})
    got = {r.word: r.n for r in spelling.counted(spelling.occurrences(d)).collect()}
    assert got == {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    assert any(w not in {b.translate(lower) for b in base} for w in got)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


# --- conversations ---------------------------------------------------------------------------------------


def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, turns) of ordered (role, text): a table over states, row by row."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, turns) in list(best.items()):
                for x in "ua":
                    if (state, x) in step:
                        new = (cost + 3, audit + "I", turns + ((names[x], ""),))
                        at = step[state, x]
                        best[at] = min(best.get(at, new), new, key=lambda b: b[:2])
        return best

    best, seen, counts = inserted({0: (0, "", ())}), set(), [0, 0, 0]
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        new = {}

        def offer(state, way):
            new[state] = min(new.get(state, way), way, key=lambda b: b[:2])

        for state, (cost, audit, turns) in best.items():
            offer(state, (cost + 4, audit + "D", turns))
            if fault in (0, 1):
                continue
            more = 3 if fault == 2 else 0
            if (state, role[:1]) in step:
                offer(step[state, role[:1]], (cost + more, audit + "K", turns + ((role, text),)))
            for x in "ua":
                if (state, x) in step:
                    offer(step[state, x], (cost + more + 3, audit + "R", turns + ((names[x], text),)))
        best = inserted(new)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (*counts, illegal, *min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2]))


def test_matrices_are_associative_and_cheapest():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b?", "cut", "", "d!"])) for _ in range(rng.randint(0, 14))]
        seen, kinds = set(), ""
        for role, text in rows:
            kinds += conversations.kind_of(role, text, (role, text) not in seen)[0]
            seen.add((role, text))
        want = plain_repair(rows)
        cut = rng.randint(0, len(kinds))
        matrix = conversations.times(conversations.product(kinds[:cut]), conversations.product(kinds[cut:]))
        assert matrix == conversations.product(kinds)
        cost, audit = conversations.cheapest(matrix)
        assert (cost, audit) == want[4:6]
        sizes = [cut, len(kinds) - cut]
        done = []
        for (piece, state, written), lo, hi in zip(conversations.pieces(audit, sizes), (0, cut), (cut, len(kinds)), strict=True):
            assert written == len(done)
            done += conversations.edited(kinds[lo:hi], iter(rows[lo:hi]), piece, state)
        assert tuple(done) == want[6]


def damaged_plainly(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def conversation_rows():
    rng = random.Random(12)
    rows = [(c, t, ["system", "user", "assistant"][min(t, 1) + (t > 0 and t % 2 == 0)], f"{c} {t}{rng.choice(['.', '!', '?', ' and', '. '])}") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(200, t, rng.choice(["user", "assistant", "user", "tool"]), f"turn {t % 300}.") for t in range(900)]  # long, with texts seen before
    rows += [(201, None, "user", "first."), (201, 3, "assistant", None), (201, 3, None, "who?"), (201, 9, "", "none."), (201, None, "assistant", "also first.")]
    rows += [(202, None, None, None), (None, 1, "user", "of none."), (None, 2, "assistant", "ja."), (203, 5, "user", "x" * 20000 + ".")]
    rows += [(204, 1, "user", "again.")] * 70 + [(204, 2, "assistant", "again.")] * 3 + [(205, t, "user", "same.") for t in range(80)]
    rows += [(206, -(1 << 63), "user", "low."), (206, (1 << 63) - 1, "assistant", "high.")]
    return rows


@pytest.mark.parametrize("chunk", [4096, 7])
def test_conversations(spark, tmp_path, chunk, monkeypatch):
    rows = conversation_rows()
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("n", "first", "part", "seq", "h", "digest", "kinds")})
    table.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    plain = conversations.repair
    monkeypatch.setattr(conversations, "repair", lambda r: plain(r, chunk))
    got = {r.conv_id: r.asDict() for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    by = {}
    for row in damaged_plainly(rows):
        by.setdefault(row[0], []).append(row)
    for conv in got:
        own = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        blank, duplicate, truncated, illegal, cost, audit, turns = plain_repair([r[2:] for r in own])
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
        text = "\n".join(f"{a}:{b}" for a, b in turns)
        want = dict(conv_id=conv, gaps=gaps, blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal, cost=cost, audit=audit, repaired_sha256=hashlib.sha256(text.encode()).hexdigest())
        assert got[conv] == want, conv


def test_repaired_turns(spark):
    rows = [(1, 1, "assistant", "I begin."), (1, 2, "user", "And I?"), (1, 4, "user", "And I?"), (1, 5, "user", "no end"), (2, 1, "system", "Only this.")]
    done = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=2)
    got = sorted(tuple(r) for r in done.turns().collect())
    want = {c: plain_repair([r[2:] for r in rows if r[0] == c])[6] for c in (1, 2)}
    assert got == sorted((c, i + 1, *t) for c in want for i, t in enumerate(want[c]))


def test_no_conversations(spark):
    done = conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert done.report().collect() == done.turns().collect() == done.digests().collect() == []
